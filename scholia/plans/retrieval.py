"""Retrieval: trigram BM25, cosine, their merge, rerank and context."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.adapters import Source
from scholia.functions.numbers import cosine
from scholia.functions.text import hash16
from scholia.operators import keyed, nearest as nearest_blocks, sets, text_index
from scholia.registry import query
from scholia.session import scratch

C = F.col


def bm25(docs: DataFrame, words: str, k: int = 20) -> DataFrame:
    """The k documents (doc_id, text) that hold all terms of a query as substrings, case folded, by BM25 over trigrams.

    Terms shorter than three characters are left out; a query of only such terms finds nothing. The statistics are one
    aggregate over all documents (a row, whatever their number), so a search is two scans and a top-k."""
    terms = sorted({t.lower() for t in words.split() if len(t) >= 3})
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    size = F.greatest(F.char_length("t") - 2, F.lit(0)).cast("double")
    if not terms:
        return low.where("false").select("doc_id", F.lit(0.0).alias("score"))
    stats = low.agg(F.count("*").cast("double").alias("n"), F.avg(size).alias("avg"), *(F.count_if(F.contains("t", F.lit(t))).cast("double").alias(f"n{i}") for i, t in enumerate(terms)))
    hits = low.where(reduce(lambda a, b: a & b, (F.contains("t", F.lit(t)) for t in terms))).join(F.broadcast(stats))  # one row

    def part(i: int, t: str):
        f = (F.char_length("t") - F.char_length(F.replace("t", F.lit(t), F.lit("")))) / len(t)
        idf = F.log((C("n") - C(f"n{i}") + 0.5) / (C(f"n{i}") + 0.5))
        return F.when(idf <= 0, 1e-6).otherwise(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / C("avg")))

    score = reduce(lambda a, b: a + b, (part(i, t) for i, t in enumerate(terms)))
    return hits.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def _bm25_sql(words: str, k: int) -> str:
    terms = sorted({t.lower() for t in words.split() if len(t) >= 3})
    low = "low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"
    stats = "st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(greatest(length(t) - 2, 0)) AS a, " + ", ".join(f"CAST(count(*) FILTER (WHERE contains(t, '{t}')) AS DOUBLE) AS n{i}" for i, t in enumerate(terms)) + " FROM low)"
    f = lambda t: f"((length(t) - length(replace(t, '{t}', ''))) / {len(t)})"
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN CAST(1e-6 AS DOUBLE) ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * {f(t)} * 2.2::DOUBLE / ({f(t)} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(length(t) - 2, 0) / a))" for i, t in enumerate(terms))
    where = " AND ".join(f"contains(t, '{t}')" for t in terms)
    return f"{low}, {stats}, bm AS (SELECT doc_id, {score} AS score FROM low, st WHERE {where} ORDER BY score DESC, doc_id LIMIT {k})"


WORDS = "the data of"


@query("ret2_srt5_bm25", f", {_bm25_sql(WORDS, 20)} SELECT doc_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM bm")
def search(s: Source) -> DataFrame:
    return bm25(s.table("documents"), WORDS).select("doc_id", (F.floor(C("score") * 1_000_000 + 0.5) / 1_000_000).alias("score"))


def nearest(vectors: DataFrame, wanted: DataFrame, k: int = 20) -> DataFrame:
    """The k rows (vec_id, embedding) of highest cosine to one query vector; vectors of another size are left out."""
    q = F.broadcast(wanted.select(C("embedding").alias("q")).limit(1))  # one row
    return vectors.join(q).select("vec_id", cosine(C("embedding"), C("q")).alias("score")).where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)


_COSINE = """sim AS (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
      / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS score
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20)"""


@query("ret3_srt6_mth4_cosine", f", {_COSINE} SELECT vec_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM sim")
def similar(s: Source) -> DataFrame:
    e = s.table("embeddings")
    return nearest(e, e.where("vec_id = 0")).select("vec_id", (F.floor(C("score") * 1_000_000 + 0.5) / 1_000_000).alias("score"))


def hybrid(s: Source, words: str, vec_id: int, k: int = 6) -> DataFrame:
    """Text hits and vector hits by id with their higher score, in the order first seen, text first."""
    e = s.table("embeddings")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))  # noqa: E731  20 rows
    parts = [ranked(bm25(s.table("documents"), words)), ranked(nearest(e, e.where(C("vec_id") == vec_id)).withColumnRenamed("vec_id", "doc_id"))]
    merged = sets.max_merge(parts, "doc_id", "score", "rank")
    k = k if 1 <= k <= 20 else 6
    return merged.orderBy("seen.part", "seen.rank").limit(k)


@query("ret4_ret5_ret7_hybrid", f""", {_bm25_sql(WORDS, 20)}, {_COSINE}, u AS (SELECT doc_id, score, 0 AS part, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm UNION ALL SELECT vec_id, score, 1, row_number() OVER (ORDER BY score DESC, vec_id) FROM sim)
    SELECT doc_id, floor(max(score) * 1000000 + 0.5) / 1000000 AS score FROM u GROUP BY doc_id ORDER BY min((part, rank)) LIMIT 6""".replace("min((part, rank))", "min(part * 1000 + rank)"))
def merged(s: Source) -> DataFrame:
    return hybrid(s, WORDS, 0).select("doc_id", (F.floor(C("score") * 1_000_000 + 0.5) / 1_000_000).alias("score"))


@query("ret6_rerank", f""", {_bm25_sql(WORDS, 20)}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm), o AS (SELECT rank, CAST((rank * 7) % 5 AS DOUBLE) AS outside FROM r WHERE rank % 3 > 0)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY coalesce(outside, score) DESC, rank) AS INTEGER) AS place, CAST(CASE WHEN outside IS NOT NULL THEN count(*) FILTER (WHERE outside IS NOT NULL) OVER (ORDER BY outside DESC NULLS LAST, rank) END AS INTEGER) AS strict_place FROM r LEFT JOIN o USING (rank) QUALIFY place <= 6""")
def reranked(s: Source) -> DataFrame:
    """Outside scores come by a hit's index: they replace the own ones, hits without one keep theirs, and ties keep the order before. The strict variant
    leaves out hits without an outside score."""
    rank = W.orderBy(F.desc("score"), "doc_id")  # 20 rows
    found = bm25(s.table("documents"), WORDS).withColumn("rank", F.row_number().over(rank))
    outside = found.where("rank % 3 > 0").select("rank", (C("rank") * 7 % 5).cast("double").alias("outside"))
    j = found.join(outside, "rank", "left").withColumn("place", F.row_number().over(W.orderBy(F.desc(F.coalesce("outside", "score")), "rank")))
    strict = F.when(C("outside").isNotNull(), F.row_number().over(W.orderBy(F.desc_nulls_last("outside"), "rank")))
    return j.withColumn("strict_place", strict).where("place <= 6").select("doc_id", "place", "strict_place")


@query("ret8_context", """SELECT source, count(*) AS n, sha256(string_agg('【' || source || ' document:' || doc_id || '】' || chr(10) || CASE WHEN strlen(text) > 6000 THEN decode(encode(text)[1:6000]) ELSE text END || chr(10) || chr(10), '' ORDER BY doc_id)) AS context FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents) WHERE strlen(text) <= 6000 GROUP BY source
    UNION ALL SELECT 'long ' || doc_id, 1, sha256(CAST('【' || source || ' document:' || doc_id || '】' || chr(10) AS BLOB) || encode(text)[1:6000] || CAST(chr(10) || chr(10) AS BLOB)) FROM documents WHERE strlen(text) > 6000""".replace("CASE WHEN strlen(text) > 6000 THEN decode(encode(text)[1:6000]) ELSE text END", "text").replace("encode(text)[1:6000]", "unhex(substr(hex(encode(text)), 1, 12000))").replace("CAST('【' || source || ' document:' || doc_id || '】' || chr(10) AS BLOB)", "encode('【' || source || ' document:' || doc_id || '】' || chr(10))").replace("CAST(chr(10) || chr(10) AS BLOB)", "encode(chr(10) || chr(10))"))
def context(s: Source) -> DataFrame:
    """A header and a text for each document, texts cut at 6000 bytes each, not in all: contexts of a source's documents that fit, and of each that doesn't."""
    block = context_block(C("source"), C("doc_id"), F.coalesce("text", F.lit("")))
    d = s.table("documents").select("source", "doc_id", block.alias("block"), (F.octet_length(F.coalesce("text", F.lit(""))) > 6000).alias("long"))
    short = d.where("not long").groupBy("source").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "block"))).alias("rows"))
    short = short.select("source", "n", F.sha2(F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["block"])), "")), 256).alias("context"))
    long = d.where("long").select(F.concat(F.lit("long "), C("doc_id").cast("string")).alias("source"), F.lit(1).cast("long").alias("n"), F.sha2("block", 256).alias("context"))
    return short.unionByName(long)


def context_block(source: Column, doc: Column, text: Column, most: int = 6000) -> Column:
    """Header, line feed, the text's first `most` bytes, an empty line; as bytes, for a cut may fall inside a character."""
    head = F.concat(F.lit("【"), source, F.lit(" document:"), doc.cast("string"), F.lit("】\n"))
    return F.concat(head.cast("binary"), F.substring(text.cast("binary"), 1, most), F.lit("\n\n").cast("binary"))


def _asked(s: Source) -> DataFrame:
    """The stated set of queries."""
    return s.table("embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding")


@query("ret3_many_queries", """, n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS w FROM n),
    p AS (SELECT q.vec_id AS query, u.vec_id, list_sum(list_transform(list_zip(q.e, u.e), lambda z: z[1] * z[2])) / (q.w * u.w) AS score FROM u q, u WHERE q.vec_id % 50 = 0)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY floor(score * 1000000 + 0.5) DESC, vec_id) AS INTEGER) AS rank, vec_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY floor(score * 1000000 + 0.5) DESC, vec_id) <= 20""")
def many(s: Source) -> DataFrame:
    """The twenty nearest of each query, by blocks; ranked by the score that is shown, so equal ones by id."""
    return nearest_blocks.exact(s.table("embeddings"), _asked(s), 64, places=6)


@query("ret9_indexed_neighbours")
def indexed_neighbours(s: Source) -> DataFrame:
    """For each query its nearest others by the index of lists. The lists are approximate, so there is no SQL; a test states the recall against exact()."""
    found = nearest_blocks.Index(s.table("embeddings"), 64).search(_asked(s), 21).where("vec_id <> query")
    rank = F.row_number().over(W.partitionBy("query").orderBy("rank"))  # 21 rows
    return found.withColumn("rank", rank).where("rank <= 20")


@query("ret1_keyed_updates", "SELECT source AS source_type, substr(sha256(text), 1, 32) AS content_hash, max(doc_id) AS doc_id, count(*) AS version FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def keyed_updates(s: Source) -> DataFrame:
    """The index rows above, kept in a table of buckets: two batches of documents, the second sent twice."""
    d = s.table("documents").where("text is not null").select("doc_id", C("source").alias("source_type"), hash16(C("text")).alias("content_hash"))
    path, kind = scratch(s.spark, "index-rows"), "source_type string, content_hash string, doc_id long, version long"

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new.withColumn("version", F.lit(1).cast("long")))
        return rows.groupBy("source_type", "content_hash").agg(F.max("doc_id").alias("doc_id"), F.sum("version").alias("version"))

    half = d.agg(F.percentile("doc_id", 0.5).alias("m")).first()["m"]
    for n, part in enumerate((d.where(C("doc_id") <= half), d.where(C("doc_id") > half), d.where(C("doc_id") > half))):
        keyed.apply(path, kind, part, min(n, 1), ["source_type", "content_hash"], merge, 16)
    return keyed.read(s.spark, path, kind).drop("bucket", "batch")


@query("ret9_similar", f", {_COSINE} SELECT vec_id FROM sim WHERE vec_id <> 0")
def others(s: Source) -> DataFrame:
    e = s.table("embeddings")
    return nearest(e, e.where("vec_id = 0")).where("vec_id <> 0").select("vec_id")


@query("ret10_join8_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending(s: Source) -> DataFrame:
    return s.table("documents").join(s.table("embeddings").select(C("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("ret1_snk3_index_upsert", "SELECT source AS source_type, substr(sha256(text), 1, 32) AS content_hash, max(doc_id) AS doc_id, count(*) AS version FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def index_upsert(s: Source) -> DataFrame:
    d = s.table("documents").where("text is not null").select("doc_id", C("source").alias("source_type"), hash16(C("text")).alias("content_hash"))
    return d.groupBy("source_type", "content_hash").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("version"))


_GRAMS = """, t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) >= 3), g AS (SELECT doc_id, substr(t, i, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM t)) SELECT gram, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM g GROUP BY gram"""


@query("snk2_postings", _GRAMS)
def postings(s: Source) -> DataFrame:
    """The index over whole documents, a row for each trigram: documents that hold it and times it stands there."""
    low = s.table("documents").where("text is not null").select(C("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("t"))
    return _counted(text_index.grams(low))


def _counted(rows: DataFrame) -> DataFrame:
    each = rows.groupBy("gram").agg(F.count("*").alias("n_docs"), F.sum(F.size("at")).alias("n"))
    return each.select(text_index.gram_text(C("gram")).alias("gram"), "n_docs", "n")


def _refreshed(s: Source) -> str:
    """An index first built over older documents (a seventh was missing, a fifth had another text, some have gone since), then refreshed."""
    d, path = s.table("documents").select("doc_id", "text"), scratch(s.spark, "index")
    older = d.where("doc_id % 7 <> 0").withColumn("text", F.when(C("doc_id") % 5 == 0, F.concat_ws(" ", F.lit("draft"), F.reverse("text"))).otherwise(C("text")))
    gone = d.where("doc_id % 50 = 1").select((-C("doc_id") - 1).alias("doc_id"), "text")
    text_index.refresh(older.unionByName(gone), path)
    text_index.refresh(d, path)
    return path


@query("snk2_index_refresh", _GRAMS)
def refreshed_postings(s: Source) -> DataFrame:
    """The stored index after a refresh holds what a new one would."""
    return _counted(text_index.live(s.spark, _refreshed(s)))


@query("ret2_snk2_indexed_search", f", {_bm25_sql(WORDS, 20)} SELECT doc_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM bm")
def indexed_search(s: Source) -> DataFrame:
    """The search above by the stored index: it reads the postings of the query's grams and no text."""
    return text_index.search(s.spark, _refreshed(s), WORDS).select("doc_id", (F.floor(C("score") * 1_000_000 + 0.5) / 1_000_000).alias("score"))


@query("ret11_provider_fallback", """, p AS (SELECT s_suppkey AS id, s_nationkey % 4 AS user_id, CASE WHEN s_suppkey % 2 = 0 THEN 'llm' ELSE 'embedding' END AS kind, s_acctbal > 8000 AS is_default FROM supplier),
    u AS (SELECT DISTINCT c_nationkey % 6 AS user_id, kind FROM customer, (SELECT DISTINCT kind FROM p)),
    r AS (SELECT u.user_id, u.kind, p.id, CASE WHEN p.user_id = u.user_id AND u.user_id > 0 THEN CASE WHEN is_default THEN 1 ELSE 2 END ELSE CASE WHEN is_default THEN 3 ELSE 4 END END AS rung FROM u JOIN p ON p.kind = u.kind AND (p.user_id = u.user_id OR p.user_id = 0))
    SELECT user_id, kind, id, CAST(rung AS INTEGER) AS rung FROM r QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY rung, CASE WHEN rung % 2 = 1 THEN -id ELSE id END) = 1""")
def fallback(s: Source) -> DataFrame:
    """A user's provider of each kind: the own default (the newest), else the own first, else the default of all (user 0), else its first."""
    p = s.table("supplier").select(C("s_suppkey").alias("id"), (C("s_nationkey") % 4).alias("owner"), F.when(C("s_suppkey") % 2 == 0, "llm").otherwise("embedding").alias("kind"), (C("s_acctbal") > 8000).alias("is_default"))
    users = s.table("customer").select((C("c_nationkey") % 6).alias("user_id")).distinct()
    asked = users.join(F.broadcast(p.groupBy().agg(F.collect_set("kind").alias("kinds")))).select("user_id", F.explode("kinds").alias("kind"))  # two kinds
    own = asked.join(p, "kind").where("owner = user_id or owner = 0")
    mine = (C("owner") == C("user_id")) & (C("user_id") > 0)
    rung = F.when(mine, F.when(C("is_default"), 1).otherwise(2)).otherwise(F.when(C("is_default"), 3).otherwise(4))
    best = own.withColumn("rung", rung).groupBy("user_id", "kind").agg(F.min(F.struct("rung", F.when(C("rung") % 2 == 1, -C("id")).otherwise(C("id")).alias("order"), "id")).alias("r"))
    return best.select("user_id", "kind", "r.id", "r.rung")


@query("vec1_codec", """SELECT vec_id, 4 * len(embedding) AS n_bytes, floor(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) * 10000 + 0.5) / 10000 AS total, TRUE AS same FROM embeddings""".replace("4 * len(embedding)", "CAST(4 * len(embedding) AS BIGINT)"))
def codec(s: Source) -> DataFrame:
    """Vectors as little-endian single precision and back."""
    v = s.table("embeddings").select("vec_id", "embedding", encode("embedding").alias("blob")).withColumn("back", decode("blob"))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return v.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (F.floor(total * 10000 + 0.5) / 10000).alias("total"), (C("embedding").cast("array<float>") == C("back")).alias("same"))


@F.pandas_udf(T.BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    """Four little-endian bytes a number; a null vector has none."""
    return vectors.map(lambda v: np.asarray([] if v is None else v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: np.frombuffer(b, "<f4"))
