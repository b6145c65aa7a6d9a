"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for each term and document, the positions of the term: a table (term, doc_id, positions).
A phrase query takes the terms of a test passage from the rarest on, subtracts each term's offset in the
passage from its positions, and intersects: positions that agree name one alignment of the passage in the
document. Alignments that the two rarest terms of some window agree on are then checked word by word, which
gives exact phrase matches; the same lists give proximity matches.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholia.llm.common import Shared, as_bytes, column, fresh, save, session, small_batches, texts

#: Words of a window.
WINDOW = 10
#: The most distinct benchmark terms, and bytes of them, that are broadcast to filter the index; beyond it the index is filtered by a join.
BROADCAST_TERMS, BROADCAST_BYTES = 1_000_000, 32 << 20

#: A-Z to a-z; digits, letters and UTF-8 bytes above ASCII stay; the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def test_terms(items: DataFrame) -> DataFrame:
    """(item_id, pos, term, n): the words of the test passages. Null ids and texts have none; items of one id join as separate passages."""
    small_batches(session(items))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("item_id", pa.int64()), ("passage", pa.binary()), ("pos", pa.int32()), ("term", pa.binary()), ("n", pa.int32())])
        for batch in batches:
            out: list[tuple] = []
            for item, data in zip(column(batch, "item_id"), as_bytes(batch), strict=True):
                w = words(data)
                passage = hashlib.blake2b(b" ".join(w), digest_size=16).digest()
                out += [(item, passage, i, x, len(w)) for i, x in enumerate(w)]
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in out] for j, k in enumerate(kind.names)}, schema=kind)

    return rows.mapInArrow(run, "item_id long, passage binary, pos int, term binary, n int").dropDuplicates(["item_id", "passage", "pos"])


def _own_terms(terms: DataFrame):
    """The distinct test terms, broadcast, if they are few enough; else None."""
    distinct = terms.select("term").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
    if size["n"] > BROADCAST_TERMS or size["b"] > BROADCAST_BYTES:
        return None
    return Shared(session(terms), {bytes(r[0]) for r in distinct.toLocalIterator()})


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, total): how often each test term stands in docs."""
    held = _own_terms(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value if held else None
        kind = pa.schema([("term", pa.binary()), ("total", pa.int64())])

        def flush(seen: Counter) -> pa.RecordBatch:
            both = [(w, c) for w, c in seen.items() if own is None or w in own]
            return pa.RecordBatch.from_pydict({"term": [w for w, _ in both], "total": [c for _, c in both]}, schema=kind)

        seen: Counter = Counter()
        for batch in batches:
            for data in as_bytes(batch):
                seen.update(words(data))
            if len(seen) > 200_000:
                yield flush(seen)
                seen = Counter()
        yield flush(seen)

    counted = texts(docs).mapInArrow(run, "term binary, total long")
    if held is None:
        counted = counted.join(terms.select("term").distinct(), "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("total").alias("total"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of docs over the given terms: (term, doc_id, positions), and for each document
    a row of the null term whose positions hold its number of words."""
    held = _own_terms(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value if held else None
        kind = pa.schema([("term", pa.binary()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])
        for batch in batches:
            out: list[tuple] = []
            for doc, data in zip(column(batch, "doc_id"), as_bytes(batch), strict=True):
                w = words(data)
                lists: dict[bytes, list[int]] = {}
                for i in range(len(w)) if own is None else [i for i, x in enumerate(w) if x in own]:
                    lists.setdefault(w[i], []).append(i)
                out += [(t, doc, p) for t, p in lists.items()]
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in out] for j, k in enumerate(kind.names)}, schema=kind)

    postings = texts(docs).mapInArrow(run, "term binary, doc_id long, positions array<int>")
    if held is None:
        postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return postings


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each test passage the words its windows are looked up by: each window's two rarest words in docs
    (ties: the earlier), or the only one. A passage shorter than the window, but not empty, is one window."""
    terms = test_terms(items)
    total = frequencies(docs, terms)
    rated = terms.join(total, "term", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    by_passage = rated.groupBy("item_id", "passage", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "total", "term"))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    # a window with a word that no document holds occurs nowhere
    picks = F.flatten(
        F.transform(
            starts,
            lambda s: F.when(
                F.forall(F.slice("w", s + 1, window), lambda x: x["total"] > 0),
                F.slice(F.array_sort(F.transform(F.slice("w", s + 1, window), lambda x: F.struct(x["total"].alias("total"), x["pos"].alias("pos")))), 1, 2),
            ).otherwise(F.array().cast("array<struct<total:bigint,pos:int>>")),
        )
    )
    chosen = by_passage.withColumn("at", F.explode(F.array_distinct(F.transform(picks, lambda x: x["pos"]))))
    return chosen.select("item_id", "passage", "n", F.col("at").alias("pos"), F.element_at("w", F.col("at") + 1)["term"].alias("term"))


def alignments(docs: DataFrame, chosen: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, passage, shift): places where anchors of a passage agree on where it would start.

    A true occurrence of a window holds both its anchors, so one agreeing pair within a window's length is
    asked for; a passage of a single word needs one.
    """
    lists = index(docs, chosen)
    hits = lists.join(chosen, "term").select("doc_id", "item_id", "passage", "n", "pos", F.explode("positions").alias("p"))
    grouped = hits.groupBy("doc_id", "item_id", "passage", (F.col("p") - F.col("pos")).alias("shift")).agg(
        F.count("*").alias("k"), F.min("n").alias("n")
    )
    return grouped.where("k >= 2 or n = 1").drop("k", "n")


def _tested(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, str]:
    """docs, all columns, with the passages and alignments to check in each row (null: none), and that column's name."""
    small_batches(session(docs))
    own, tests = fresh(docs, "key", "tests")
    terms = save(test_terms(items), "terms")
    # rows without an id are looked up together, under the smallest long; the word by word check tells them apart
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = texts(docs.select(key.alias("doc_id"), "text"))
    chosen = save(anchors(keyed, items, window), "anchors")
    found = alignments(keyed, chosen, window)
    passages = terms.groupBy("item_id", "passage").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))
    per_test = found.groupBy("doc_id", "passage", "item_id").agg(F.collect_set("shift").alias("shifts")).join(passages, ["item_id", "passage"])
    per_doc = per_test.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias(tests))
    return docs.join(per_doc, key == F.col(own), "left").drop(own), tests


def _check(data: bytes, tests: list[dict] | None, window: int) -> tuple[int, int, set[int]]:
    """Words, hit words and hit items of one text."""
    w = words(data)
    hit, items = bytearray(len(w)), set()
    for t in tests or ():
        for shift in t["shifts"]:
            if mark(w, t["words"], shift, window, hit):
                items.add(t["item_id"])
    return len(w), sum(hit), items


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items (items with a window that occurs), items_sha256 (of their ids, sorted as strings,
    comma-joined) and contaminated (n_hit > 0).

    Null and empty texts have no words. An item without words has no window. Rows that repeat a doc_id, and
    rows without one, are answered each from their own text.
    """
    both, name = _tested(texts(docs), items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        for batch in batches:
            rows = []
            for doc, data, tests in zip(column(batch, "doc_id"), as_bytes(batch), column(batch, name), strict=True):
                n_words, n, items = _check(data, tests, window)
                rows.append((doc, n_words, n, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n > 0))
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(kind.names)}, schema=kind)

    return both.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def mark(words: list[bytes], passage: list[bytes], shift: int, window: int, hit: bytearray) -> bool:
    """Mark the words of the runs of at least a window (or the whole shorter passage) that agree at one alignment."""
    need, run, any_hit = min(window, len(passage)), 0, False
    low, high = max(0, -shift), min(len(passage), len(words) - shift)
    for i in range(low, high):
        run = run + 1 if passage[i] == words[i + shift] else 0
        if run >= need:
            any_hit = True
            if run == need:
                hit[i + shift - need + 1 : i + shift + 1] = b"\1" * need
            else:
                hit[i + shift] = 1
    return any_hit


def proximity(docs: DataFrame, items: DataFrame, span: int = 30, rare: int = 8, least: int = 6) -> DataFrame:
    """(doc_id, item_id, n_terms, first_word): documents that hold at least `least` of an item's `rare` rarest distinct words within
    `span` words of one another, in any order; of an item with fewer distinct words all. n_terms: the most in one
    stretch, first_word: the first word (from 0) of the first such stretch.

    Rare is what the documents hold seldom (ties by word); words that no document holds are not among them. Rows
    without an id, and items without one or without words, match nothing. Rows that share an id are one document
    whose texts lie over one another; repeated items are one.
    """
    known = docs.where("doc_id is not null")
    terms = test_terms(items).groupBy("item_id", "term").agg(F.lit(1).alias("one"))
    total = frequencies(known, terms)
    by_item = Window.partitionBy("item_id")  # an item's own words
    rated = terms.withColumn("need", F.least(F.lit(least), F.count("*").over(by_item))).join(total, "term")
    chosen = rated.withColumn("k", F.row_number().over(by_item.orderBy("total", "term"))).where(F.col("k") <= rare).select("item_id", "term", "need")
    chosen = save(chosen, "rare")
    hits = index(known, chosen).join(chosen, "term").select("doc_id", "item_id", "need", "term", F.explode("positions").alias("p"))
    ahead = Window.partitionBy("doc_id", "item_id").orderBy("p").rangeBetween(0, span - 1)  # an item's rare words in one document
    met = hits.withColumn("n_terms", F.size(F.collect_set("term").over(ahead))).where("n_terms >= need")
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_terms", (-F.col("p")).alias("p"))).alias("r"))
    return best.select("doc_id", "item_id", F.col("r.n_terms").cast("long").alias("n_terms"), (-F.col("r.p")).cast("long").alias("first_word"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no window of a test passage occurs."""

    both, name = _tested(docs, items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not _check(data, tests, window)[1] for data, tests in zip(as_bytes(batch), column(batch, name), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([name])

    return both.mapInArrow(run, docs.schema)


#: contamination() for DuckDB.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM starts JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: proximity() for DuckDB.
PROXIMITY_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
places AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p FROM d),
totals AS (SELECT term, count(*) AS total FROM places SEMI JOIN terms USING (term) GROUP BY term),
needs AS (SELECT item_id, least(6, count(*)) AS need FROM terms GROUP BY item_id),
chosen AS (
  SELECT item_id, term, need FROM terms JOIN totals USING (term) JOIN needs USING (item_id)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY total, term) <= 8),
hits AS (SELECT doc_id, item_id, need, term, p FROM places JOIN chosen USING (term)),
met AS (
  SELECT doc_id, item_id, need, p, len(list_distinct(list(term) OVER (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING))) AS n_terms FROM hits),
best AS (SELECT doc_id, item_id, max((n_terms, -p)) AS r FROM met WHERE n_terms >= need GROUP BY doc_id, item_id)
SELECT doc_id, item_id, r[1] AS n_terms, -r[2] AS first_word FROM best
"""
