"""SimHash near-duplicates through pivot distance tables.

Every fingerprint gets a table of its Hamming distances to many reference fingerprints (pivots). By the
triangle inequality two fingerprints within k bits differ by at most k in every coordinate, so a larger
difference anywhere discards a pair; what survives is verified on the fingerprints themselves.

To find pairs without comparing all, the pivots come in bands: those of a band differ from a base pivot only in
the bits of that band, so the difference of a distance from the base's depends on the band's bits alone. Two
fingerprints within k bits agree in all coordinates of all bands but k at most. Each fingerprint is therefore
filed once for each way to leave k bands out, under a hash of the remaining coordinates. With 8 bands of 8
bits and k = 2 a file leaves 16 bits free, which bounds its size whatever the corpus; equal fingerprints were
merged before. A file returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import arrow_schema, as_bytes, column, components, drop_saved, fresh, map_batches, save, session, texts
from scholia.llm.exchange import answered, blocks, buckets_for, messages, place, read, sums, with_answers
from scholia.llm.repeats import mix

#: Bands of equal width that 64 bits are cut into.
BANDS = 8
#: Pivots of each band, besides the base.
PIVOTS = 12


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a lower-cased (A-Z) text, repeats included."""
    w = data.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half the hashes, as a signed long; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint long), a row for each row of docs. Null and empty texts have fingerprint 0."""

    def make(batch: pa.RecordBatch) -> dict:
        return {"doc_id": column(batch, "doc_id"), "fingerprint": [majority(shingle_hashes(x, shingle)) for x in as_bytes(batch)]}

    return map_batches(texts(docs), make, "doc_id long, fingerprint long")


def pivots(seed: int = 7) -> np.ndarray:
    """The base pivot, then PIVOTS for each band: fixed pseudo-random reference fingerprints."""
    draw = np.random.Generator(np.random.PCG64(seed))
    base = draw.integers(0, 2**64, dtype=np.uint64, endpoint=False)
    width = 64 // BANDS
    inside = [draw.choice(np.arange(1, 2**width, dtype=np.uint64), PIVOTS, replace=False) << np.uint64(b * width) for b in range(BANDS)]
    return np.concatenate(([base], base ^ np.concatenate(inside)))


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int16)


def _files(prints: np.ndarray, references: np.ndarray, bits: int) -> np.ndarray:
    """A column of file keys for each choice of bands left out: hashes of the coordinates kept."""
    table = distances(prints, references)
    relative = (table[:, 1:] - table[:, :1] + 64).astype(np.uint64).reshape(len(prints), BANDS, PIVOTS)
    draw = np.random.Generator(np.random.PCG64(11))
    odd = draw.integers(0, 2**63, (BANDS, PIVOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = (relative * odd).sum(axis=2, dtype=np.uint64)
    band = (band ^ (band >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    every = band.sum(axis=1, dtype=np.uint64)
    keys = [(every - band[:, list(out)].sum(axis=1, dtype=np.uint64)) * np.uint64(0x94D049BB133111EB) + np.uint64(k) for k, out in enumerate(combinations(range(BANDS), bits))]
    return np.stack(keys, axis=1).view(np.int64)


def forest(prints: np.ndarray, references: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs of at most `bits` differing bits."""
    table = distances(prints, references)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    upto = np.searchsorted(table[:, 0], table[:, 0] + bits, side="right")  # the first coordinate already bounds the partners
    for i in range(len(prints)):
        j = np.arange(i + 1, upto[i])
        for c in range(1, table.shape[1], 16):  # discard by the largest coordinate difference, some pivots at a time
            if not len(j):
                break
            j = j[np.abs(table[j, c : c + 16] - table[i, c : c + 16]).max(axis=1) <= bits]
        for k in j[np.bitwise_count(prints[j] ^ prints[i]) <= bits].tolist() if len(j) else ():
            a, b = find(i), find(k)
            if a != b:
                root[b] = a
                out.append((int(prints[i]), int(prints[k])))
    return out


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints within `bits` bits that keep their connected components.

    prints: (fingerprint long), distinct. bits: at most 3, or the files grow too large.
    """
    if not 1 <= bits <= 3:
        raise ValueError("bits must be 1, 2 or 3")
    references = pivots()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = _files(x.view(np.uint64), references, bits)
            yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1), "fingerprint": np.repeat(x, keys.shape[1])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(at)
            two = at[:-1][size == 2]
            a, b = flat[two].view(np.uint64), flat[two + 1].view(np.uint64)
            near = np.bitwise_count(a ^ b) <= bits
            more = [x for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True) for x in forest(np.unique(flat[s : s + n]).view(np.uint64), references, bits)]
            rest = np.array(more, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": np.concatenate((a[near], rest[:, 0])).view(np.int64), "b": np.concatenate((b[near], rest[:, 1])).view(np.int64)}, schema=kind)

    filed = prints.select("fingerprint").mapInArrow(file, "key long, fingerprint long")
    lists = filed.groupBy("key").agg(F.collect_list("fingerprint").alias("prints")).where(F.size("prints") > 1).select("prints")
    return lists.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id
    reachable over links of at most `bits` differing bits, itself included.

    Null and empty texts have fingerprint zero and link like any other. A row without an id takes its
    component's smallest id, null if no row of it has one. Rows that repeat an id are answered each.
    """
    prints = save(fingerprints(docs, shingle), "simhash")
    distinct = save(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    grouped = components(links(distinct, bits)).withColumnRenamed("node", "fingerprint")
    joined = distinct.join(grouped, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = joined.join(least, "component").select("fingerprint", "component_id")
    return prints.join(answer, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


class Shingler:
    """Distinct hashes of word shingles, made from hashes of the words; a task remembers words it has met."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def words(self, data: bytes) -> np.ndarray:
        w, known = data.lower().split(), self.known
        if len(known) > 500_000:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x, 42)
        return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))

    def shingles(self, data: bytes) -> np.ndarray:
        """A hash for each shingle, repeats included; all words are one shingle where they are fewer."""
        w = self.words(data)
        n = len(w) - self.size + 1
        if n <= 0:
            return mix(np.array([sum(x * pow(3, k + 100, 2**64) for k, x in enumerate(w.tolist())) % 2**64], np.uint64)) if len(w) else w
        out = np.zeros(n, np.uint64)
        for j in range(self.size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        return mix(out)


def _sketch(docs: DataFrame, shingle: int, tables: int, features: int) -> DataFrame:
    """(row, doc_id, text, same, fingerprint, samples): a number of the row, a hash of the words, the whole
    fingerprint, and fingerprints of `tables` min-wise samples of `features` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.Generator(np.random.PCG64(3))
        odd = draw.integers(0, 2**63, (tables, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        own = Shingler(shingle)
        for batch in batches:
            out: dict = {"row": column(batch, "row"), "doc_id": column(batch, "doc_id"), "text": column(batch, "text"), "same": [], "fingerprint": [], "samples": []}
            for data in as_bytes(batch):
                h = own.shingles(data)
                u = np.unique(h)
                out["same"].append(hashlib.blake2b(b" ".join(data.lower().split()), digest_size=16).digest())
                out["fingerprint"].append(majority(h))
                if not len(u):
                    out["samples"].append([0] * tables)
                    continue
                mixed = u[None, :] * odd
                mixed ^= mixed >> np.uint64(32)
                k = min(features, len(u))
                least = np.argpartition(mixed, k - 1, axis=1)[:, :k] if k < len(u) else np.tile(np.arange(len(u)), (tables, 1))
                out["samples"].append([majority(u[x]) for x in least])
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema(ddl))

    ddl = "row long, doc_id long, text string, same binary, fingerprint long, samples array<long>"
    return texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ddl)


def _verified(pairs: DataFrame, body: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have the Jaccard similarity asked for, on the whole texts."""
    with_b = pairs.join(body.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(body.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle)
        last: tuple = (None, None)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, x, y in zip(column(batch, "a"), column(batch, "b"), as_bytes(batch, "text_a"), as_bytes(batch, "text_b"), strict=True):
                if last[0] != a:
                    last = (a, np.unique(own.shingles(x)))
                v = np.unique(own.shingles(y))
                n = len(np.intersect1d(last[1], v, assume_unique=True))
                if n >= similarity * (len(last[1]) + len(v) - n) - 1e-9:
                    out.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _grade(keys: np.ndarray, total: list[np.ndarray]) -> np.ndarray:
    """How many texts hold a shingle, in one byte: exact below 200, then four steps to a doubling."""
    n = total[0]
    return np.where(n < 200, n, np.minimum(255, 200 + np.ceil(4 * np.log2(np.maximum(n, 200) / 200)))).astype(np.uint8)


def _heads(reps: DataFrame, body: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(s, row, component, n, i): the shingles s by which rows of different components may still meet, a row's number of
    shingles and the place of this one in their order.

    reps: (row, component). All shingles have one order, those of few texts first: exact counts over all texts, which
    blocks of texts ask for (see exchange.py). Of two sets with a Jaccard similarity of s each has the first shingle that
    both hold among its first n - ceil(s n) + 1, so there they meet; shingles of one text alone meet nothing and stay at
    home.
    """
    held = blocks(body.select("row", "text").join(reps.select("row", "component"), "row"), {"row": "bigint", "component": "bigint", "text": "string"})
    spark = session(body)
    size = held.agg(F.sum(F.expr("aggregate(text, 0L, (n, x) -> n + octet_length(coalesce(x, '')))"))).first()[0] or 0
    n_buckets = buckets_for(size, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def asked(row: dict, own: Shingler) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        sets = [np.unique(own.shingles((x or "").encode())) for x in row["text"].as_py()]
        every = place(np.concatenate(sets) if sets else np.empty(0, np.uint64), n_buckets)
        return sets, *np.unique(every, return_inverse=True, return_counts=True)

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        _, keys, _, count = asked(row, Shingler(shingle))
        yield messages(row["block"].as_py(), keys, [count.astype("<u4")])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema("s long, row long, component long, n long, i long")
        own = Shingler(shingle)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}
                sets, _, at, _ = asked(row, own)
                grade, start = read(row["answers0"].as_py(), "u1")[at], 0
                out: list[tuple] = []
                for number, component, u in zip(row["row"].as_py(), row["component"].as_py(), sets, strict=True):
                    n, g = len(u), grade[start : start + len(u)]
                    start += n
                    first = np.lexsort((u, g))[: n - math.ceil(similarity * n - 1e-9) + 1]
                    i = np.flatnonzero(g[first] > 1)
                    out.append((u[first[i]].view(np.int64), np.full(len(i), number), np.full(len(i), component), np.full(len(i), n), i))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], schema=kind)

    answers = answered(held, ask, sums(["<u4"], _grade), "grades", n_buckets)
    filed = save(with_answers(held, answers).mapInArrow(heads, "s long, row long, component long, n long, i long"), "heads")
    out = save(_mixed(filed), "open")
    for done in (held, answers, filed):
        drop_saved(done)
    return out


def _mixed(filed: DataFrame) -> DataFrame:
    """Only shingles that rows of several components hold."""
    several = filed.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s")
    return filed.join(several, "s", "left_semi")


def _hub_pairs(filed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each row of _heads() with the first and the last row that hold its shingle, of other components, where their
    sizes and places allow the similarity."""
    row = F.struct("row", "component", "n", "i")
    hubs = filed.groupBy("s").agg(F.min(row).alias("x"), F.max(row).alias("y")).select("s", F.explode(F.array("x", "y")).alias("h"))
    met = filed.join(hubs, "s").where(F.col("component") != F.col("h.component"))
    enough = F.least(F.col("n") - F.col("i"), F.col("h.n") - F.col("h.i")) >= similarity / (1 + similarity) * (F.col("n") + F.col("h.n")) - 1e-6
    met = met.where(enough & (F.least("n", "h.n") >= similarity * F.greatest("n", "h.n") - 1e-6))
    return met.select(F.least("row", "h.row").alias("a"), F.greatest("row", "h.row").alias("b")).distinct()


def _open_pairs(filed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): rows of _heads() of different components that may still reach the similarity; no pair that does is left out. A pair goes
    on if its sizes allow it, and what lies behind the shared shingle in both does."""
    # components that share a shingle meet first, by bounds over their members, then the members themselves
    sides = filed.groupBy("s", "component").agg(F.min("n").alias("n"), F.max("n").alias("m"), F.max(F.col("n") - F.col("i")).alias("r"))
    one, two = (sides.select("s", *(F.col(c).alias(f"{c[0]}{x}") for c in ("component", "n", "m", "r"))) for x in "ab")
    share = similarity / (1 + similarity)
    bound = (F.least("ra", "rb") >= share * (F.col("na") + F.col("nb")) - 1e-6) & (F.least("ma", "mb") >= similarity * F.greatest("na", "nb") - 1e-6)
    across = one.join(two, (one["s"] == two["s"]) & (F.col("ca") < F.col("cb")) & bound).select(one["s"].alias("s"), "ca", "cb", F.col("nb").alias("least_b"), F.col("mb").alias("most_b"), F.col("rb").alias("rest_b"))
    one, two = (filed.select("s", F.col("component").alias(f"c{x}"), F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}")) for x in "ab")
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= share * (F.col("na") + F.col("nb")) - 1e-6
    may = (F.least(F.col("na") - F.col("ia"), "rest_b") >= share * (F.col("na") + F.col("least_b")) - 1e-6) & (F.col("most_b") >= similarity * F.col("na") - 1e-6) & (F.col("na") >= similarity * F.col("least_b") - 1e-6)
    met = across.join(one, ["s", "ca"]).where(may).join(two, ["s", "cb"]).where(enough & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6))
    return met.select("a", "b").distinct()


def near_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 2, tables: int = 16, features: int = 3) -> DataFrame:
    """(row, doc_id, text, component): each row of docs, numbered, and a number of its group of near-duplicates.

    Texts of the same lower-cased words are one group. Texts whose shingle sets have a Jaccard similarity of
    `similarity` or more, computed on the whole texts, are linked, and a group is what links connect.

    Three rounds find the groups. The first is cheap and joins most: rows that agree on one of `tables` min-wise
    samples of `features` shingles are compared with the first and last of those only, whole fingerprints within
    `bits` bits along a forest. The second compares rows with the first and last that hold one of their rare shingles. The third
    settles the rest exactly: any two rows of different groups that can reach the similarity meet by a rare shingle
    (see _heads and _open_pairs) and are compared.
    """
    sketch = save(_sketch(docs, shingle, tables, features), "sketch")
    reps = save(sketch.groupBy("same").agg(F.min(F.struct("row", "fingerprint", "samples")).alias("r")).select("same", "r.*"), "reps")
    filed = reps.select("row", F.posexplode("samples").alias("t", "f"))
    hub = filed.groupBy("t", "f").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi")
    sampled = filed.join(hub, ["t", "f"]).select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("row").alias("b")), F.struct(F.col("hi").alias("a"), F.col("row").alias("b")))).alias("e")).select("e.*")
    by_print = reps.groupBy("fingerprint").agg(F.min("row").alias("row"))
    near = links(by_print.select("fingerprint"), bits)
    near = near.join(by_print.select(F.col("fingerprint").alias("a"), F.col("row").alias("x")), "a").join(by_print.select(F.col("fingerprint").alias("b"), F.col("row").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = reps.join(by_print.withColumnRenamed("row", "a"), "fingerprint").select("a", F.col("row").alias("b"))
    pairs = sampled.unionAll(near).unionAll(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    grouped = components(_verified(pairs, sketch, shingle, similarity))
    first = save(reps.join(grouped, F.col("row") == F.col("node"), "left").select("same", "row", F.coalesce("component", "row").alias("component")), "groups")
    filed = _heads(first, sketch, shingle, similarity)
    for find in (_hub_pairs, _open_pairs):
        more = _verified(find(filed, similarity), sketch, shingle, similarity)
        group = first.select("row", "component")
        more = more.join(group.toDF("a", "ca"), "a").join(group.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        moved = save(components(more).toDF("component", "least"), "moved")
        now = lambda df: df.join(moved, "component", "left").withColumn("component", F.coalesce("least", "component")).drop("least")  # noqa: B023, E731
        old, first = first, save(now(first).select("same", "row", "component"), "groups")
        if find is _hub_pairs:
            old_filed, filed = filed, save(_mixed(now(filed).select("s", "row", "component", "n", "i")), "open")
            drop_saved(old_filed)
        for done in (old, moved):
            drop_saved(done)
    drop_saved(filed)
    drop_saved(reps)
    last = first.select("same", "component")
    return sketch.select("row", "doc_id", "text", "same").join(last, "same").select("row", "doc_id", "text", "component")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id): each document with an id, and the smallest id of its group of near-duplicates (see near_texts)."""
    grouped = save(near_texts(docs.where("doc_id is not null"), **options).select("doc_id", "component"), "near")
    return grouped.join(grouped.groupBy("component").agg(F.min("doc_id").alias("keep_id")), "component").select("doc_id", "keep_id")


def keep_texts(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns unchanged, with one row of each group of near-duplicate texts: that of smallest id, of
    rows that share an id that of smallest hashed text.

    A row is judged by its own text alone: rows that share an id stay together if their texts are unlike, and
    rows without an id, which come after all others, are searched like any. Of rows with the same id and text one
    stays. A table without rows gives none; extra columns may have any name.
    """
    k, n, t, again, row = fresh(docs, "key", "none", "tag", "again", "row")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = save(near_texts(docs, **options).select("component", key.alias(k), F.col("doc_id").isNull().alias(n), tag.alias(t)), "near")
    kept = own.groupBy("component").agg(F.min(F.struct(k, n, t)).alias("r")).select("r.*", F.lit(True).alias(again))
    many = own.groupBy(k, n, t).agg(F.count("*").alias("many")).join(kept, [k, n, t], "left").where(f"many > 1 or {again} is null")
    gone = many.select(k, n, t, F.coalesce(again, F.lit(False)).alias(again))
    marked = docs.join(gone, (key == F.col(k)) & (F.col("doc_id").isNull() == F.col(n)) & (tag == F.col(t)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.where(F.col(k).isNull()).select(*names)
    first = marked.where(again).select(k, n, t, F.struct(*names).alias(row)).groupBy(k, n, t).agg(F.min(row).alias(row)).select(f"{row}.*")
    return once.unionByName(first)
