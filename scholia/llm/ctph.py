"""Context-triggered piecewise hashing.

A rolling hash over 7 bytes cuts a text wherever it hits the last residue of the block size; each chunk gives one
of 64 signs by its CRC-32. A fingerprint is "block size:signs:signs at twice the block size". The block size is
three times a power of two, so a cut at twice the size is one at the size too, and fingerprints whose sizes are
equal or one step apart compare at the size they share, by edit distance between their signs (replacing costs
two): 1 - distance / (sum of lengths). Signs without any run in common count as unlike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import column, session, small_batches, texts

#: Bytes under the rolling hash; the smallest block size; the signs aimed at, from half as many on.
ROLL, LEAST, AIM = 7, 3, 64
#: Signs in a row that two fingerprints must share.
COMMON = 4
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LOWEST = -(2**63)


def rolling(data: np.ndarray) -> np.ndarray:
    """A mixed 32-bit hash of the 7 bytes that end at each position (fewer at the start)."""
    h = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    power = 1
    for k in range(min(ROLL, len(data))):
        h[k:] += wide[: len(wide) - k] * np.uint32(power)
        power = power * 0x01000193 & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def fingerprint(data: bytes) -> str:
    """The fingerprint of all of data. Its signs number about 32 to 128, or fewer for a text of few bytes."""
    if not data:
        return f"{LEAST}::"
    h = rolling(np.frombuffer(data, np.uint8))
    size = LEAST
    while size * AIM < len(data):
        size *= 2
    cut = lambda s: np.flatnonzero(h % np.uint32(s) == s - 1)
    at = cut(size)
    while len(at) < AIM // 2 and size > LEAST:
        size //= 2
        at = cut(size)
    while len(at) > 2 * AIM:  # a text of few distinct contexts may be cut everywhere
        size *= 2
        at = cut(size)
    return f"{size}:{_signs(data, at)}:{_signs(data, cut(2 * size))}"


def _signs(data: bytes, at: np.ndarray) -> str:
    ends = (at + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    out, start = [], 0
    for end in ends:
        out.append(_SIGNS[zlib.crc32(data[start:end]) * 0x9E3779B1 >> 20 & 63])
        start = end
    return "".join(out)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    n = min(COMMON, len(a), len(b))
    if not n or not {a[i : i + n] for i in range(len(a) - n + 1)} & {b[i : i + n] for i in range(len(b) - n + 1)}:
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 where the block sizes are not compatible."""
    if x == y:
        return 1.0
    (s, a, aa), (t, b, bb) = x.split(":"), y.split(":")
    s, t = int(s), int(t)
    if s == t:
        return max(_alike(a, b), _alike(aa, bb))
    return _alike(aa, b) if 2 * s == t else _alike(a, bb) if s == 2 * t else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "fingerprint": [fingerprint((x or "").encode()) for x in column(batch, "text")]}, schema=pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]))

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, sentinel, doc_id, text) dealt by ranges of doc_id and sorted in descending order, where each range
    is followed by a copy, sentinel 1, of the row that comes next (after the last: the first).

    Range limits are quantiles of doc_id, as many as there are shuffle partitions; the largest id of each range
    is all that comes to the driver. Rows without an id come last; rows of one id follow by their texts.
    """
    spark = session(docs)
    rows = texts(docs)
    order = F.coalesce("doc_id", F.lit(_LOWEST))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    limits = sorted({int(x) for x in rows.select(order.cast("double").alias("o")).approxQuantile("o", [i / n for i in range(1, n)], 0.2 / n)})

    def bucket(ids: np.ndarray) -> np.ndarray:
        return len(limits) - np.searchsorted(np.array(limits, np.int64), ids, side="right")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for b in np.unique(k := bucket(x)).tolist():
                top[b] = max(int(x[k == b].max()), top.get(b, _LOWEST))
        yield pa.RecordBatch.from_pydict({"bucket": list(top), "top": list(top.values())}, schema=pa.schema([("bucket", pa.int64()), ("top", pa.int64())]))

    tops = rows.select(order.alias("o")).mapInArrow(ids, "bucket long, top long").groupBy("bucket").agg(F.max("top").alias("top")).orderBy("bucket").collect()
    before = {r["top"]: tops[i - 1]["bucket"] for i, r in enumerate(tops)}  # the first row of a range also closes the range before

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.array(sorted(before), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            body = [batch.column(1), batch.column(2)]
            make = lambda b, s, cols: pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(np.full(len(b), s), pa.int32()), *cols], names=["bucket", "sentinel", "doc_id", "text"])  # noqa: B023, E731
            yield make(bucket(x), 0, body)
            again = np.flatnonzero(np.isin(x, heads))
            if len(again):
                yield make(np.array([before[v] for v in x[again].tolist()], np.int64), 1, [c.take(pa.array(again)) for c in body])

    dealt = rows.select(order.alias("o"), "doc_id", "text").mapInArrow(deal, "bucket long, sentinel int, doc_id long, text string")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "sentinel", F.coalesce("doc_id", F.lit(_LOWEST)).desc(), "text")


def edit_report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document's, in descending order of doc_id; after the last comes the first. Null texts count as
    empty. Rows without an id come last, rows of one id in the order of their texts."""
    small_batches(session(docs))
    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def answer(doc, text: str, mark: str, following: str, next_mark: str) -> tuple:
        n = len(text) // 3
        edited = (text[: len(text) - n] + following[:n]).encode()
        edited_mark = fingerprint(edited)
        return doc, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text and fingerprint of a row whose next one hasn't come
        for batch in batches:
            out = []
            for b, s, doc, text in zip(*(column(batch, c) for c in ("bucket", "sentinel", "doc_id", "text")), strict=True):
                text = text or ""
                if s and (held is None or held[0] != b):
                    continue  # a second copy for the same end
                mark = fingerprint(text.encode())
                if held is not None and held[0] == b:
                    out.append(answer(held[1], held[2], held[3], text, mark))
                held = None if s else (b, doc, text, mark)
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in out] for j, k in enumerate(kind.names)}, schema=kind)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
