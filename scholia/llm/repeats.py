"""Repeated windows of a corpus, found through content-defined anchors. Shared by byte and word dedup.

A window is `length` consecutive units (bytes or words) of one document. Its anchor is the smallest hash among its
`gram`-unit strings, the leftmost of equals; equal windows have equal anchors, so windows that share an anchor
string are all that need comparing. Consecutive windows with one anchor form its stretch: the text from the first
window's start to the last one's end. A repeat is settled in two rounds.

1. Stretches. Each is one record under its anchor's hash. Equal stretches hold equal windows: where a stretch
   repeats, all its windows do. This settles the inside of long repeats at one record for some dozens of units.
2. Windows. Different stretches around one anchor may still share windows, next to where a long repeat ends. They
   can only if they agree in at least half of what a window holds besides its anchor, to the left or to the right.
   Those stretches, one of each kind, list their windows, and equal windows meet by their hash.

Records travel packed, some hundred thousand to a row, dealt by hash. Each task first settles what it can among
its own records and sends one of each kind on, so a passage that a third of the corpus holds sends a record for
each task at most. Stretches compare under two hashes of 64 bits (the anchor's and the whole stretch's), windows under
two with different multipliers, of 64 and 32 bits. The number of buckets follows the input, and a task holds one of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, column, save, session, texts

#: Units hashed at a time; records of one task settled at a time; bytes of text for each bucket.
BLOCK, FLUSH, BUCKET_BYTES = 1 << 20, 1_000_000, 16 << 20
_U = np.uint64
_B, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LAST = 2**63 - 1
_KIND = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_ANSWER = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("kind", pa.int32())])
#: What a row of an answer says: units lo..hi-1 go; windows from lo to hi need the second round.
GONE, ASK = 0, 1


@dataclass(frozen=True)
class Rule:
    """unit: "bytes" or "words". later: only a window that also starts earlier is repeated; else one that starts anywhere else."""

    unit: str
    length: int
    gram: int
    later: bool

    @property
    def half(self) -> int:
        return (self.length - self.gram + 1) // 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Hashes of any substring by doubling: a run of 2n units has a hash made of those of its halves, and a span of any length one made of
    the two runs of the largest power of two that cover it. Halves are mixed by shifts and products together, so that no sum or
    polynomial of units stands behind a hash; those collide on self-similar text, whatever their base."""

    def __init__(self, seed: int = _B) -> None:
        self.left, self.right = (_U(x) for x in (seed, seed * 0xA24BAED4963EE407 % 2**64 | 1))
        self.bytes = mix(np.arange(1, 257, dtype=_U) * _U(_B))

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x ^ (x >> _U(29))) * self.left + (y ^ (y >> _U(32))) * self.right

    def rungs(self, units: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """Hashes of all runs of 1, 2, 4, ... units, up to `longest`."""
        now, n = units, 1
        while True:
            yield now
            if 2 * n > longest or len(now) <= n:
                return
            now, n = self.join(now[:-n], now[n:]), 2 * n

    def span(self, rungs: list[np.ndarray] | Iterator[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the spans a to b - 1, none empty; rungs reach the longest."""
        out, sizes = np.empty(len(a), _U), b - a
        for k, rung in enumerate(rungs):
            at = np.flatnonzero((sizes >> k) == 1)
            if len(at):
                out[at] = mix(self.join(rung[a[at]], rung[b[at] - (1 << k)]) + sizes[at].astype(_U))
        return out

    def units(self, data: bytes, unit: str) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        if unit == "bytes":
            return self.bytes[raw]
        starts, ends = word_bounds(raw)
        out, i = [], 0
        while i < len(starts):  # some words at a time
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
            base = starts[i]
            own = self.bytes[raw[base : ends[j - 1]]]
            out.append(self.span(self.rungs(own, int((ends[i:j] - starts[i:j]).max())), starts[i:j] - base, ends[i:j] - base))
            i = j
        return mix(np.concatenate(out)) if out else np.empty(0, _U)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive numbers, by running minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(units: np.ndarray, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Parts whose windows are all windows, each once: (first window's start, units)."""
    for at in range(0, max(0, len(units) - rule.length + 1), BLOCK):
        yield at, units[at : at + BLOCK + rule.length - 1]


def stretches(hasher: Hasher, u: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """Of one part: anchor hash h, hash y of the stretch, first and last window lo and hi, and the hashes of the
    anchor with half a window's rest to the left and right (0 where the stretch is shorter)."""
    p = list(hasher.rungs(u, 2 * rule.length))
    i = np.arange(len(u) - rule.gram + 1)
    grams = hasher.span(p, i, i + rule.gram)
    low = _U(2 * BLOCK - 1)
    least = sliding_min((grams & ~low) | i.astype(_U), rule.length - rule.gram + 1) & low
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    t = least[new].astype(np.int64)
    lo, hi = new, np.concatenate((new[1:], [len(least)])) - 1
    end, half, gram = hi + rule.length, rule.half, rule.gram
    y = hasher.span(p, lo, end) + mix((t - lo).astype(_U) * _U(1 << 20) + (hi - lo).astype(_U))
    left, right = np.zeros(len(t), _U), np.zeros(len(t), _U)
    for side, start, fits in ((left, t - half, t - half >= lo), (right, t, t + gram + half <= end)):
        side[fits] = hasher.span(p, start[fits], start[fits] + gram + half) | _U(1)
    return {"h": grams[t], "y": y, "lo": lo, "hi": hi, "left": left.astype(np.uint32), "right": right.astype(np.uint32)}


_FIELDS = {"h": "<u8", "y": "<u8", "doc": "<i8", "tag": "<i8", "lo": "<u4", "wide": "<u4", "many": "u1", "left": "<u4", "right": "<u4"}


def pack(r: dict[str, np.ndarray], fields: list[str]) -> bytes:
    """Column by column and byte by byte of the numbers, so that equal high bytes lie together and compress."""
    n = len(r["h"])
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(r[f].astype(_FIELDS[f])).view(np.uint8).reshape(n, -1).T.tobytes() for f in fields)


def unpack(blobs: list[bytes], fields: list[str]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {f: [] for f in fields}
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for f in fields:
            kind = np.dtype(_FIELDS[f])
            x = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            parts[f].append(np.ascontiguousarray(x.T).view(kind).ravel())
            at += n * kind.itemsize
    return {f: np.concatenate(x) if x else np.empty(0, _FIELDS[f]) for f, x in parts.items()}


def settle(r: dict[str, np.ndarray], later: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Records sorted by (h, y, doc, tag, lo), which of them are first of their kind, and which are repeats: those
    after the first, or all of a kind of several."""
    order = np.lexsort((r["lo"], r["tag"], r["doc"], r["y"], r["h"]))
    r = {f: x[order] for f, x in r.items()}
    n = len(order)
    first = np.ones(n, bool)
    first[1:] = (r["h"][1:] != r["h"][:-1]) | (r["y"][1:] != r["y"][:-1])
    group = np.cumsum(first) - 1
    lead = np.flatnonzero(first)[group] if n else group
    if later:  # a row that is the first one's very twin is no later
        gone = (r["doc"] != r["doc"][lead]) | (r["tag"] != r["tag"][lead]) | (r["lo"] != r["lo"][lead])
    else:
        many = np.bincount(group, weights=1 + r["many"].astype(float)) > 1 if n else np.empty(0, bool)
        gone = many[group]
    return r, first, gone


def answers(r: dict[str, np.ndarray], pick: np.ndarray, kind: int, length: int) -> pa.RecordBatch:
    lo = r["lo"][pick].astype(np.int64)
    hi = lo + r["wide"][pick].astype(np.int64)
    if kind == GONE:  # windows lo..hi cover units lo..hi + length - 1; join what overlaps or touches
        doc, tag, hi = r["doc"][pick], r["tag"][pick], hi + length
        order = np.lexsort((lo, tag, doc))
        doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
        if len(lo):
            cut = np.ones(len(lo), bool)
            same = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])
            row = np.concatenate(([0], np.cumsum(~same)))
            reach = np.maximum.accumulate(hi + row * (1 << 40)) - row * (1 << 40)
            cut[1:] = ~same | (lo[1:] > reach[:-1])
            at = np.flatnonzero(cut)
            last = np.concatenate((at[1:], [len(lo)])) - 1
            doc, tag, lo, hi = doc[at], tag[at], lo[at], reach[last]
    else:
        doc, tag = r["doc"][pick], r["tag"][pick]
    return pa.RecordBatch.from_pydict({"doc": doc, "tag": tag, "lo": lo, "hi": hi, "kind": np.full(len(lo), kind, np.int32)}, schema=_ANSWER)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ANSWER) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Sender:
    """Gathers one task's records, settles them among themselves, and deals what is left by hash."""

    def __init__(self, fields: list[str], n: int, rule: Rule) -> None:
        self.fields, self.n, self.rule, self.parts, self.size = fields, n, rule, [], 0

    def add(self, r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(r)
        self.size += len(r["h"])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        r, first, gone = settle({f: np.concatenate([p[f] for p in self.parts]) for f in self.parts[0]}, self.rule.later)
        self.parts, self.size = [], 0
        r["many"] = gone
        known = gone & ~first  # the first of several is answered where all its kind meet
        out: list[tuple] = []
        if known.any():
            out.append((int(r["h"][known][0] % _U(self.n)), 1, _ipc(answers(r, known, GONE, self.rule.length))))
        sent = {f: r[f][first] for f in self.fields}
        bucket = (mix(sent["h"]) % _U(self.n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.n + 1))
        for b in np.flatnonzero(np.diff(at)).tolist():
            pick = order[at[b] : at[b + 1]]
            out.append((b, 0, pack({f: x[pick] for f, x in sent.items()}, self.fields)))
        yield pa.RecordBatch.from_pydict({k: [x[j] for x in out] for j, k in enumerate(_KIND.names)}, schema=_KIND)


def _shared(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which records have a side, and have it in common with another record of the same anchor."""
    _, at, n = np.unique(mix(h + mix(side.astype(_U))), return_inverse=True, return_counts=True)
    return (side > 0) & (n[at] > 1)


def _met(batches: Iterator[pa.RecordBatch], fields: list[str], rule: Rule, ask: bool) -> Iterator[pa.RecordBatch]:
    """All records of some hashes, which come bucket by bucket: answers, and with ask the stretches whose windows are to be compared."""
    now, blobs = None, []

    def met() -> Iterator[pa.RecordBatch]:
        r, first, gone = settle(unpack(blobs, fields), rule.later)
        yield answers(r, gone, GONE, rule.length)
        if ask:
            kinds = {f: x[first] for f, x in r.items()}
            yield answers(kinds, _shared(kinds["h"], kinds["left"]) | _shared(kinds["h"], kinds["right"]), ASK, rule.length)

    for batch in batches:
        for bucket, kind, blob in zip(column(batch, "bucket"), column(batch, "kind"), column(batch, "blob"), strict=True):
            if kind:
                yield from pa.ipc.open_stream(blob)
                continue
            if bucket != now and blobs:
                yield from met()
                blobs.clear()
            now = bucket
            blobs.append(blob)
    if blobs:
        yield from met()


_DDL = "doc long, tag long, lo long, hi long, kind int"


def tagged(docs: DataFrame) -> DataFrame:
    """(doc, tag, doc_id, text): rows without an id come after all others; rows that share an id, or have none, are told
    apart, and ordered, by a hash of their texts (tag), which is 0 for all others."""
    rows = texts(docs)
    key = F.coalesce("doc_id", F.lit(_LAST))
    twice = rows.select(key.alias("doc")).groupBy("doc").count().where(f"count > 1 or doc = {_LAST}").select("doc")
    rows = rows.select(key.alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if twice.isEmpty():
        return rows.withColumn("tag", F.lit(0).cast("long"))
    return rows.join(twice.withColumn("again", F.lit(True)), "doc", "left").withColumn("tag", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0))).drop("again")


def repeated(rows: DataFrame, rule: Rule) -> DataFrame:
    """(doc, tag, spans): the ranges of units (array of lo, hi) that repeated windows cover, of tagged() rows."""
    parts = max(2, int(session(rows).conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * parts, -(-size // BUCKET_BYTES))
    fields = ["h", "y", "doc", "tag", "lo", "wide", "many", "left", "right"]

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sender = Hasher(), Sender(fields, n, rule)
        for batch in batches:
            for doc, tag, data in zip(column(batch, "doc"), column(batch, "tag"), as_bytes(batch), strict=True):
                for at, u in blocks(hasher.units(data, rule.unit), rule):
                    s = stretches(hasher, u, rule)
                    k = len(s["h"])
                    yield from sender.add({"h": s["h"], "y": s["y"], "doc": np.full(k, doc, np.int64), "tag": np.full(k, tag, np.int64), "lo": s["lo"] + at, "wide": s["hi"] - s["lo"], "many": np.zeros(k, bool), "left": s["left"], "right": s["right"]})
        yield from sender.flush()

    ddl = "bucket long, kind int, blob binary"
    sent = rows.select("doc", "tag", "text").mapInArrow(first_round, ddl).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = save(sent.mapInArrow(lambda b: _met(b, fields, rule, True), _DDL), "stretches")

    slim = ["h", "y", "doc", "tag", "lo", "wide", "many"]
    asked = found.where(f"kind = {ASK}").groupBy("doc", "tag").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other, sender = Hasher(), Hasher(_OTHER), Sender(slim, n, rule)
        for batch in batches:
            for doc, tag, los, his, data in zip(*(column(batch, c) for c in ("doc", "tag", "los", "his")), as_bytes(batch), strict=True):
                los, his = np.unique(np.array([los, his], np.int64), axis=1)
                for at, u in blocks(hasher.units(data, rule.unit), rule):
                    own = (los >= at) & (los < at + BLOCK)
                    if own.any():
                        size = (his - los + 1)[own]
                        start = np.repeat(los[own] - at - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                        h, y = (x.span(x.rungs(u, rule.length), start, start + rule.length) for x in (hasher, other))
                        k = len(h)
                        yield from sender.add({"h": h, "y": y & _U(0xFFFFFFFF), "doc": np.full(k, doc, np.int64), "tag": np.full(k, tag, np.int64), "lo": start + at, "wide": np.zeros(k, np.uint32), "many": np.zeros(k, bool)})
        yield from sender.flush()

    windows = rows.join(asked, ["doc", "tag"]).select("doc", "tag", "los", "his", "text").mapInArrow(second_round, ddl).repartition(parts, "bucket").sortWithinPartitions("bucket")
    more = windows.mapInArrow(lambda b: _met(b, slim, rule, False), _DDL)
    every = found.where(f"kind = {GONE}").unionByName(more)
    return every.groupBy("doc", "tag").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))


def covered(n: int, los: list[int] | None, his: list[int] | None) -> np.ndarray:
    """Which of n units lie in some span."""
    step = np.zeros(n + 1, np.int64)
    if los:
        np.add.at(step, np.array(los), 1)
        np.add.at(step, np.array(his), -1)
    return np.cumsum(step[:-1]) > 0


def with_spans(rows: DataFrame, rule: Rule) -> DataFrame:
    """tagged() rows with los and his, null where nothing is repeated."""
    return rows.join(repeated(rows, rule), ["doc", "tag"], "left")
