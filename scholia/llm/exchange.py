"""Questions that blocks of texts put to the whole corpus, answered by one shuffle there and one back.

A block is some megabytes of texts in one row. Each block sends its distinct keys with numbers of its own, dealt to
buckets by the keys; all that one bucket's keys were sent with meets in one task, which answers each message in its
own order; the answers join their block again. So statistics of any size serve texts without being broadcast. The
number of buckets follows the input, and a task holds one bucket at a time. A key as common as may be is sent once
a block at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import arrow_schema, column, save, save_by, session

#: Bytes of text in a block, and of the corpus for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
_U = np.uint64


def blocks(rows: DataFrame, columns: dict[str, str], text: str = "text", size: int = BLOCK_BYTES, made: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, ddl: str | None = None) -> DataFrame:
    """(block, an array for each column): the rows, some together, written to the shared folder. A longer text is a block of its own.
    made: what is written instead for each block, and ddl its columns; such a table lies in buckets by block."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, load = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            arrays = [table.column(c).combine_chunks() for c in names]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
            out = pa.RecordBatch.from_arrays([pa.array([base | k], pa.int64()), *lists], names=["block", *names])
            return made(out) if made else out

        for batch in batches:
            batch = batch.select(names)
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, n in enumerate(sizes.tolist()):
                if load and load + n > size:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield flush()
                    k, held, load, at = k + 1, [], 0, i
                load += n + 16
            held.append(batch.slice(at))
        if held and sum(b.num_rows for b in held):
            yield flush()

    kinds = ", ".join(["block long", *(f"{c} array<{t}>" for c, t in columns.items())])
    found = rows.select(*names).mapInArrow(run, ddl or kinds)
    return save_by(found, "blocks", "block") if made else save(found, "blocks")


def buckets_for(text_bytes: int, at_least: int = 2) -> int:
    return max(at_least, -(-text_bytes // BUCKET_BYTES))


def place(keys: np.ndarray, n: int) -> np.ndarray:
    """A key's bucket in the upper half, its low 32 bits in the lower: keys that agree there count as one."""
    return (((keys >> _U(32)) * _U(n)) & ~_U(0xFFFFFFFF)) | (keys & _U(0xFFFFFFFF))


def planes(x: np.ndarray) -> bytes:
    """Byte by byte of the numbers, so that equal high bytes lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(blob: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def messages(block: int, placed: np.ndarray, numbers: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (bucket, block, blob) of ascending placed keys and numbers that go with them."""
    kind = arrow_schema("bucket long, block long, blob binary")
    own, low = (placed >> _U(32)).astype(np.int64), (placed & _U(0xFFFFFFFF)).astype("<u4")
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    out: list[bytes] = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(own)] if len(own) else [], strict=True):
        out.append(b"".join([(b - a).to_bytes(8, "little"), planes(np.diff(low[a:b], prepend=np.uint32(0)).astype("<u4")), *(planes(x[a:b]) for x in numbers)]))
    return pa.RecordBatch.from_arrays([pa.array(own[cut]), pa.array(np.full(len(cut), block, np.int64)), pa.array(out, pa.binary())], schema=kind)


def opened(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for i, kind in enumerate(["<u4", *kinds]):
        x = from_planes(blob, kind, n, at)
        out.append(np.cumsum(x, dtype=np.uint32) if i == 0 else x)
        at += n * np.dtype(kind).itemsize
    return out


def by_bucket(batches: Iterator[pa.RecordBatch], fold: Callable[[object, bytes], object] | None = None) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows that come sorted by bucket, a bucket at a time. Those of a bucket below 0 are folded as they come, from None on, and one is left."""
    now, held = None, []
    for batch in batches:
        for bucket, block, blob in zip(column(batch, "bucket"), column(batch, "block"), column(batch, "blob"), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            if fold is not None and bucket < 0:
                held = [(block, fold(held[0][1] if held else None, blob))]
            else:
                held.append((block, blob))
    if held:
        yield now, held


def answered(held: DataFrame, ask: Callable[[dict], Iterator[pa.RecordBatch]], settle: Callable[[Iterator], Iterator[pa.RecordBatch]], name: str, n_buckets: int) -> DataFrame:
    """(bucket, block, blob): the answers, written. ask makes a block's messages, settle (bucket, messages) pairs into answers."""
    n = min(n_buckets, int(session(held).conf.get("spark.sql.shuffle.partitions")))
    columns = [c for c in held.columns]
    ddl = "bucket long, block long, blob binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask({c: batch.column(j)[i] for j, c in enumerate(columns)})

    sent = held.mapInArrow(send, ddl).repartition(n, "bucket").sortWithinPartitions("bucket")
    return save(sent.mapInArrow(lambda b: settle(by_bucket(b)), ddl), name)


def sums(kinds: list[str], answer: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> Callable[[Iterator], Iterator[pa.RecordBatch]]:
    """Settles buckets by adding up each key's numbers; answer makes what goes back for each key from (keys, totals)."""

    def settle(groups: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema("bucket long, block long, blob binary")
        for bucket, held in groups:
            parts = [opened(blob, kinds) for _, blob in held]
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = [np.bincount(at, np.concatenate([p[j + 1] for p in parts]), len(keys)) for j in range(len(kinds))]
            back = answer(keys, total)[at]
            ends = np.cumsum([len(p[0]) for p in parts]).tolist()
            for (block, _), a, b in zip(held, [0, *ends[:-1]], ends, strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [block], "blob": [planes(back[a:b])]}, schema=kind)

    return settle


def with_answers(held: DataFrame, *answers: DataFrame) -> DataFrame:
    """The blocks with the answers to each question: an array of blobs in the order of the buckets."""
    for k, found in enumerate(answers):
        lists = found.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "blob"))), lambda x: x["blob"]).alias(f"answers{k}"))
        held = held.join(lists, "block", "left")
    return held


def read(blobs: list[bytes] | None, kind: str) -> np.ndarray:
    """A question's answers, in the order of its ascending placed keys."""
    width = np.dtype(kind).itemsize
    return np.concatenate([from_planes(b, kind, len(b) // width) for b in blobs]) if blobs else np.empty(0, kind)
