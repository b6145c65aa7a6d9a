"""Helpers shared by the operators of this subpackage: shared folders, Arrow batches, components."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch, and bytes from which on it takes no more. Texts can be long, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20

_SCRATCH: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where driver and tasks are one process (as in tests) is one of our own set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="scholia-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of the shared folder and read it back: later work starts from files any executor can read."""
    spark = session(df)
    path = f"{shared_dir(spark)}/scholia-{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _SCRATCH.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def save_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """save() in as many buckets of a key as a shuffle has partitions: a join by that key moves only its other side."""
    spark = session(df)
    path, table = f"{shared_dir(spark)}/scholia-{name}-{uuid.uuid4().hex}", f"scholia_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.mode("error").format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    _SCRATCH.append((spark, path))
    _TABLES.append((spark, table))
    out = spark.table(table)
    out._scratch = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table that save() wrote, once nothing reads it any more."""
    if path := getattr(df, "_scratch", None):
        _delete(session(df), path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, table in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # as below
            break
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing is left to delete with
            return


class Shared:
    """A value of bounded size for all tasks. Its classes travel with it, so executors need no copy of the repository."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._held, self._got = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"_held": self._held, "_got": None}

    @property
    def value(self):
        if self._got is None:
            self._got = pickle.loads(self._held.value)
        return self._got


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a Python worker holds few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Here, files of a shuffle go once its query has ended: later steps start from saved tables. What is returned keeps its own."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (as long) and the text; whatever else the table holds is left behind."""
    small_batches(session(docs))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in any case: the given ones, underscores before them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, name type"."""
    return pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ddl.split(",")])


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """mapInArrow whose function takes a batch and returns the columns of the answer by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(make(batch), schema=want)

    return df.mapInArrow(run, schema)


def remainder(mod: int, key: str = "doc_id"):
    """crc32 of the key as text, modulo mod; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    edges: (a, b) long. Returns (node, component) for every node but the smallest of its component. Alternates large-star and small-star steps, which keep
    the graph's size bounded by its edges and need a number of rounds that grows with the logarithm of the
    graph's width. Each round is written to the shared folder, so lineage stays short. Rounds end when a
    round leaves the set of edges unchanged (its count and an order-free checksum).
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = save(now, "edges")
    mark = _checksum(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.select("a", "b").unionAll(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour moves to the smallest neighbour
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, moves to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")
        )
        new = save(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), "edges")
        was, mark = mark, _checksum(new)
        drop_saved(now)
        now = new
        if was == mark:
            break
    else:
        raise RuntimeError(f"the components still change after {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
