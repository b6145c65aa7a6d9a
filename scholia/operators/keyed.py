"""Tables that batches update by key: Parquet in buckets of the key, of which a batch reads and rewrites only those it touches.

Spark's dynamic partition overwrite replaces whole buckets. Each row of a bucket says which batch wrote it last, so a batch
that comes again, as a stream's does after a failure, finds the buckets that it had done and leaves them alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import stored

C = F.col
#: Buckets of a table; a number for its life. About a hundred MB each is well.
BUCKETS = 64


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows as they are now, with bucket and batch; none if it hasn't been written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch long, bucket int")
    return spark.read.schema(f"{schema}, batch long, bucket int").parquet(path)


def apply(path: str, schema: str, rows: DataFrame, batch: int, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge a batch into the table at path (columns as in schema). merge(old, new) gives the new rows of the keys of both; old are the rows of the
    buckets that new touches, so each of old's rows must come out again. Batches are numbered upwards."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = stored(rows.withColumn("bucket", bucket), "batch")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
    old = read(spark, path, schema).where(C("bucket").isin(touched))
    done = [r["bucket"] for r in old.groupBy("bucket").agg(F.max("batch").alias("b")).where(C("b") >= batch).collect()] if touched else []
    left = [b for b in touched if b not in done]
    if not left:
        return
    mine = lambda d: d.where(C("bucket").isin(left)).drop("bucket", "batch")
    out = stored(merge(mine(old), mine(new)).withColumn("batch", F.lit(batch).cast("long")).withColumn("bucket", bucket), "merged")  # what is read can't be overwritten
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def follow(stream: DataFrame, path: str, checkpoint: str, schema: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Apply what a stream has now, batch by batch; called again with the same checkpoint it goes on."""
    act = lambda rows, n: apply(path, schema, rows, n, keys, merge, buckets)
    stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
