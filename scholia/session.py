"""The session this engine expects: UTC, adaptive plans, Arrow for the few Python steps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session; on a cluster leave master to spark-submit and size shuffle partitions to the data (about 128 MB each)."""
    builder = SparkSession.builder.appName("scholia")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


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


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; what is there goes when the program ends."""
    _SCRATCH.append((spark, f"{shared_dir(spark)}/scholia-{name}-{uuid.uuid4().hex}"))
    return _SCRATCH[-1][1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there: what reads it often computes it once, and lineage starts anew."""
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing is left to delete with
            return
