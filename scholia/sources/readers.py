"""Sources and sinks: Parquet tables under fixed schemas, whole text files, binary documents, unit JSON, NDJSON out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.schemas import schema

#: Pages with fewer bytes of text than this are scans to be read by OCR.
LEAST_BYTES = 20


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table under its fixed schema; columns that files lack read as null."""
    return spark.read.schema(schema(name)).parquet(path)


def needs_ocr(text: Column) -> Column:
    return F.octet_length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_BYTES


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text, needs_ocr): each text or Markdown file as one page."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("page_no"), F.col("value").alias("text"))
    return t.withColumn("needs_ocr", needs_ocr(F.col("text")))


def documents(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, file_hash, page_no, text, needs_ocr): binary files through a function from a file's bytes to its pages' texts.
    A file that the function fails on gives one empty page to be read by OCR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("file_hash", pa.string()), ("page_no", pa.int32()), ("text", pa.string())])
        for batch in batches:
            rows = []
            for p, h, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    found = pages(data) or [""]
                except Exception:  # an unreadable document is a scan
                    found = [""]
                rows += [(p, h, i, t) for i, t in enumerate(found, 1)]
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(kind.names)}, schema=kind)

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_hash"), "content")
    return files.mapInArrow(run, "path string, file_hash string, page_no int, text string").withColumn("needs_ocr", needs_ocr(F.col("text")))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose file_hash no known document has."""
    return files.join(known.select("file_hash").distinct(), "file_hash", "left_anti")


def unit_rows(units: DataFrame, item: str) -> DataFrame:
    """Rows replayed from the JSON output of completed units (unit_id, status, output_json); item: the rows' DDL. Malformed output has none."""
    parsed = F.from_json("output_json", f"struct<items:array<struct<{item}>>>")
    return units.where("status = 'completed'").select("unit_id", F.explode(parsed["items"]).alias("row")).select("unit_id", "row.*")


def with_vectors(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(doc_id, vector): texts through an embedding function, `batch` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("vector", pa.list_(pa.float32()))])
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for a in range(0, len(ids), batch):
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a : a + batch], "vector": embed(texts[a : a + batch])}, schema=kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, vector array<float>")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)
