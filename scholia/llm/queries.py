"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import ctph, decontaminate, exponion, lines, mixing, pieces, simhash, substrings, suffixes, token_counts, toxicity, warc, whitening
from scholia.llm.common import remainder


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_vocabulary() -> pieces.Vocabulary:
    import public_tokenizers

    return pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(load(spark, sf_dir, "documents"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(load(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(load(spark, sf_dir, "documents"), piece_vocabulary())


def op4_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edit_report(load(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.proximity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(5) != 0).__invert__().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "n_tokens", "best", "passages"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(load(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(load(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(load(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(load(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(load(spark, sf_dir, "pages"))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.report(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_context_mixing": op2_context_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_piecewise_hash": op4_piecewise_hash,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_exponion": op13_exponion,
    "proximity_matches": proximity_matches,
}

ORACLES = {
    "op5_decontamination": decontaminate.REPORT_SQL,
    "proximity_matches": decontaminate.PROXIMITY_SQL,
    "op6_suffix_dedup": suffixes.REPORT_SQL,
    "op8_substring_dedup": substrings.REPORT_SQL,
    "op9_line_dedup": lines.REPORT_SQL,
    "op12_warc": warc.REPORT_SQL,
    "op13_exponion": exponion.report_sql(),
}
