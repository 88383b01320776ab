"""The corpus pipeline: documents in; filtered, deduplicated, mixed and encoded documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import chunk_bpe, line_dedup, mixing, ngram_join, quality
from parchmint.llm.common import saved, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 0 go. It learns from labels, never from held-out rows."""
    model = quality.learned(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all documents but one; n_chars follows. A text that loses all lines is empty."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    lost = F.col("n_dropped") > 0
    text = F.when(lost, F.coalesce("kept_text", F.lit(""))).otherwise(F.col("text"))
    n_chars = F.when(lost, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut with its first words, and n_chars of them."""
    out = mixing.materialized(docs.select(*COLUMNS))
    n_chars = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number, and the text they decode to."""
    out = chunk_bpe.encode_decode(docs.select(*COLUMNS))
    return out.select(*COLUMNS, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each but the last written to the shared folder and read again."""
    path = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: a trained classifier and a tokenizer are beyond it. tests/llm holds brute-force versions of every stage.
ORACLE_SQL: str | None = None
