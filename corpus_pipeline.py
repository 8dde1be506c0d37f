"""A training-data pipeline over documents: five operators in a row, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import shared_dir, table, written_order
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.mixing import mixed_order
from lectern.llm.ngram_join import drop_similar
from lectern.llm.packing import pack
from lectern.llm.queries import word_bpe
from lectern.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters found in three documents stay in the last of them only; n_chars follows the new text."""
    cleaned = dedup_lines(docs, copies=3, least=20).drop("n_lines", "n_dropped")
    if "n_chars" in cleaned.columns:
        cleaned = cleaned.selectExpr(*(f"CAST(length(text) AS BIGINT) AS {c}" if c == "n_chars" else f"`{c}`" for c in cleaned.columns))
    return cleaned


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a five-word shingle similarity of 0.8 connects stays."""
    return drop_similar(docs, n=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a Pfair schedule of equal source weights; the packing restores this order from the files."""
    return mixed_order(docs, block=16)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4096 tokens, which follow the order in which docs was written."""
    return pack(docs, word_bpe(), 4096, order=written_order(docs))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The first and the last stage are a classifier and a packing that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
