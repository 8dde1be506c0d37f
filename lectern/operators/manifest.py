"""Download manifests and evaluation against curated pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def wanted_ids(benchmark: DataFrame) -> DataFrame:
    """The distinct ids (pmid) of the curated rows that have one."""
    return benchmark.where("pmid IS NOT NULL").select("pmid").distinct()


def still_to_fetch(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """The wanted ids that have not landed."""
    return wanted.select("pmid").distinct().join(landed.select("pmid"), "pmid", "left_anti")


def fetch_counts(wanted: DataFrame, landed: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """One row: wanted, existing, to_do, ok, failed."""
    ids = wanted.select("pmid").distinct().join(landed.select("pmid").distinct().withColumn("here", F.lit(True)), "pmid", "left")
    own = ids.agg(F.count("*").alias("wanted"), F.count("here").alias("existing"), (F.count("*") - F.count("here")).alias("to_do"))
    said = fetch_log.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return own.join(said)


def failed_ids(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.where(~F.col("ok")).select("pmid")


def profile(benchmark: DataFrame) -> DataFrame:
    """Pairs, distinct papers and patients by split and criterion; `patients` is read as a number where it is one."""
    return benchmark.groupBy("label", "criterion").agg(F.count("*").alias("pairs"), F.count_distinct("pmid").alias("papers"), F.sum(F.col("patients").try_cast("int")).alias("patients"))


def evaluate(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold (pmid, variant, label, in_trans) with hit and trans_hit by predicted (pmid, variant, partners).

    hit: the pair was predicted; trans_hit: null where the curated row names no
    partner, else whether any of its alternatives is among the predicted ones.
    """
    known = gold.join(predicted.select("pmid", "variant", "partners").withColumn("__hit", F.lit(True)), ["pmid", "variant"], "left")
    truth = tx.alternatives(F.col("in_trans"))
    overlap = F.coalesce(F.arrays_overlap(truth, F.coalesce("partners", F.array().cast("array<string>"))), F.lit(False))
    return known.select("pmid", "variant", "label", F.coalesce("__hit", F.lit(False)).alias("hit"), F.when(truth.isNotNull(), overlap).alias("trans_hit"))


def scores(evaluated: DataFrame) -> DataFrame:
    """By split: pairs, hits, pairs with partners, partners found; the rates follow from them."""
    return evaluated.groupBy("label").agg(
        F.count("*").alias("pairs"), F.count_if("hit").alias("hits"), F.count("trans_hit").alias("with_partners"), F.count_if("trans_hit").alias("partners_found"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.col("trans_hit").cast("int")), 6).alias("in_trans_recall"),
    )
