"""Reference files, status logs and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..operators.manifest import failed_ids
from ..operators.tasks import parse_status_log

# The columns of a curated benchmark row and our names for them.
BENCHMARK = {
    "ClinGen ID": "clingen_id",
    "Variant Name": "variant",
    "Condition": "condition",
    "Criterion": "criterion",
    "Raw Comment": "comment",
    "PMID": "pmid",
    "Number of Patients": "patients",
    "In trans Variants": "in_trans",
    "labels": "label",
}
#: Folders that papers are spread over, by id.
PAPER_BUCKETS = 256


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Curated pairs from a JSON array, all as strings."""
    schema = ", ".join(f"`{c}` string" for c in BENCHMARK)
    return spark.read.schema(schema).json(path, multiLine=True).select(*(F.col(f"`{c}`").alias(n) for c, n in BENCHMARK.items()))


def read_residues(spark: SparkSession, path: str) -> DataFrame:
    """(ord, long3, short1) of a file with two columns, in its order."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"\S\s+\S"))).alias("ord", "line"))
    return lines.select("ord", F.regexp_extract("line", r"(\S+)\s+(\S+)", 1).alias("long3"), F.regexp_extract("line", r"(\S+)\s+(\S+)", 2).alias("short1"))


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed task rows of a log with one response on each line."""
    return parse_status_log(spark.read.text(path).select(F.col("value").alias("body")))


def write_failed_ids(fetch_log: DataFrame, path: str) -> None:
    failed_ids(fetch_log).write.mode("overwrite").json(path)


def land_papers(papers: DataFrame, path: str, key: str, ingest: str) -> None:
    """Add to the table at path the papers whose key is not there yet, in folders by a hash of the key and by `ingest`.

    ingest names this addition: done again under the same name, it replaces
    itself. Only folders that the papers' keys fall in are looked at. Of several papers of one key
    the one with the least other columns lands; those without a key don't.
    """
    spark, bucket = papers.sparkSession, f"{key}_bucket"
    others = [f.name for f in papers.schema if f.name != key]
    ordered = [f.name for f in papers.schema if f.name != key and not isinstance(f.dataType, MapType | VariantType)]
    rows = papers.where(F.col(key).isNotNull())
    if others:
        rows = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*ordered) if ordered else F.lit(0)).alias("rest")).select(key, "rest.*").select(*papers.columns)
    else:
        rows = rows.distinct()
    one = rows.withColumn(bucket, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PAPER_BUCKETS)).cast("int")).withColumn("ingest", F.lit(ingest))
    one.limit(0).write.mode("append").parquet(path)  # the first time, the table is there but empty
    touched = [r[0] for r in one.select(bucket).distinct().collect()]  # at most PAPER_BUCKETS
    there = spark.read.schema(one.schema).parquet(path).where(F.col(bucket).isin(touched) & (F.col("ingest") != ingest)).select(key)
    one.join(there, key, "left_anti").select(*one.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket, "ingest").parquet(path)


def write_papers(papers: DataFrame, path: str) -> None:
    """Add papers (pmid, body) that are not there yet; running it again adds nothing. See land_papers()."""
    land_papers(papers, path, "pmid", uuid.uuid4().hex)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").parquet(path)
