"""Papers picked up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.papers import named
from ..sources.reference import land_papers


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (paper_id, path, body) with each new file under path."""
    files = spark.readStream.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return named(files)


def ingest_new_papers(papers: DataFrame, key: str, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Add the papers of a stream whose key has not landed yet to the table at target, whoever landed it and when.

    The stream keeps no state of its own: each micro-batch looks at the landed keys
    in the folders that its own keys fall in. It lands under the stream's id and its number,
    so one that is repeated replaces itself. See land_papers().
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        land_papers(batch, target, key, f"{stream}-{number}")

    return papers.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(land).start()
