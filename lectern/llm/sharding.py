"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_of

GROUP = ["size", "text_crc32", "text_hash"]


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """The index along the Hilbert curve of integer points (rows of coords, `bits` bits each)."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the highest bit down
        for i in range(n):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def string_cells(df: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, cell) of each string in a column, null as empty: below 2**bits, by the share of rows whose strings sort before it."""
    counts = df.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    # the values are as many as the column has; sums run inside the partitions of a sort and over their totals
    run = cut(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    sums = run.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ahead, total = [], 0
    for r in sums:
        ahead.append((r["part"], total))
        total += r["n"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[int, int] = {}
        for batch in batches:
            n, part = (batch.column(c).to_numpy() for c in ("n", "part"))
            start = np.zeros(len(n), np.int64)
            for p in np.unique(part).tolist():
                own = part == p
                start[own] = before.get(p, 0) + np.cumsum(n[own]) - n[own]
                before[p] = before.get(p, 0) + int(n[own].sum())
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("part"), pa.array(start)], ["value", "part", "start"])

    offsets = F.broadcast(df.sparkSession.createDataFrame(ahead, "part int, ahead long"))
    started = run.repartition("part").sortWithinPartitions("part", "value").mapInArrow(summed, "value string, part int, start long")
    return cut(started.join(offsets, "part").select("value", F.expr(f"CAST(((ahead + start) * {2**bits}) div {max(1, total)} AS INT)").alias("cell")))


def quantised(df: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """df with each dimension as an integer below 2**bits, cut at its approximate quantiles over all rows."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(*(F.percentile_approx(c, shares, 2000).alias(k) for k, c in dims.items())).first()
    for k, c in dims.items():
        bounds = F.array(*(F.lit(v).cast("long") for v in sorted(set(cuts[k] or []))))
        df = df.withColumn(k, F.size(F.filter(bounds, lambda b, c=c: b <= c)))
    return df


def along_curve(names: list[str], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*(F.col(n) for n in names))


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve, shard, slot; shards hold row counts at most one apart.

    Language, source and size are quantised and mapped to one Hilbert index; the
    rows are sorted by index, then text, then id, and the sorted run is cut into
    `shards` runs of equal row counts, so that each shard covers a small range of
    every dimension. Equal texts take the place of their group's smallest values
    and therefore stand together; a group is divided only where a shard ends. A
    null text has no bytes, size 8 and the checksum 0; null metadata sorts
    first. Repeated rows each get their own slot. An empty table gives an empty
    result. Other columns are not read.
    """
    # what is joined below is slim: texts are read once, for their size and hashes
    slim = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text_of()) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text_of().cast("binary")).alias("text_crc32"),
            F.xxhash64(text_of()).alias("text_hash"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        )
    )
    named = slim
    for c in ("lang", "source"):
        named = named.join(string_cells(slim, c, bits).select(F.col("value").alias(c), F.col("cell").alias(f"{c}_cell")), c)
    base = cut(named.select("doc_id", *GROUP, "lang_cell", "source_cell"))
    groups = base.groupBy(*GROUP).agg(F.min("lang_cell").alias("lang_cell"), F.min("source_cell").alias("source_cell"), F.count("*").alias("n"))
    groups = quantised(groups, {"size_cell": F.col("size")}, bits)
    groups = cut(groups.withColumn("curve", along_curve(["lang_cell", "source_cell", "size_cell"], bits)).select(*GROUP, "curve"))
    order = ["curve", "text_hash", "doc_id"]
    placed = base.select("doc_id", *GROUP).join(groups, GROUP)
    run = cut(
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row for each partition of the sort: as many as the cluster has tasks, whatever the rows
    counts = run.groupBy("part").agg(F.count("*").alias("n"))
    ahead = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return (
        run.join(F.broadcast(ahead), "part")
        .withColumn("place", F.col("ahead") + F.col("i"))
        .withColumn("shard", F.expr(f"(place * {shards}) div total"))
        .withColumn("slot", F.col("place") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write docs as one folder for each shard, in slot order; ids must be unique."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
