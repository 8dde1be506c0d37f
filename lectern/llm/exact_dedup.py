"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: White space runs, without the lone spaces that normalising leaves as they are.
RUNS_OF_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, the input partition it came from (its run) and three fingerprints of the normalised text."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_of(text_col), RUNS_OF_SPACE, " ").alias("t"))
    return text.select(
        "doc_id",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def merge_runs(runs: DataFrame, bits: int = 4) -> DataFrame:
    """One row (digest, n_bytes, check, keep_id, group_size) for each distinct text, by a tree of merges of sorted runs.

    Each input partition is a run: it is sorted by digest and folded to one row for
    each of its texts. In every round `2**bits` runs with neighbouring numbers exchange
    their digests and are merged to one sorted run, until one run is left, so there
    is an exchange for each level of the tree, as many as the logarithm of the number of
    input partitions to the base `2**bits`. A run of any level is spread over many tasks by its
    digests. A digest counts as equal only if length and a second, independent
    hash agree too, and the smallest id and the summed count stay, so every
    round's survivor is verified.

    A round's rows go by the digest and the numbers that their run will have in the rounds to
    come, the last round's first: so they lie in the order that the next round's folding before
    its exchange asks for, and only the merged side is sorted.
    """
    key = ["digest", "n_bytes", "check"]
    top = runs.agg(F.max("run")).first()[0] or 0
    # a struct has no place in a hash aggregate's row, so Spark merges sorted rows
    fold = (F.min(F.struct(F.isnull("keep_id").alias("none"), "keep_id")).alias("best"), F.sum("group_size").alias("group_size"))

    def merged(level: DataFrame, *numbers: str) -> DataFrame:
        return level.groupBy(*key, *numbers).agg(*fold).select(*key, *numbers, F.col("best.keep_id").alias("keep_id"), "group_size")

    depth = 1
    while top >> bits * depth:
        depth += 1
    # the number of the run that a row is in after each round but the last, the last of these first
    numbers = {f"run{k}": F.shiftright("run", bits * k) for k in range(depth - 1, 0, -1)}
    level = runs.select(*key, *(n.alias(k) for k, n in numbers.items()), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    names = list(numbers)
    while names:
        level = merged(level, *names)
        names.pop()
    return merged(level)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of ASCII white space
    is replaced by one space; a null text is the empty text. The row with the
    smallest id of its group stays. Rows repeated with the same id share one
    decision; a null id stays only if its group has no other id. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    runs = cut(digest_runs(docs, id_col, text_col))
    merged = merge_runs(runs, bits)
    return runs.join(merged, ["digest", "n_bytes", "check"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
