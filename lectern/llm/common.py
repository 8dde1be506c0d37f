"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: ASCII white space: the space and 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The text bytes that a Python task turns into arrays at once.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Where tables are cut: in the folder that all executors share."""
    return f"{shared_folder(spark)}/lectern"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: computed once, and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_told(df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
    """cut(), and aggregates over the rows, taken while they are written."""
    told = Observation()
    return cut(df.observe(told, *(c.alias(k) for k, c in what.items()))), told.get


def written_order(files: DataFrame) -> list[Column]:
    """Columns that order the rows of a table read from Spark's files as they were written: by the writing task's number, then by the row in the file."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long").alias("task"), name.alias("file"), F.col("_metadata.row_index").alias("at")]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def remainder(name: str, by: int) -> Column:
    """crc32 of the id as text modulo `by`; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(by)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What this Python worker holds under a name from task to task, until it comes to work that does not ask for it."""
    if name not in _HELD:
        let_go()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Drop what is held and give freed memory back: workers live on, and their memory is the executor's."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, holds: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's texts fill about `most` bytes, or hold one row.

    A worker lets go of what it held for other work before the first batch, and
    of freed memory after the last.
    """
    if holds not in _HELD:
        let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.slice(int(a), int(b - a))
    if not _HELD:
        let_go()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words (runs of anything but ASCII white space) of many texts, null as empty.

    A code for each word in turn, the words that the codes stand for, and the
    bounds of each text's words among the codes.
    """
    split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    codes, bounds = np.asarray(coded.indices), np.asarray(split.offsets).astype(np.int64)
    empty = np.asarray(pa.compute.equal(coded.dictionary, ""))  # white space at the ends leaves an empty word
    if empty.any():
        keep = ~empty[codes]
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    return codes, coded.dictionary, bounds


def word_names(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit name of each word, a function of the word and the seed alone."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays, one function for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Arrays that are summed in one group.
FOLD = 64


def summed(pieces: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """The sums of the tasks' arrays, by part, of pieces (part, task, data): in a tree, FOLD arrays in a group at most, then one for each part to the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, dtype) for x in table.column("data").to_pylist()], axis=0)
        return pa.table({"part": table.column("part")[:1], "task": pa.array([table.column("task")[0].as_py() // FOLD], pa.int32()), "data": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    tasks = (pieces.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        pieces, tasks = cut(pieces.groupBy("part", F.expr(f"task div {FOLD}")).applyInArrow(add, "part int, task int, data binary")), -(-tasks // FOLD)
    return {r["part"]: np.frombuffer(r["data"], dtype) for r in pieces.select("part", "data").collect()}


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of edges (a, b): component is the smallest id reachable.

    Alternating large-star and small-star rounds; every round is written to the
    shared folder, and the rounds end when a round changes no edge. The edges
    of an id with many partners meet only as partial minimums and as skewed
    joins, which Spark splits.
    """

    def told(rows: DataFrame) -> tuple[DataFrame, dict]:
        return cut_told(rows, n=F.count(F.lit(1)), total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))

    pairs, state = told(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state["n"]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs, now = told(small.select("e.*").where("u <> v").distinct())
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
