"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

BLANK = b" \t\n\v\f\r"
LINE = ["h1", "h2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The line's hash, or None for a key of fewer than `least` code points."""
    key = line.strip(BLANK).lower()  # of bytes: only A-Z change
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def document_lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h1, h2): each distinct key of each document, as a 128-bit hash."""
    id_type = docs.schema["doc_id"].dataType

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, at = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                own = {k for k in (line_key(x, least) for x in (text or b"").split(b"\n")) if k}
                found += own
                at += [i] * len(own)
            halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", *LINE])

    return docs.select("doc_id", "text").mapInArrow(keys, T.StructType([T.StructField("doc_id", id_type), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def merged(rows: DataFrame) -> DataFrame:
    """Runs merged to one row (h1, h2, n, keeper) for each key."""
    return rows.groupBy(*LINE).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


class LineRuns:
    """Levels of sorted runs (h1, h2, n, keeper): in how many documents a line key was seen and the largest id holding it.

    add() brings a new batch of documents: its own run is merge-anti-joined
    with the settled keys of the runs (those seen `copies` times with a keeper
    that the batch does not exceed, to which the batch can add nothing), and the
    rest becomes a run of level 0. As soon as a level holds `fanin` runs, they are
    compacted to one run of the next level. Batches may come in any order; in
    descending order of ids most of the batch is settled.
    """

    def __init__(self, copies: int = 3, least: int = 20, fanin: int = 4):
        self.copies, self.least, self.fanin = copies, least, fanin
        self.levels: list[list[DataFrame]] = [[]]

    def add(self, docs: DataFrame) -> None:
        one = document_lines(docs, self.least).select(*LINE, F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("keeper"))
        run = merged(one)
        for level in self.levels:
            for old in level:
                known = old.where(F.col("n") >= self.copies).select(*LINE, F.col("keeper").alias("best"))
                same = "new.h1 = old.h1 AND new.h2 = old.h2 AND (new.keeper IS NULL OR new.keeper <= old.best)"
                run = run.alias("new").join(known.alias("old"), F.expr(same), "left_anti")
        self._push(0, run)

    def _push(self, at: int, run: DataFrame) -> None:
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at].append(cut(run.sortWithinPartitions(*LINE)))
        if len(self.levels[at]) == self.fanin:
            rows, self.levels[at] = self.levels[at], []
            union = rows[0]
            for other in rows[1:]:
                union = union.union(other)
            self._push(at + 1, merged(union))

    def settled(self) -> DataFrame | None:
        """(h1, h2, keeper) of the keys found in at least `copies` documents; None if no batch came."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        union = runs[0]
        for other in runs[1:]:
            union = union.union(other)
        return (union if len(runs) == 1 else merged(union)).where(F.col("n") >= self.copies).select(*LINE, "keeper")


def id_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """docs cut at approximate quantiles of the id, the largest ids first; null ids come last. Ids that are no numbers are dealt out by a hash."""
    if not isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        return [docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(batches)) == i) for i in range(batches)]
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []), reverse=True)
    out, above = [], None
    for b in [*bounds, None]:
        ok = F.lit(True) if b is None else F.col("doc_id") > F.lit(b)
        if above is not None:
            ok = ok & (F.col("doc_id") <= F.lit(above))
        out.append(docs.where(ok if above is None or b is not None else ok | F.col("doc_id").isNull()))
        above = b
    return out


def dedup_lines(docs: DataFrame, copies: int = 3, least: int = 20, batches: int = 4, fanin: int = 4) -> DataFrame:
    """docs with the cleaned text and two more columns, n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased. Keys of at least `least` code points found in at least
    `copies` documents lose all their lines but those in the largest id holding
    it. A null or empty text is one empty line and becomes the empty text. Rows
    count as documents; rows repeated with one id share its decisions, and a
    null id is smaller than any other. Ids are of any type that has an order. An empty table gives an empty result.
    Other columns pass unchanged, under any names; n_lines and n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    runs = LineRuns(copies, least, fanin)
    for part in id_batches(docs, batches):
        runs.add(part)
    keys = cut(runs.settled())
    lines = document_lines(docs, least)
    drops = (
        lines.join(keys, LINE)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.collect_set(F.struct(*LINE)).alias("gone"))
    )
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in docs.schema.fields]
    at_text = f"c{names.index('text')}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_text):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at_text).cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                rows = (text or b"").split(b"\n")
                kept = rows
                if drop:
                    gone = {np.array([d["h1"], d["h2"]], dtype="<i8").tobytes() for d in drop}
                    kept = [x for x in rows if line_key(x, least) not in gone]
                texts.append(b"\n".join(kept) if drop else text or b"")
                n_lines.append(len(rows))
                n_dropped.append(len(rows) - len(kept))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [new if n == "text" else batch.column(f"c{i}") for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    joined = docs.select(F.struct("*").alias("doc")).join(drops, F.expr("doc.doc_id <=> id"), "left")
    return joined.select(*(F.col("doc")[n].alias(f"c{i}") for i, n in enumerate(names)), "gone").mapInArrow(clean, schema)
