"""Vectors as short codes: codebooks for parts of the vector, trained and applied in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, summed
from .sharding import hilbert_index
from .whole_vectors import matrix, product, unpacked, whole_vectors

#: Rows of a block.
BLOCK = 512
#: The most coordinates of a part that the curve runs through, and the bits of an index.
AXES, BITS = 20, 60


def spread(kept: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each component, for the curve's grid."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dim))
        for batch in batches:
            x = matrix(batch.column("whole"), dim).astype(np.float64)
            total += np.stack([np.full(dim, len(x), float), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "task", "data"])

    n, one, two = summed(cut(kept.select("whole").mapInArrow(sums, "part int, task int, data binary")), "<f8")[0].reshape(3, dim)
    mean = one / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(two / np.maximum(n, 1) - mean * mean, 0)) + 1e-9


def blocks_of(kept: DataFrame, dim: int, parts: int) -> DataFrame:
    """(part, n, rids, flat, lo, hi, total): each part's rows along a Hilbert curve, in flat blocks with their box and sums.

    The curve runs through all of a part's components, or the first AXES, each in
    cells of its spread; rows at one place of the curve are told apart by rid, so
    that no sort partition has to hold them all.
    """
    width, (mean, deviation) = dim // parts, spread(kept, dim)
    axes = min(width, AXES)
    bits = max(1, min(8, BITS // max(1, axes)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rid = matrix(batch.column("whole"), dim), batch.column("rid")
            level = np.clip(np.floor((x - mean) / deviation * 2 ** (bits - 2) + 2 ** (bits - 1)), 0, 2**bits - 1).astype(np.int64)
            for p in range(parts):
                own = slice(p * width, (p + 1) * width)
                curve = hilbert_index(level[:, own][:, :axes], bits) if axes else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(curve), rid, pa.array([r.tobytes() for r in x[:, own]], pa.binary())], ["part", "curve", "rid", "piece"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(p: int, rids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            arrays = [np.int32(p), np.int32(len(rids)), rids, x, x.min(axis=0), x.max(axis=0), x.sum(axis=0)]
            return pa.RecordBatch.from_arrays([pa.array([a]) if a.ndim == 0 else pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], ["part", "n", "rids", "flat", "lo", "hi", "total"])

        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # of the part that comes in
        for batch in batches:
            part, rid = batch.column("part").to_numpy(), batch.column("rid").to_numpy()
            x = np.frombuffer(b"".join(batch.column("piece").to_pylist()), "<i8").reshape(len(part), width)
            for p in np.unique(part).tolist():
                for q in [q for q in waiting if q != p]:
                    yield block(q, *map(np.concatenate, zip(*waiting.pop(q), strict=True)))
                own = part == p
                waiting.setdefault(p, []).append((rid[own], x[own]))
                r, y = map(np.concatenate, zip(*waiting[p], strict=True))
                whole = len(r) // BLOCK * BLOCK
                for at in range(0, whole, BLOCK):
                    yield block(p, r[at : at + BLOCK], y[at : at + BLOCK])
                waiting = {p: [(r[whole:], y[whole:])]} if len(r) > whole else {}
        for q in waiting:
            yield block(q, *map(np.concatenate, zip(*waiting[q], strict=True)))

    placed = kept.select("rid", "whole").mapInArrow(keyed, "part int, curve long, rid long, piece binary")
    ordered = placed.repartitionByRange("part", "curve", "rid").sortWithinPartitions("part", "curve", "rid")
    return cut(ordered.mapInArrow(blocked, "part int, n int, rids binary, flat binary, lo binary, hi binary, total binary"))


def shortlist(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entries, ascending, that can be nearest to a point of a box: all others are further than one of them from all of it.

    First by the box's least and largest distance to each entry. Then against the
    entry that is nearest to the box's middle: how much further another entry is
    changes linearly over the box, so its least value lies at a corner.
    """
    gap = np.maximum(np.maximum(lo - book, book - hi), 0)
    reach = np.maximum(np.abs(book - lo), np.abs(book - hi))
    left = np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())
    some = book[left]
    middle = ((2 * some - lo - hi) ** 2).sum(axis=1)
    best = some[middle.argmin()]
    way = some - best
    further = (some * some).sum(axis=1) - (best * best).sum() - 2 * np.maximum(way * lo, way * hi).sum(axis=1)
    return left[further <= 0]


def nearest(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each point's nearest entry, the lower index of equals, by the box's shortlist."""
    some = shortlist(lo, hi, book)
    own = book[some]
    most = int(max(np.abs(points).max(initial=0), np.abs(own).max(initial=0)))
    apart = (own * own).sum(axis=1) - 2 * product(points, own, 2 * most)
    at = apart.argmin(axis=1)
    return some[at], apart[np.arange(len(points)), at] + (points * points).sum(axis=1)


def each_block(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row in batch.to_pylist():
        lo, hi, total = (np.frombuffer(row[c], "<i8") for c in ("lo", "hi", "total"))
        yield row["part"], np.frombuffer(row["rids"], "<i8"), unpacked(row["flat"], width, row["n"]), lo, hi, total


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean; unused ones stay."""
    parts, entries, width = books.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for p, rids, points, lo, hi, total in each_block(batch, width):
                if len(some := shortlist(lo, hi, books[p])) == 1:  # the whole block's
                    sums[p, some[0]] += np.append(total, len(rids))
                    continue
                at, _ = nearest(points, lo, hi, books[p])
                np.add.at(sums[p], at, np.hstack([points, np.ones((len(points), 1), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "task", "data"])

    sums = summed(cut(blocks.mapInArrow(gather, "part int, task int, data binary")), "<i8")[0].reshape(parts, entries, width + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(rid, part, entry, distance) of every row's parts."""
    width = books.shape[2]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, rids, points, lo, hi, _ in each_block(batch, width):
                at, distance = nearest(points, lo, hi, books[p])
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.full(len(rids), p, np.int32)), pa.array(at.astype(np.int32)), pa.array(distance)], ["rid", "part", "entry", "distance"])

    return blocks.mapInArrow(choose, "rid long, part int, entry int, distance long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray, scale: int) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) / scale


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label, label_error, codebooks_sha256) for each usable row of vectors (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out.
    Codebooks begin with the parts of the `entries` smallest vec_ids (null after all
    others; of equal ids the smaller vector first) and are trained on all rows. Repeated
    rows each have their own code; a null label is a label like others. An empty
    table gives no rows. Vectors must be of one length, a multiple of `parts`.
    Other columns are not read. `entries` is at most 256 and `parts` at most 7.
    """
    if not 1 <= entries <= 256 or not 1 <= parts <= 7:
        raise ValueError("a code has 1 to 7 parts of one byte")
    kept, n, dim, _ = whole_vectors(vectors, scale)
    if dim % parts:
        raise ValueError(f"vectors of length {dim} can't be cut into {parts} equal parts")
    first = [r["whole"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy() if n else np.zeros((parts, 0, 0), np.int64)
    if n:
        blocks = blocks_of(kept, dim, parts)
        for _ in range(rounds):
            books = improved(blocks, books)
        chosen = assigned(blocks, books)
    else:
        chosen = kept.select("rid", F.lit(0).alias("part"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("distance"))
    number = F.sum(F.expr(f"shiftleft(CAST(entry AS BIGINT), 8 * ({parts} - 1 - part))"))
    rows = chosen.groupBy("rid").agg(F.lower(F.lpad(F.hex(number), 2 * parts, "0")).alias("code"), F.sum("distance").alias("error"))
    coded = cut(kept.select("rid", "vec_id", "label").join(rows, "rid"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books
