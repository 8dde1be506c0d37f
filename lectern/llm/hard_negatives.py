"""Hard negatives for anchors, found by an inverted multi-index whose cells are visited by bounds."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .whole_vectors import matrix, narrowest, product, unpacked, whole_vectors

#: Rows that the codebooks are fitted on, and rounds of fitting. All rows are indexed; the fit decides the cells' shapes only.
SAMPLE, FITS = 4096, 8
#: Rows that a cell should hold, and the most entries of a half's codebook.
CELL_ROWS, MOST_ENTRIES = 256, 128
#: Rows of an index block, and anchors that travel together.
BLOCK, TOGETHER = 512, 128
#: Rows after which the first visit of an anchor's cells ends.
FIRST_ROWS = 8192
#: What rounding may take from a bound: scores are whole numbers.
ROOM = 0.5
#: Anchors whose best rows a task holds before it gives them out.
HELD = 20_000
NOTHING = -(2**63) + 1
LAST_ID = 2**63 - 1


@dataclass
class Cells:
    """The two codebooks, and for each half entry the largest distance of its rows, and each cell's number of rows."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half and entry, the largest and the smallest score that its rows can add to an anchor's."""
        most, least, at = [], [], 0
        for book, radius in zip(self.books, self.radii, strict=True):
            half = anchor[at : at + book.shape[1]].astype(np.float64)
            at += book.shape[1]
            middle, around = book @ half, np.sqrt(half @ half) * radius
            room = ROOM + 1e-9 * (np.abs(middle) + around)
            most.append(middle + around + room)
            least.append(middle - around - room)
        return most, least


def in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs of a value of each list, by falling sum: a heap holds the edge of the pairs given out."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    edge = [(-(first[one[0]] + second[two[0]]), 0, 0)]
    while edge:
        total, a, b = heapq.heappop(edge)
        yield -total, int(one[a]), int(two[b])
        if b + 1 < len(two):
            heapq.heappush(edge, (-(first[one[a]] + second[two[b + 1]]), a, b + 1))
        if b == 0 and a + 1 < len(one):  # each row of pairs is entered by its first
            heapq.heappush(edge, (-(first[one[a + 1]] + second[two[0]]), a + 1, 0))


def visit(cells: Cells, anchor: np.ndarray, seen: np.ndarray, floor: int, ceiling: int, enough: int | None) -> tuple[list[int], np.ndarray]:
    """The cells to look at next, and those seen after that.

    Cells come by their bound. The visit ends where no further cell can hold a
    score of `floor`, or after `enough` rows. Cells of which every row scores more
    than `ceiling` are seen without a look.
    """
    (first, second), (low1, low2) = cells.bounds(anchor)
    seen, found, rows, width = seen.copy(), [], 0, len(second)
    for bound, i, j in in_order(first, second):
        if bound < floor or enough is not None and rows >= enough:
            break
        cell = i * width + j
        if not seen[cell]:
            seen[cell] = True
            if cells.counts[cell] and low1[i] + low2[j] <= ceiling:
                found.append(cell)
                rows += int(cells.counts[cell])
    return found, seen


# The index


def fitted(points: np.ndarray, entries: int) -> np.ndarray:
    """A codebook of a half by a few rounds of means, from points as they come."""
    book = points[np.linspace(0, len(points) - 1, entries).astype(int)].copy()
    for _ in range(FITS):
        at = closest(points, book)[0]
        sums = np.zeros_like(book)
        np.add.at(sums, at, points)
        n = np.bincount(at, minlength=entries)[:, None]
        book = np.where(n > 0, sums / np.maximum(n, 1), book)
    return book


def closest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = ((book * book).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)
    gap = points - book[at]
    return at, np.sqrt((gap * gap).sum(axis=1))


def build_index(kept: DataFrame, n: int, dim: int, most: int) -> tuple[DataFrame, Cells]:
    """(cell, n, rids, ids, labels, flat) of all rows of kept, in blocks of their cell, and the cells."""
    half, entries = dim // 2, int(min(MOST_ENTRIES, max(1, round((n / CELL_ROWS) ** 0.5))))
    sample = kept.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("whole").collect()
    points = np.array([r["whole"] for r in sample], np.float64).reshape(len(sample), dim)
    books = fitted(points[:, :half], entries), fitted(points[:, half:], entries)
    kind = narrowest(most)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("whole"), dim)
            y = x.astype(np.float64)
            (i, one), (j, two) = closest(y[:, :half], books[0]), closest(y[:, half:], books[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array((i * entries + j).astype(np.int32)), *(batch.column(c) for c in ("rid", "vec_id", "label")), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(one), pa.array(two)], ["cell", "rid", "vec_id", "label", "piece", "one", "two"]
            )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "vec_id", "label", "piece", "one", "two"]

        def block(cell: int, rows: pa.Table) -> pa.RecordBatch:
            rid, vec_id, label, one, two = (rows.column(c).to_numpy() for c in ("rid", "vec_id", "label", "one", "two"))
            data = [cell, len(rid), *(x.astype("<i8").tobytes() for x in (rid, vec_id, label)), b"".join(rows.column("piece").to_pylist()), one.max(), two.max()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([d], k) for d, k in zip(data, kinds, strict=True)], ["cell", "n", "rids", "ids", "labels", "flat", "one", "two"])

        held, of = None, None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(ends, ends[1:], strict=False):
                if a == b:
                    continue
                if of is not None and cell[a] != of and held is not None and held.num_rows:
                    yield block(of, held)
                    held = None
                rows = pa.Table.from_batches([batch.slice(a, b - a)]).select(names)
                held, of = (rows if held is None else pa.concat_tables([held, rows]).combine_chunks()), int(cell[a])
                while held.num_rows >= BLOCK:
                    yield block(of, held.slice(0, BLOCK))
                    held = held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield block(of, held)

    ided = kept.withColumn("vec_id", F.coalesce("vec_id", F.lit(LAST_ID)))
    rows = ided.mapInArrow(placed, "cell int, rid long, vec_id long, label long, piece binary, one double, two double")
    ordered = rows.repartitionByRange("cell", "rid").sortWithinPartitions("cell", "rid")
    blocks = cut(ordered.mapInArrow(blocked, "cell int, n int, rids binary, ids binary, labels binary, flat binary, one double, two double"))
    counts, radii = np.zeros(entries * entries, np.int64), (np.zeros(entries), np.zeros(entries))
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("one").alias("one"), F.max("two").alias("two")).collect():  # at most MOST_ENTRIES squared
        counts[r["cell"]] = r["n"]
        for radius, k, value in ((radii[0], r["cell"] // entries, r["one"]), (radii[1], r["cell"] % entries, r["two"])):
            radius[k] = max(radius[k], value)
    return blocks.select("cell", "n", "rids", "ids", "labels", "flat"), Cells(books, radii, counts)


# Looking at cells

#: An anchor: its row, number and label, what it looks for (a range of scores for each slot), and the cells that it has seen.
ANCHOR = "rid long, anchor_id long, label long, whole array<long>, low array<long>, high array<long>, seen binary"
ASK = "cell int, rids binary, labels binary, flat binary, low binary, high binary, slots int"


def asked(anchors: DataFrame, cells: Cells, dim: int, enough: int | None, most: int) -> tuple[DataFrame, DataFrame]:
    """ASK rows, a cell and the anchors that look at it, and anchors with the cells they have seen then."""
    kind = narrowest(most)

    def steps(batch: pa.RecordBatch) -> list[tuple[list[int], np.ndarray]]:
        found = []
        for x, low, high, seen in zip(matrix(batch.column("whole"), dim), *(batch.column(c).to_pylist() for c in ("low", "high", "seen")), strict=True):
            before = np.unpackbits(np.frombuffer(seen, np.uint8), count=len(cells.counts)).astype(bool) if seen else np.zeros(len(cells.counts), bool)
            found.append(visit(cells, x, before, min(low), max(high), enough))
        return found

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                wanted: dict[int, list[int]] = {}
                for k, (found, _) in enumerate(steps(batch)):
                    for cell in found:
                        wanted.setdefault(cell, []).append(k)
                x = matrix(batch.column("whole"), dim)
                rid, label = (batch.column(c).to_numpy() for c in ("rid", "label"))
                low, high = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("low", "high"))
                for cell, ks in wanted.items():
                    data = [cell, *(y[ks].astype(t).tobytes() for y, t in ((rid, "<i8"), (label, "<i8"), (x, kind), (low, "<i8"), (high, "<i8"))), low.shape[1]]
                    kinds = [pa.int32(), *[pa.binary()] * 5, pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([d], t) for d, t in zip(data, kinds, strict=True)], ["cell", "rids", "labels", "flat", "low", "high", "slots"])

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([np.packbits(seen).tobytes() for _, seen in steps(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), bits], ["rid", "seen"])

    return anchors.mapInArrow(looks, ASK), anchors.select("rid", "whole", "low", "high", "seen").mapInArrow(after, "rid long, seen binary")


class Best:
    """The best rows of each anchor and slot that a task has met."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, key: tuple[int, int], low: int) -> int:
        """The score below which nothing is wanted any more."""
        own = self.held.get(key)
        return low if own is None or len(own[0]) < self.k else max(low, int(own[0][-1]))

    def add(self, key: tuple[int, int], score: np.ndarray, ident: np.ndarray, rid: np.ndarray) -> None:
        if (own := self.held.get(key)) is not None:
            score, ident, rid = (np.concatenate(x) for x in zip(own, (score, ident, rid), strict=True))
        order = np.lexsort((rid, ident, -score))[: self.k]
        self.held[key] = (score[order], ident[order], rid[order])

    def rows(self) -> pa.RecordBatch:
        keys, held = list(self.held), list(self.held.values())
        self.held = {}
        n = [len(h[0]) for h in held]
        columns = [np.repeat(np.array([k[i] for k in keys], np.int64), n) for i in (0, 1)] + [np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i == 1 else c.astype(np.int64)) for i, c in enumerate(columns)], ["rid", "slot", "score", "ident", "other"])


FOUND = "rid long, slot int, score long, ident long, other long"


def looked_at(asks: DataFrame, blocks: DataFrame, dim: int, k: int, same: bool, most: int) -> DataFrame:
    """FOUND: for each anchor and slot the k best rows of one task's cells, of the same label or of others, within the slot's scores.

    Asks grow with anchors times cells, but Spark tells their size from the anchors
    alone: left to itself it sends them all to the driver, to be broadcast.
    """
    pairs = asks.withColumnsRenamed({"rids": "a_rids", "labels": "a_labels", "flat": "a_flat"}).join(blocks.hint("merge"), "cell")
    kind = narrowest(most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                rids, labels, ids, a_rids, a_labels = (np.frombuffer(row[c], "<i8") for c in ("rids", "labels", "ids", "a_rids", "a_labels"))
                low, high = (unpacked(row[c], row["slots"], len(a_rids)) for c in ("low", "high"))
                scores = product(unpacked(row["a_flat"], dim, len(a_rids), kind), unpacked(row["flat"], dim, len(rids), kind), most)
                fits = (a_labels[:, None] == labels) & (a_rids[:, None] != rids) if same else a_labels[:, None] != labels
                fits &= (scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
                for a in np.flatnonzero(fits.any(axis=1)):
                    own = scores[a]
                    for slot in range(row["slots"]):
                        key = (int(a_rids[a]), slot)
                        take = np.flatnonzero(fits[a] & (own >= best.least(key, int(low[a, slot]))) & (own <= high[a, slot]))
                        if len(take):
                            best.add(key, own[take], ids[take], rids[take])
                if len(best.held) > HELD:
                    yield best.rows()
        yield best.rows()

    return pairs.mapInArrow(score, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """found with `rank`, from 1: the k best of each anchor and slot."""
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "ident", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def certified(anchors: DataFrame, blocks: DataFrame, cells: Cells, dim: int, k: int, same: bool, most: int, there: DataFrame | None = None) -> DataFrame:
    """best_of() for anchors (ANCHOR), over all rows of the index.

    A first visit looks at the cells of the largest bounds. What it finds says
    which score a further row must reach, slot by slot: a second visit looks at every
    cell left whose bound reaches it, and no other cell can hold one of the k best.
    `there` (rid, fitting) tells how many rows there are at all: who has found them
    all looks no further.
    """
    asks, seen = asked(anchors, cells, dim, FIRST_ROWS, most)
    first = cut(best_of(looked_at(asks, blocks, dim, k, same, most), k))
    reached = first.groupBy("rid", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    if there is None:
        reached = reached.where(F.col("n") == k)
    else:
        all_found = F.col("n") >= F.col("fitting")
        reached = reached.join(there, "rid").where((F.col("n") == k) | all_found).withColumn("least", F.when(all_found, LAST_ID).otherwise(F.col("least")))
    full = reached.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least"))  # as many as an anchor's slots
    raised = F.transform("low", lambda v, i: F.coalesce(F.greatest(v, F.col("least")[i]), v))
    left = cut(anchors.drop("seen").join(seen.hint("merge"), "rid").join(full, "rid", "left").select("rid", "anchor_id", "label", "whole", raised.alias("low"), "high", "seen"))
    more, _ = asked(left, cells, dim, None, most)
    return cut(best_of(first.drop("rank").union(looked_at(more, blocks, dim, k, same, most)), k))


def mine(
    vectors: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, anchor: Callable[[Column], Column] = lambda i: i % 100 == 0, label: Callable[[Column, Column], Column] = lambda i, own: own
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives from vectors (vec_id, embedding, label).

    Components become floor(scale * x); a row's score is its inner product with
    the anchor. An anchor's positives are its `positives` best other rows of its
    label. The negatives of a positive are the `negatives` best rows of other
    labels with scores from `least` to `most` per cent of the positive's. Equal
    scores come by the smaller vec_id, a null id last. `anchor` says which ids are
    anchors, `label` a row's label by its id and given one. Rows with a null
    label, a null vector, or null or non-finite components take no part; a row with a
    null id is no anchor. Repeated rows are rows of their own, as anchors too. An empty table gives no
    rows. Vectors must be of one length. Other columns are not read.
    """
    usable = vectors.where("label IS NOT NULL").select("vec_id", "embedding", label(F.col("vec_id"), F.col("label")).alias("label")).where("label IS NOT NULL")
    kept, n, dim, largest = whole_vectors(usable, scale)
    if not n:
        none = F.lit(None).cast("long")
        return kept.select(F.col("vec_id").alias("anchor_id"), none.alias("positive_id"), F.lit(0).alias("rank"), none.alias("negative_id"), none.alias("positive_score"), none.alias("negative_score"))
    blocks, cells = build_index(kept, n, dim, largest)
    wide = lambda v: F.array(F.lit(v).cast("long"))
    anchors = cut(kept.where(anchor(F.col("vec_id"))).select("rid", F.col("vec_id").alias("anchor_id"), "label", "whole", wide(NOTHING).alias("low"), wide(LAST_ID).alias("high"), F.lit(None).cast("binary").alias("seen")))
    fitting = kept.groupBy("label").agg((F.count("*") - 1).alias("fitting"))
    near = certified(anchors, blocks, cells, dim, positives, True, largest, anchors.select("rid", "label").join(fitting, "label").select("rid", "fitting"))
    # the scores that a positive's negatives may have; none are left where the positive's is below zero
    low, high = F.expr(f"-((-{least} * score) div 100) + CAST(({least} * score) % 100 > 0 AS INT)"), F.expr(f"({most} * score) div 100")
    ranged = near.where("score >= 0").select("rid", (F.col("rank") - 1).alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    slots = ranged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("s"))  # at most `positives`
    padded = lambda c, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(c, i), F.lit(none).cast("long")))
    windows = cut(anchors.join(slots, "rid").select("rid", "anchor_id", "label", "whole", padded(F.col("s.low"), LAST_ID).alias("low"), padded(F.col("s.high"), NOTHING).alias("high"), "seen"))
    far = certified(windows, blocks, cells, dim, negatives, False, largest)
    own = near.select("rid", (F.col("rank") - 1).alias("slot"), F.col("ident").alias("positive"), F.col("score").alias("positive_score"))
    told = lambda c: F.nullif(F.col(c), F.lit(LAST_ID))
    return far.join(own, ["rid", "slot"]).join(anchors.select("rid", "anchor_id"), "rid").select("anchor_id", told("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), told("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
