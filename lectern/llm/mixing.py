"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import ceil, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Slots that a task lists at once.
STRETCH = 1 << 16
#: Blocks up to which the slots are broadcast; more are joined by a shuffle.
FEW_BLOCKS = 1 << 19


def exact(weight: float) -> Fraction:
    """The simplest fraction that is this weight: 1/10 for 0.1."""
    simple = Fraction(weight).limit_denominator(10**9)
    return simple if float(simple) == float(weight) else Fraction(weight)


class Pfair:
    """An earliest-deadline-first schedule of blocks for weights kept exactly, entered at any slot.

    Block j (from 0) of a source with weight w is released at floor(j / w) and
    due at ceil((j + 1) / w). In each slot the released block with the earliest
    deadline (of equal ones, that of the first name) runs, so a source is always
    less than one block from its share.
    """

    def __init__(self, weights: dict[str, Fraction]):
        self.names = sorted(weights)
        total = sum(weights.values())
        parts = [weights[s] / total for s in self.names]
        #: a source has own[i] blocks in every `period` slots
        self.period = lcm(*(x.denominator for x in parts))
        self.own = [int(x * self.period) for x in parts]

    def release(self, i: int, j: int) -> int:
        return j * self.period // self.own[i]

    def deadline(self, i: int, j: int) -> int:
        return -(-(j + 1) * self.period // self.own[i])

    def _releases(self, i: int, first: int, last: int) -> np.ndarray:
        """Release times of the blocks first to last - 1 of a source, without overflow."""
        start, rest = divmod(first * self.period, self.own[i])
        step, more = divmod(self.period, self.own[i])
        if max(rest + (last - first) * more, step, self.own[i]) < 2**62:
            n = np.arange(last - first, dtype=np.int64)
            return start + n * step + (rest + n * more) // self.own[i]
        return np.array([self.release(i, j) for j in range(first, last)], dtype=np.int64)

    def done(self, at: int) -> list[int]:
        """How many blocks of each source run before slot `at`, without the slots before it.

        All blocks due by then have run, and at most one more of each source, an
        open one. Blocks take one slot each, so a set of them fits before `at` if for
        no time u more of it are released from u on than there are slots from u
        to `at`; and a schedule by priorities runs the set that a greedy choice in order of the
        priorities makes under that rule. Only times between the first release of an open
        block and `at` can bind, so the work is as the longest window of a block.
        """
        due = [a * at // self.period for a in self.own]
        room = at - sum(due)
        if not room:
            return due
        open_ = sorted((self.deadline(i, n), i, self.release(i, n)) for i, n in enumerate(due) if self.own[i] * at % self.period)
        ends = np.array(sorted({r for _, _, r in open_}), dtype=np.int64)
        first = int(ends[0])
        ran = np.sort(np.concatenate([self._releases(i, -(-a * first // self.period), due[i]) for i, a in enumerate(self.own) if -(-a * first // self.period) < due[i]] or [ends[:0]]))
        times = np.concatenate([ran, ends])
        free = at - times - (len(ran) - np.searchsorted(ran, times))
        stretch = np.searchsorted(ends, times)
        least = np.full(len(ends) + 1, at, dtype=np.int64)
        np.minimum.at(least, stretch, free)
        for _, i, r in open_:
            k = int(np.searchsorted(ends, r)) + 1
            if room and least[:k].min() > 0:
                least[:k] -= 1
                due[i] += 1
                room -= 1
        return due

    def slots(self, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """The source (its place among the names) and the number of its block in each slot from start to stop - 1."""
        ready: list[tuple[int, int, int]] = []
        waiting = [(self.release(i, j), i, j) for i, j in enumerate(self.done(start))]
        heapify(waiting)
        for t in range(start, stop):
            while waiting and waiting[0][0] <= t:
                _, i, j = heappop(waiting)
                heappush(ready, (self.deadline(i, j), i, j))
            _, i, j = heappop(ready)
            yield i, j
            heappush(waiting, (self.release(i, j + 1), i, j + 1))

    def first_end(self, left: list[int]) -> int:
        """The slots after which the first source has run all its blocks left."""
        low = min(self.release(i, n - 1) for i, n in enumerate(left))
        high = min(self.deadline(i, n - 1) for i, n in enumerate(left))
        while high - low > 1:
            mid = (low + high) // 2
            if any(d >= n for d, n in zip(self.done(mid), left, strict=True)):
                high = mid
            else:
                low = mid
        return high

    def stretch(self) -> int:
        """Slots for a task: no fewer than the longest window, so that finding its start costs no more than listing it."""
        return max(STRETCH, -(-self.period // min(self.own)))


def phases(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[Pfair, int, int, list[int]]]:
    """(schedule, its first slot, its number of slots, each source's blocks placed before); a phase ends with the last block of the first source that runs out."""
    left, placed, at, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while active := {s: weights[s] for s, n in left.items() if n}:
        plan = Pfair(active)
        length = plan.first_end([left[s] for s in plan.names])
        out.append((plan, at, length, [placed[s] for s in plan.names]))
        for s, n in zip(plan.names, plan.done(length), strict=True):
            left[s] -= n
            placed[s] += n
        at += length
    return out


def slot_table(spark: SparkSession, plan: list[tuple[Pfair, int, int, list[int]]]) -> DataFrame:
    """(name, b, mix_slot): the slot of each block of each source, listed by tasks that each enter the schedule at a place of their own."""
    ends = np.cumsum([-(-length // p.stretch()) for p, _, length, _ in plan]).tolist()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                phase = int(np.searchsorted(ends, k, side="right"))
                p, at, length, placed = plan[phase]
                step = p.stretch()
                start = (k - (ends[phase - 1] if phase else 0)) * step
                names, rows = pa.array(p.names, pa.string()), []
                for t, (i, j) in enumerate(p.slots(start, min(start + step, length)), at + start):
                    rows.append((i, placed[i] + j, t))
                    if len(rows) == STRETCH:
                        yield as_batch(names, rows)
                        rows = []
                if rows:
                    yield as_batch(names, rows)

    def as_batch(names: pa.Array, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        i, b, t = np.array(rows, dtype=np.int64).T
        return pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(b), pa.array(t)], ["name", "b", "mix_slot"])

    return spark.range(0, ends[-1], 1, min(ends[-1], 4096)).mapInArrow(listed, "name string, b long, mix_slot long")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16, by: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with a column mix_slot: the document's block's slot in the mixed order, and mix_source_block, the block's number in its source.

    A source's documents are put in the order of a hash of the columns `by` (of equal
    hashes, of those columns) and cut into blocks of `block` documents. The blocks
    take the slots of a Pfair schedule for the target weights (equal ones if none are given; sources
    without a weight, or with none above zero, get the smallest): while all
    sources last, every beginning of the order holds of each source its share of
    blocks, give or take less than one. When a source runs out the others share
    its place by their weights; no document is lost or repeated. Weights hold
    exactly, however small they are and however long the order is.

    A source with most rows is numbered in many tasks, by ranges of the hash; the
    driver gets one row for each source in each of them. Where the sources run out
    is found by arithmetic, and the slots are listed by tasks that enter the
    schedule at a place of their own, so the driver holds sizes and weights alone.
    It is meant for up to some hundred sources. Up to FEW_BLOCKS blocks have their slots
    broadcast; more are joined by a shuffle. A null source
    is a source of its own; a null text is a document like any other. Repeated
    rows are documents of their own; which of those equal in all columns of `by` takes which
    of their places is open. An empty table gives an empty result.
    """
    docs = docs.drop("mix_slot", "mix_source_block")
    name = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    keyed = docs.select(F.struct("*").alias("doc"), name.alias("name"), F.xxhash64(*by, F.lit(3)).alias("hash"))
    keyed = keyed.repartitionByRange("name", "hash").sortWithinPartitions("name", "hash", *(F.col("doc")[c] for c in by)).drop("hash").withColumn("part", F.spark_partition_id())
    keyed = cut(keyed.withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # one row for each source in each partition of the sort
    runs = keyed.groupBy("part", "name").agg(F.count("*").alias("n"), F.min("i").alias("first")).collect()
    sizes: dict[str, int] = {}
    ahead = []
    for r in sorted(runs, key=lambda r: (r["name"], r["part"])):
        ahead.append((r["part"], r["name"], sizes.get(r["name"], 0) - r["first"]))
        sizes[r["name"]] = sizes.get(r["name"], 0) + r["n"]
    if not sizes:
        return docs.withColumn("mix_slot", F.lit(None).cast("long")).withColumn("mix_source_block", F.lit(None).cast("long"))
    blocks = {s: ceil(n / block) for s, n in sizes.items()}
    given = weights or dict.fromkeys(blocks, 1.0)
    least = min((w for w in given.values() if w > 0), default=1.0)
    target = {s: exact(given[s] if given.get(s, 0) > 0 else least) for s in blocks}
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(ahead, "part int, name string, ahead long"))
    schedule = slot_table(spark, phases(blocks, target))
    schedule = F.broadcast(schedule) if sum(blocks.values()) <= FEW_BLOCKS else schedule.hint("merge")
    numbered = keyed.join(offsets, ["part", "name"]).withColumn("b", F.floor((F.col("i") + F.col("ahead")) / block).cast("long"))
    return numbered.join(schedule, ["name", "b"]).select("doc.*", "mix_slot", F.col("b").alias("mix_source_block"))


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16) -> DataFrame:
    """docs sorted by the mixed order, with its own columns only: files written from it hold the sources in their target weights from first to last.

    Nulls, empty and repeated rows as in mix_sources.
    """
    mixed = mix_sources(docs, weights, block)
    order = [F.col("mix_slot"), F.xxhash64("doc_id", F.lit(3))]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).drop("mix_slot", "mix_source_block")
