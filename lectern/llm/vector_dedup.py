"""Near-duplicate vectors by a pigeonhole join over subspaces of the rotated space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, summed

#: Rotated coordinates travel as whole multiples of this, so that every task decides alike.
GRID = 1e-6
#: What rounding to the grid may add to a block's squared distance.
SLACK = 1e-4
#: Rows of a product of two blocks of vectors, and columns of one where most pairs are candidates.
TILE, WIDE = 512, 4096
#: Pairs that are looked at one by one at once.
PIECE = 1 << 16
#: Cosines closer to the threshold than this are worked out for the pair alone.
CLOSE = 1e-9


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(embedding, rep, copies, dim): usable vectors, each distinct one once."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.where(F.coalesce(good & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("embedding", "rep", "copies", F.size("embedding").alias("dim"))


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sum of the outer products of the unit vectors, over all of them: a dim by dim matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(batch.column("embedding"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "task", "data"])

    found = summed(cut(vectors.select("embedding").mapInArrow(moments, "part int, task int, data binary")), "<f8")
    return found.get(0, np.zeros(dim * dim)).reshape(dim, dim)


def unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, initial=1e-300, keepdims=True)  # tiny and huge vectors alike
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def subspaces(moment: np.ndarray, cosine: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation to the principal axes, the first coordinate of each block, and each block's squared-distance budget.

    The budgets are in proportion to what the blocks hold of the vectors' squared
    length and sum to 2 - 2 * cosine, the squared distance of two unit vectors
    at the threshold: if each block exceeded its budget, so would the whole.
    """
    dim = len(moment)
    value, vector = np.linalg.eigh(moment)
    first = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    value = np.clip(value[::-1], 0, None) + 1e-9 * max(value.sum(), 1e-9) + 1e-12
    # the axes are dealt in turn, so that every block has strong ones and leads with its strongest
    order = np.concatenate([np.arange(b, dim, len(first) - 1) for b in range(len(first) - 1)])
    first = np.concatenate(([0], np.cumsum([len(range(b, dim, len(first) - 1)) for b in range(len(first) - 1)])))
    held = np.add.reduceat(value[order], first[:-1])
    return vector[:, ::-1][:, order], first[:-1], (2 - 2 * cosine) * held / held.sum()


def number_type(vectors: DataFrame) -> str:
    """How components travel: as they are given, single or double precision."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def cells(vectors: DataFrame, dim: int, rotation: np.ndarray, first: np.ndarray, budgets: np.ndarray) -> DataFrame:
    """(rep, copies, vec, at, block, cell): for each block the stripe, as wide as the block's radius with its slack, of its leading coordinate."""
    width = np.sqrt(budgets + SLACK) + 4 * GRID  # no pair that a block claims lies further apart
    kind = number_type(vectors)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), dtype=kind).reshape(-1, dim)
            y = np.rint(unit(batch.column("embedding"), dim) @ rotation / GRID).astype("<i4")
            n, k = len(x), len(first)
            cell = np.floor(y[:, first] * GRID / width).astype(np.int32)
            take = pa.array(np.repeat(np.arange(n), k))
            vec, at = (pa.array([r.tobytes() for r in z], pa.binary()) for z in (x, y))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(take), batch.column("copies").take(take), vec.take(take), at.take(take), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(cell.ravel())], ["rep", "copies", "vec", "at", "block", "cell"]
            )

    return vectors.mapInArrow(placed, "rep long, copies long, vec binary, at binary, block int, cell int")


def units_of_work(placed: DataFrame, chunk: int) -> DataFrame:
    """Each row sent to the pairs of chunks it takes part in: within its cell, and between its cell and the next one.

    A cell's rows are dealt by hash into chunks of about `chunk` rows. The table
    of cells is bounded by the geometry: the coordinates lie between -1 and 1 and
    the stripes are as wide as the radius.
    """
    sizes = placed.groupBy("block", "cell").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    sizes = cut(sizes.select("block", "cell", "chunks"))
    beside = sizes.select("block", "cell", "chunks")
    known = (
        sizes.join(beside.select("block", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("above")), ["block", "cell"], "left")
        .join(beside.select("block", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("below")), ["block", "cell"], "left")
        .select("block", "cell", "chunks", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    )
    own = placed.join(F.broadcast(known), ["block", "cell"]).withColumn("own", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int"))

    def unit_row(lower, other, one, two, side):
        return F.struct(lower.alias("lower"), F.lit(other).alias("next"), one.alias("one"), two.alias("two"), F.lit(side).alias("side"))

    own_c, cell = F.col("own"), F.col("cell")

    def upto(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<lower:int,next:int,one:int,two:int,side:int>>"))

    inside = upto(F.col("chunks"), lambda c: F.struct(cell.alias("lower"), F.lit(0).alias("next"), F.least(own_c, c).alias("one"), F.greatest(own_c, c).alias("two"), F.when(own_c <= c, 0).otherwise(1).alias("side")))
    up = upto(F.col("above"), lambda c: unit_row(cell, 1, own_c, c, 0))
    down = upto(F.col("below"), lambda c: unit_row(cell - 1, 1, c, own_c, 1))
    return own.withColumn("u", F.explode(F.concat(inside, up, down))).select("block", "u.*", "rep", "copies", "vec", "at")


class Forest:
    """Components of n things, and the links that joined them."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take up links; only those between components are looked at one by one."""
        root = self.root
        open_ = root[i] != root[j]
        if not open_.any():
            return
        i, j = i[open_], j[open_]
        _, some = np.unique(root[i] * len(root) + root[j], return_index=True)  # one link for each pair of components

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
            if (ra := find(a)) != (rb := find(b)):
                root[rb] = ra
                self.edges.append((a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def links_in(units: DataFrame, dim: int, first: np.ndarray, budgets: np.ndarray, cosine: float, kind: str = "<f4") -> DataFrame:
    """(rep, other, n) from each unit of work: how many vectors rep links with there, and an edge of a spanning forest of the links.

    A pair is a candidate in each block whose budget it keeps. It is verified, in
    double precision on the given components, in the first of these only, which
    every task finds alike; so no pair is counted twice. Counts leave a task as
    sums and links as forests, never as all pairs. Where most pairs of a tile are
    candidates, as among near copies, it is worked out in whole matrices, else
    pair by pair in pieces; both hold a bounded number of pairs at once.
    """
    last = np.append(first[1:], dim)
    limit = np.floor((budgets + SLACK) / GRID**2)

    def compare(table: pa.Table) -> pa.Table:
        rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
        vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
        at = np.frombuffer(b"".join(table.column("at").to_pylist()), "<i4").reshape(-1, dim).astype(np.float64)
        vec = vec / np.abs(vec).max(axis=1, keepdims=True)
        norm = np.sqrt((vec * vec).sum(axis=1))
        block, within = table.column("block")[0].as_py(), table.column("next")[0].as_py() == 0 and table.column("one")[0] == table.column("two")[0]
        left = np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        parts = [slice(a, b) for a, b in zip(first[: block + 1], last[: block + 1], strict=True)]
        squares = [(at[:, p] * at[:, p]).sum(axis=1) for p in parts]  # whole numbers below 2**53: every task finds the same
        sums, forest = np.zeros(len(rep), np.int64), Forest(len(rep))

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (vec[i] * vec[j]).sum(axis=1) / (norm[i] * norm[j]) >= cosine

        def one_by_one(i: np.ndarray, j: np.ndarray) -> None:
            for b, p in enumerate(parts):
                gap = at[i, p] - at[j, p]
                keeps = (gap * gap).sum(axis=1) <= limit[b]
                i, j = (i[keeps], j[keeps]) if b == block else (i[~keeps], j[~keeps])
            ok = near(i, j)
            i, j = i[ok], j[ok]
            np.add.at(sums, i, copies[j])
            np.add.at(sums, j, copies[i])
            forest.join(i, j)

        def all_at_once(rows: np.ndarray, columns: np.ndarray) -> None:
            keeps = rows[:, None] < columns if within else np.ones((len(rows), len(columns)), bool)
            for b, p in enumerate(parts):
                far = squares[b][rows, None] + squares[b][columns] - 2 * (at[rows, p] @ at[columns, p].T) > limit[b]
                keeps &= ~far if b == block else far
            cos = (vec[rows] @ vec[columns].T) / (norm[rows, None] * norm[columns])
            ok = keeps & (cos >= cosine)
            doubt = np.flatnonzero(keeps & (np.abs(cos - cosine) < CLOSE))
            for some in np.array_split(doubt, -(-len(doubt) // PIECE)) if len(doubt) else ():
                i, j = np.divmod(some, len(columns))
                ok[i, j] = near(rows[i], columns[j])
            sums[rows] += ok @ copies[columns]
            sums[columns] += copies[rows] @ ok
            while True:  # a row of links joins its components, so that most links lie within one when they are looked at
                apart = ok & (forest.root[rows, None] != forest.root[columns])
                i = np.flatnonzero(apart.any(axis=1))
                if not len(i):
                    break
                j = np.flatnonzero(apart[i[0]])
                forest.join(np.full(len(j), rows[i[0]]), columns[j])

        # the squared distances of a tile are one product of extended rows, in single precision and with room for its errors
        z = at[right][:, parts[block]] * GRID
        z = np.hstack([-2 * z, np.ones((len(z), 1)), (z * z).sum(axis=1, keepdims=True)]).astype(np.float32)
        room = np.float32(budgets[block] + 2 * SLACK)
        for start in range(0, len(left), TILE):
            rows = left[start : start + TILE]
            y = at[rows][:, parts[block]] * GRID
            y = np.hstack([y, (y * y).sum(axis=1, keepdims=True), np.ones((len(y), 1))]).astype(np.float32)
            for a in range(0, len(right), WIDE):
                columns = right[a : a + WIDE]
                hit = np.flatnonzero(y @ z[a : a + WIDE].T <= room)
                if len(hit) * 8 > len(rows) * len(columns):
                    all_at_once(rows, columns)
                    continue
                for some in range(0, len(hit), PIECE):
                    i, j = np.divmod(hit[some : some + PIECE], len(columns))
                    i, j = rows[i], columns[j]
                    one_by_one(i[i < j], j[i < j]) if within else one_by_one(i, j)
        hit = np.flatnonzero(sums)
        one = np.array([a for a, _ in forest.edges], np.int64)
        two = np.array([b for _, b in forest.edges], np.int64)
        return pa.table(
            {"rep": np.concatenate([rep[hit], rep[one]]), "other": pa.array(np.concatenate([np.zeros(len(hit), np.int64), rep[two]]), mask=np.concatenate([np.ones(len(hit), bool), np.zeros(len(two), bool)])), "n": np.concatenate([sums[hit], np.zeros(len(one), np.int64)])}
        )

    return units.groupBy("block", "lower", "next", "one", "two").applyInArrow(compare, "rep long, other long, n long")


def similar_vectors(vectors: DataFrame, cosine: float = 0.9, blocks: int = 4, chunk: int = 24_000) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors whose cosine is at least `cosine` link. n_links counts the other
    rows linked directly, component_id is the smallest vec_id reachable, and the
    row whose vec_id it is stays. Vectors that are null, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors are compared once and counted with their copies.
    Repeated rows count as vectors of their own: rows that share a vec_id but not
    the vector have links of their own, and one component, as it is of ids. A
    null vec_id links with nothing and stays. An empty table gives an empty result. Other columns are
    not read.

    The unit vectors are rotated to principal axes and cut into blocks of few
    dimensions; a pair within the threshold keeps at least one block's share of
    the squared distance, so the union of the blocks' range joins holds every
    link. Range joins run over stripes of a block's leading coordinate, in
    chunks of bounded size.
    """
    given = vectors.schema["embedding"].dataType.elementType.simpleString()
    numbers = F.col("embedding") if given in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    # vectors are told apart by a number that is fixed as they are written, since rows of one id may have different ones
    distinct = cut(distinct_vectors(rows.where("vec_id IS NOT NULL")).withColumn("vid", F.monotonically_increasing_id()))
    found = None
    for dim in sorted(r["dim"] for r in distinct.select("dim").distinct().collect()):
        own = distinct.where(F.col("dim") == dim).select(F.col("vid").alias("rep"), "copies", "embedding")
        rotation, first, budgets = subspaces(second_moments(own, dim), cosine, blocks)
        units = units_of_work(cells(own, dim, rotation, first, budgets), chunk)
        links = links_in(units, dim, first, budgets, cosine, number_type(own))
        found = links if found is None else found.union(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "vid")
    known = cut(distinct.join(counts, "vid", "left").select("embedding", "vid", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    usable = F.when(F.col("vec_id").isNotNull(), F.col("embedding"))
    slim = cut(rows.withColumn("embedding", usable).join(known.drop("vid"), "embedding", "left").select("vec_id", "rep", "n_links"))
    # an id whose rows have several vectors, or one and none, stands for all of them
    several = slim.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count_if(F.col("rep").isNull()).alias("none")).where("least <> most OR none > 0 AND least <> vec_id").select("vec_id")
    shared = slim.where("rep IS NOT NULL").join(several, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    names = known.select("vid", "rep")
    pairs = found.where("other IS NOT NULL").select(F.col("rep").alias("x"), F.col("other").alias("y"))
    linked = pairs.join(names.select(F.col("vid").alias("x"), F.col("rep").alias("a")), "x").join(names.select(F.col("vid").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
    comp = components(linked.union(shared))
    node = F.coalesce("rep", "vec_id")
    joined = slim.withColumn("id", node).join(comp, "id", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
