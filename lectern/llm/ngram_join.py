"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification per pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, mix, slices, summed, word_names, words_of

#: Counters of the frequency sketch, as a power of two, and the pieces it travels in.
SKETCH_BITS, SKETCH_PARTS = 19, 64
#: The suffix filter's sketch: counts in BUCKETS parts of the hash space, then the parity of counts in PARITY parts.
BUCKETS, PARITY = 64, 1024
SKETCH_BYTES = BUCKETS + PARITY // 8
#: Posting lists up to this length are paired directly.
SHORT = 24
#: Prefixes are long enough that two sets that link share this many of their shingles.
SHARED = 2
#: Rows of a block when what is left of a long posting list is compared block by block, and bytes of sets in one.
BLOCK, BLOCK_BYTES = 1500, 12 << 20
#: Lists of a set that are remembered as ahead of a later one; pairs that share none of them may be verified in more than one list.
AHEAD = 64
#: Classes (24 bytes each) whose list is broadcast; the texts of more are found by a shuffled join.
FEW = 1_000_000
BASE = 0x9FB21C651E98DF25


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text as 64-bit names; a shorter text is one shingle."""
    codes, words, bounds = words_of(texts)
    names = word_names(pc.ascii_lower(words), 31)[codes]
    rolled = np.zeros(max(len(names) - n + 1, 0), np.uint64)
    for i in range(n):
        rolled = rolled * np.uint64(BASE) + names[i : i + len(rolled)]
    rolled = mix(rolled, 32)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        else:
            short = reduce(lambda x, y: x * np.uint64(BASE) + y, names[a:b, None], np.array([b - a], np.uint64))
            out.append(mix(short[: b - a], 33))
    return out


def set_sketch(own: np.ndarray) -> bytes:
    """A set's sketch for the suffix filter; counts stop at 255."""
    counts = np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)
    odd = np.bincount((own & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return counts.tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH_BYTES)


def least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number of shingles that two sets at least differ by: what their counts differ by, and the parts where the parity does."""
    counts = np.abs(x[..., :BUCKETS].astype(np.int16) - y[..., :BUCKETS]).sum(axis=-1)
    return np.maximum(counts, np.bitwise_count(x[..., BUCKETS:] ^ y[..., BUCKETS:]).sum(axis=-1, dtype=np.int64))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, cls, n, buckets) for each document, cls naming its set; and pieces (part, task, counts) of each task's frequency sketch."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("buckets", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        ids = pa.array([], pa.int64())
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), n)
            counts += np.bincount((np.concatenate(sets) & np.uint64(counts.size - 1)).astype(np.int64), minlength=counts.size)
            ids, k = batch.column("doc_id"), len(sets)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("text_hash"), pa.array([np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(set_sketch, sets), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                schema.names,
            )
        k = SKETCH_PARTS
        parts = [p.astype("<i8").tobytes() for p in np.split(counts, k)]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(parts, pa.binary())], schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(signed, schema)


def frequency_levels(signed: DataFrame) -> np.ndarray:
    """The sketch of all tasks summed, as 4 log2 of each counter: 2**SKETCH_BITS bytes whatever the input."""
    found = summed(signed.where("part IS NOT NULL").select("part", "task", F.col("counts").alias("data")), "<i8")
    none = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, "<i8")
    return (4 * np.log2(np.concatenate([found.get(k, none) for k in range(SKETCH_PARTS)]) + 1)).astype(np.uint8)


def prefixes(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(token, cls, n, pos): each set's first shingles, rarest first by the sketch, enough of them that two sets that link have SHARED in common."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.astype(np.uint64)
        for batch in slices(batches):
            token, cls, size, pos = [], [], [], []
            for own in shingle_sets(batch.column("text"), n):
                if k := len(own):
                    most = min(k, k - -(-percent * k // 100) + SHARED)
                    rank = level[(own & np.uint64(level.size - 1)).astype(np.int64)] << np.uint64(56) | own >> np.uint64(8)
                    first = np.argpartition(rank, most - 1)[:most]
                    token.append(own[first[np.argsort(rank[first])]])
                    cls.append(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())))
                    size.append(k)
                    pos.append(np.arange(most))
            if token:
                many = [len(t) for t in token]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(np.array(cls, np.uint64), many).view(np.int64)), pa.array(np.repeat(np.array(size), many)), pa.array(np.concatenate(pos))], ["token", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(rare, "token long, cls long, n long, pos long")


def may_link(percent: int) -> str:
    """The length and positional filters for postings x and y of one token, right for the first SHARED tokens that they have in common."""
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * (least(x.n - x.pos, y.n - y.pos) + {SHARED - 1}) >= {percent} * (x.n + y.n)"


def suffix_filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for the overlap."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (sketches(batch.column(c)) for c in ("xb", "yb"))
                total = np.asarray(batch.column("xn")) + np.asarray(batch.column("yn"))
                ok = least_difference(x, y) <= total - 2 * -(-percent * total // (100 + percent))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("xn"), F.col("buckets").alias("xb"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("yn"), F.col("buckets").alias("yb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xn", "xb", "yn", "yb").mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in batches:
            for batch in slices(iter([wide]), "xt", 1 << 20):
                every = pa.concat_arrays([batch.column("xt"), batch.column("yt")]).dictionary_encode()
                sets = shingle_sets(every.dictionary, n)
                at, k = np.asarray(every.indices), batch.num_rows
                ok = []
                for i, j in zip(at[:k].tolist(), at[k:].tolist(), strict=True):
                    x, y = sets[i], sets[j]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("xt"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("yt"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xt", "yt").mapInArrow(exact, "a long, b long")


def in_units(lists: DataFrame, blocks: Column) -> DataFrame:
    """lists with one row for each pair of blocks (one, two) of its list that the row takes part in; own says in which block it is."""
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    return lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("other")


def met_in_unit(table: pa.Table, sketch: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a unit's first block, the rows of its second that pass the length, positional and suffix filters, are not connected yet and meet first in this list."""
    own = table.column("own").to_numpy()
    cls, n, pos, comp = (table.column(c).to_numpy() for c in ("cls", "n", "pos", "comp"))
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
    # the tokens of other open lists ahead of this one, as codes, a row to each set; the last code stands for none
    ahead = table.column("ahead").combine_chunks()
    known, codes = np.unique(np.asarray(ahead.flatten()), return_inverse=True)
    sizes = np.diff(np.asarray(ahead.offsets))
    wide = np.full((len(cls), max(1, sizes.max(initial=0))), len(known))
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = codes
    mark = np.zeros(len(known) + 1, bool)
    for i in left.tolist():
        j = right[comp[right] != comp[i]]
        if one == two:
            j = j[cls[j] > cls[i]]
        total = n[i] + n[j]
        j = j[(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) + SHARED - 1 >= -(-percent * total // (100 + percent)))]
        total = n[i] + n[j]
        j = j[least_difference(sketch[j], sketch[i]) <= total - 2 * -(-percent * total // (100 + percent))]
        if len(j):
            before = wide[i][wide[i] < len(known)]
            mark[before] = True
            j = j[~mark[wide[j]].any(axis=1)]
            mark[before] = False
        if len(j):
            yield i, j


def promising(lists: DataFrame, percent: int) -> DataFrame:
    """(token, cls): the rows of open lists that have a partner left to verify, found block against block on the sketches."""

    def compare(table: pa.Table) -> pa.Table:
        found = np.zeros(table.num_rows, bool)
        for i, j in met_in_unit(table, sketches(table.column("buckets")), percent):
            found[i] = True
            found[j] = True
        return table.select(["token", "cls"]).filter(pa.array(found))

    columns = ["token", "cls", "n", "pos", "comp", "ahead", "buckets"]
    units = in_units(lists.select("k", *columns), F.ceil(F.col("k") / BLOCK).cast("int"))
    return units.groupBy("token", "one", "two").applyInArrow(compare, "token long, cls long").distinct()


def shared_sizes(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements a sorted set has in common with each of others, none of them empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    first = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((own[at] == flat).astype(np.int64), first)


def block_links(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components, verified on the whole sets, as a forest of each pair of blocks.

    lists has the set of each class in `own_set`. A block holds about BLOCK_BYTES of sets.
    """

    def link(table: pa.Table) -> pa.Table:
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("own_set").to_pylist()]
        sketch = sketches(pa.array(map(set_sketch, sets), pa.binary()))
        _, root = np.unique(table.column("comp").to_numpy(), return_inverse=True)
        a, b = [], []
        for i, met in met_in_unit(table, sketch, percent):
            for j in np.array_split(met, -(-int(n[met].sum()) // 1_000_000)):
                j = j[root[j] != root[i]]
                if len(j):
                    both = shared_sizes(sets[i], [sets[x] for x in j])
                    for x in j[100 * both >= percent * (n[i] + n[j] - both)].tolist():
                        if root[x] != root[i]:
                            root[root == root[x]] = root[i]
                            a.append(min(cls[i], cls[x]))
                            b.append(max(cls[i], cls[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sizes = lists.groupBy("token").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    units = in_units(lists.join(sizes, "token"), F.col("blocks")).select("token", "one", "two", "own", "cls", "n", "pos", "comp", "ahead", "own_set")
    return units.groupBy("token", "one", "two").applyInArrow(link, "a long, b long").distinct()


def whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """(cls, own_set): each class's sorted set as little-endian 64-bit names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), n)], pa.binary())], ["cls", "own_set"])

    return texts.select("cls", "text").mapInArrow(sets, "cls long, own_set binary")


def labelled(links: DataFrame, lists: DataFrame) -> DataFrame:
    """lists with comp: the component of cls so far, itself if it has none."""
    comp = components(links).select(F.col("id").alias("cls"), F.col("component"))
    return lists.drop("comp").join(comp, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def similar_links(docs: DataFrame, signed: DataFrame, n: int, percent: int, rounds: int) -> DataFrame:
    """(a, b) pairs of cls: links whose components are those of all links of the join."""
    sets = cut(signed.where("part IS NULL AND n > 0").groupBy("cls", "n").agg(F.min(F.struct("text_hash", "doc_id")).alias("rep"), F.max("buckets").alias("buckets")))
    postings = prefixes(docs, n, percent, frequency_levels(signed))
    # the copies of a set are one row, as each task folds what it has of them
    found = postings.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("token")
    postings = cut(postings.join(found, "token", "left_semi").distinct())
    lengths = postings.groupBy("token").agg(F.count("*").alias("k"))
    sized = cut(postings.join(lengths, "token"))
    short = sized.where(F.col("k") <= SHORT)
    pairs = short.alias("x").join(short.alias("y"), F.expr("x.token = y.token AND x.cls < y.cls AND " + may_link(percent))).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    # what links shares SHARED tokens here, or one in a long list, where it is compared again; most chance meetings are over one token
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("met")).where(F.col("met") >= SHARED).select("a", "b")
    tried = cut(suffix_filtered(pairs, sets, percent))
    lists = sized.where(F.col("k") > SHORT)

    # one text of each class that may have to be verified
    wanted = tried.select(F.explode(F.array("a", "b")).alias("cls")).union(lists.select("cls")).distinct()
    wanted = cut(wanted.join(sets, "cls").select("cls", "rep.*"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = cut(own.join(wanted, F.expr("hash = text_hash AND id <=> doc_id")).groupBy("cls").agg(F.min("text").alias("text")))
    links = cut(verified(tried, texts, n, percent))

    # long lists: all against a few pivots, then what is not yet connected, block by block
    if lists.isEmpty():
        return links
    lists = cut(labelled(links, lists.join(sets.select("cls", "buckets"), "cls")))
    for number in range(rounds):
        open_lists = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64("cls", F.lit(number)).alias("h"), "cls", "n", "pos", "comp")).alias("p")).where("low < high")
        lists = lists.join(open_lists.select("token"), "token", "left_semi")
        star = lists.alias("x").join(open_lists.select("token", "p.*").alias("y"), F.expr("x.token = y.token AND x.cls <> y.cls AND x.comp <> y.comp AND " + may_link(percent)))
        star = star.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        star = cut(suffix_filtered(star, sets, percent))
        if star.isEmpty():
            break
        tried = tried.union(star)
        links = cut(links.union(verified(star, texts, n, percent)))
        lists = cut(labelled(links, lists))
    still = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    lists = lists.join(still, "token", "left_semi")
    # a pair is verified in the first open list that its sets share, as far as the AHEAD first ones of either tell
    heads = lists.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, AHEAD).alias("head"))
    lists = cut(lists.join(heads, "cls").withColumn("ahead", F.transform(F.filter("head", lambda h: h["pos"] < F.col("pos")), lambda h: h["token"])).drop("head"))
    left = cut(promising(lists, percent))
    if left.isEmpty():
        return links
    sets_left = whole_sets(texts.join(left.select("cls").distinct(), "cls", "left_semi"), n)
    rest = lists.drop("buckets", "k").join(left, ["token", "cls"], "left_semi").join(sets_left, "cls")
    return cut(links.union(block_links(rest, percent)))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct n-word shingles after A-Z is lower-cased;
    with fewer words the whole sequence is one shingle; without words the set is
    empty and links with nothing. Documents whose sets have a Jaccard similarity
    of at least percent / 100 link, and component_id is the smallest id reachable.

    Equal sets are one class. Each class is posted under its rarest shingles by
    a frequency sketch over all documents (any one order is right, rare first is
    fast); classes that share a posting pass the length, positional and suffix
    filters and are verified on their whole texts, once. Pairs that links found
    before already connect are not expanded: long lists are compared with a few
    pivots first. Of what stays unconnected, block by block, the rows with a partner
    are found on the sketches, then verified on whole sets where a pair meets first;
    a task returns a forest of its links, never all pairs.

    A null text is empty. Rows repeated with one id count as one document with
    the id. A null id is in the component of its set's smallest id, or null. An
    empty table gives an empty result. Other columns are not read.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50: below, sets may link over a single shingle")
    signed = cut(signatures(docs, n))
    links = similar_links(docs, signed, n, percent, rounds)
    own = signed.where("part IS NULL").select("doc_id", "cls", "n")
    rep = cut(own.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")))
    edges = links.join(rep.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b")
    comp = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    to = cut(rep.join(comp, F.col("rep") == F.col("id"), "left").select("cls", F.coalesce("component", "rep").alias("component_id")))
    full = own.where("n > 0").join(to, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group that links connect: the one with the smallest id.

    Documents without words all stay. Rows repeated with one id share their fate.
    """
    gone = jaccard_components(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
