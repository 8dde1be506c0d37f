"""Best-fit packing into sequences, repacked until lower bounds certify it."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held, slices, words_of

#: Encoded words that a Python worker keeps from task to task, twice: those met lately, and those before them.
WORDS = 200_000
#: Bytes of text encoded at once: the more, the fewer words are looked up twice.
SLICE = 6 << 20
#: Words or texts given to the tokenizer at once: an encoding is large.
BATCH = 2000
#: The token after each document.
END = 1
# How a tokenizer must part texts so that their words can be encoded one by one.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ("NFC", "Replace", "Lowercase")
#: Words of Latin letters that NFC leaves alone and that lower-case letter by letter, and ASCII punctuation behind them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in turn from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoded:
    """Words to their ids as little-endian unsigned 32-bit bytes.

    Where the tokenizer's own description says that it parts texts at white
    space and letters from what follows them, and adds nothing, a text's ids are
    its words' ids in turn, and a word of plain Latin letters is encoded by the
    model alone, punctuation at its end on its own. Texts of any other tokenizer
    are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text())
        normal, parts, model = ((told.get(k) or {}) for k in ("normalizer", "pre_tokenizer", "model"))
        split, level = (parts.get("pretokenizers") or [{}, {}])[:2]
        self.by_words = (
            tuple(x["type"] for x in normal.get("normalizers", ())) == NORMAL
            and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": PARTS}, "Removed", True)
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and len(parts["pretokenizers"]) == 2
            and not told.get("post_processor")
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and all(x["special"] and x["content"].startswith("<|") for x in told.get("added_tokens", ()))
        )
        self.letters = byte_letters()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def plain(self, word: str) -> bytes:
        """The ids of a word that is one piece."""
        low = word.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.whole.model.tokenize(low)]).tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        recent, older = self.recent, self.older
        out = [recent.get(w) for w in words]
        rest = []
        for i in [i for i, x in enumerate(out) if x is None]:
            w = words[i]
            ids = older.get(w)
            if ids is None:
                found = PLAIN.fullmatch(w)
                if not found:
                    rest.append(i)
                    continue
                ids = self.plain(found[1])
                if tail := found[2]:
                    if tail not in recent:
                        recent[tail] = array("I", self.whole.encode(tail, add_special_tokens=False).ids).tobytes()
                    ids += recent[tail]
            recent[w] = out[i] = ids
        for at in range(0, len(rest), BATCH):
            some = [words[i] for i in rest[at : at + BATCH]]
            for i, w, e in zip(rest[at : at + BATCH], some, self.whole.encode_batch(some, add_special_tokens=False), strict=True):
                recent[w] = out[i] = array("I", e.ids).tobytes()
        if len(recent) > WORDS:
            self.older, self.recent = recent, {}
        return out


def document_ids(texts: pa.Array, known: Encoded) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts one after another, each with the end token, and the bounds of each text's ids."""
    if known.by_words:
        codes, words, bounds = words_of(texts)
        own = known.ids_of(words.to_pylist())
    else:
        own = []
        for at in range(0, len(texts), 100):
            own += [array("I", e.ids).tobytes() for e in known.whole.encode_batch([t or "" for t in texts[at : at + 100].to_pylist()], add_special_tokens=False)]
        codes, bounds = np.arange(len(own)), np.arange(len(own) + 1)
    codes = np.insert(codes, bounds[1:], len(own))  # the end token is one more word
    own.append(np.array([END], "<u4").tobytes())
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    flat = np.frombuffer(b"".join(own), "<u4")
    first = np.cumsum(size) - size
    sizes = size[codes]
    ahead = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(ahead[-1], dtype=np.int32) + np.repeat((first[codes] - ahead[:-1]).astype(np.int32), sizes)
    return flat[at], ahead[bounds + np.arange(len(bounds))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, order: list[Column], with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row[, ids]): documents cut only where longer than `capacity` tokens; row holds the values of `order`."""
    rows_of = docs.select("doc_id", "text", F.struct(*order).alias("row"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), rows_of.schema["row"]])
    schema = schema.add("ids", T.ArrayType(T.LongType())) if with_ids else schema

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(tokenizer, lambda: Encoded(tokenizer))
        for batch in slices(batches, most=SLICE, holds=tokenizer):
            rows, out, ids = [], [], []
            flat, ends = document_ids(batch.column("text"), known)
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                for k, at in enumerate(range(a, b, capacity)):
                    piece = flat[at : min(b, at + capacity)]
                    rows.append(i)
                    out.append((k, at - a, len(piece), zlib.crc32(piece)))
                    if with_ids:
                        ids.append(piece.astype(np.int64))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)]
            doc_id, row = (batch.column(n).take(pa.array(rows)) for n in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays([doc_id, *columns, row, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], schema.names)

    return rows_of.mapInArrow(encoded, schema)


def numbered(items: DataFrame, name: str, *by: str | Column) -> tuple[DataFrame, int]:
    """items with a column that numbers the rows in an order, from 0 on without gaps, and how many they are."""
    run = cut(
        items.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row for each partition of the sort
    ahead, total = [], 0
    for r in run.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        ahead.append((r["__part"], total))
        total += r["n"]
    offsets = F.broadcast(items.sparkSession.createDataFrame(ahead, "__part int, __ahead long"))
    return run.join(offsets, "__part").withColumn(name, F.col("__ahead") + F.col("__i")).drop("__part", "__i", "__ahead"), total


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, by best-fit decreasing: the longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0  # the bits of open_rooms say which amounts of room some bin has
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        if fits := open_rooms >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b, used = capacity, used, used + 1
        bins[item] = b
        if r - n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins: the best of dual-feasible functions over the lengths.

    The plain sum; the family that for a threshold t counts lengths over
    capacity - t as whole bins, drops those below t and keeps the rest; and the
    rounding family u_k, for k = 1 to 20.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(n: np.ndarray, capacity: int) -> int:
    """The lower bound for n[x] pieces of each length x."""
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    many, weight = np.cumsum(n), np.cumsum(n * size)
    for t in range(1, capacity // 2 + 1):
        whole = int(many[capacity] - many[capacity - t])
        rest = int(weight[capacity - t] - weight[t - 1])
        best = max(best, whole + -(-rest // capacity))
    for k in range(1, 21):
        up = size * (k + 1)
        u = np.where(up % capacity == 0, size * k, up // capacity * capacity)
        best = max(best, -(-int((n * u).sum()) // (k * capacity)))
    return best


def packed(items: DataFrame, capacity: int) -> DataFrame:
    """Each part packed on its own: the sequence's number, which is the place of its longest piece, the piece's offset in it, in the order of places, and its fill."""
    fields = [f for f in items.schema.fields if f.name not in ("sequence_id", "offset", "fill")]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "fill"))])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        lengths, place = table.column("length").to_numpy(), table.column("place").to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        ahead = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([True], np.diff(bins[order]) > 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ahead - np.maximum.accumulate(np.where(first, ahead, 0))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        leads = np.lexsort((place, -lengths, bins))[np.flatnonzero(first)]
        own = {"sequence_id": place[leads][bins], "offset": offset, "fill": fill[bins]}
        return pa.table([*(table.column(f.name) for f in fields), *(pa.array(own[n], pa.int64()) for n in own)], names=[*(f.name for f in fields), *own])

    return items.select(*(f.name for f in fields)).groupBy("part").applyInArrow(pack, schema)


def fills(state: DataFrame) -> list[tuple[int, int, int]]:
    """(fill, sequences, pieces) from the emptiest on: a row for each fill at most."""
    rows = state.groupBy("fill").agg(F.count_if(F.col("sequence_id") == F.col("place")).alias("sequences"), F.count("*").alias("pieces")).collect()
    return sorted((r["fill"], r["sequences"], r["pieces"]) for r in rows)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, group: int = 50_000, rounds: int = 4, with_ids: bool = False, order: list[Column] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    Documents are encoded whole, an end token is added, and only those over
    `capacity` tokens are cut. All pieces are put in the order of the columns
    `order` (of the rows as they are read, if none are given); ranges of it of at
    most `group` pieces are packed apart by best-fit decreasing. A sequence's
    number is the place of its longest piece in the order, so the sequences
    follow the order too.

    A dual-feasible lower bound over all pieces' lengths certifies the number of
    sequences. While the number misses it, sequences that are not full give
    their pieces to an exchange and are packed again: in turn the emptiest ones
    together, `group` pieces at most, and all of them, each length dealt evenly to the parts. This ends
    after `rounds`, or when neither way saves a sequence; each round is written
    to the shared folder. certified tells whether the number of all sequences
    meets the bound.

    A null or empty text is the end token alone. Repeated rows are packed each
    on their own; null ids stay null. An empty table gives an empty result.
    Other columns are not read.
    """
    items = cut(pieces(docs, tokenizer, capacity, order or [F.monotonically_increasing_id()], with_ids))
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    bound = bound_of(counts, capacity)
    placed, total = numbered(items, "place", "row", "piece")
    parts = max(1, -(-total // group))
    state = cut(packed(placed.drop("row").withColumn("part", F.expr(f"(place * {parts}) div {max(1, total)}")), capacity))
    level, idle = fills(state), 0
    for number in range(1, rounds + 1):
        sequences = sum(n for _, n, _ in level)
        loose = [x for x in level if x[0] < capacity]
        if sequences <= bound or idle == 2:
            break
        if number % 2:  # the emptiest, as many as one part holds
            sums = np.cumsum([n for _, _, n in loose])
            loose = loose[: int(np.searchsorted(sums, group, "right"))]
        n = sum(x[2] for x in loose)
        own = sum(x[1] for x in loose)
        if own < 2:
            idle += 1
            continue
        given = F.col("fill") <= loose[-1][0]
        again, parts = state.where(given), -(-n // group)
        if parts > 1:  # every part gets its share of each length
            again, _ = numbered(again, "__deal", "length", F.xxhash64("place", F.lit(number)))
            again = again.withColumn("part", F.col("__deal") % parts).drop("__deal")
        else:
            again = again.withColumn("part", F.lit(0).cast("long"))
        new = cut(packed(again, capacity))
        after = fills(new)
        if sum(x[1] for x in after) >= own:
            idle += 1
            continue
        state, idle = state.where(~given).unionByName(new.select(*state.columns)), 0
        level = fills(state)
    certified = sum(n for _, n, _ in level) == bound
    return state.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset", F.lit(certified).alias("certified"))
