"""Removal of repeated passages: recompression names token runs and pairs, shared names reveal and verify long repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, slices, text_of, word_names, words_of

#: The rounds of the first parse: "run" names runs of one symbol, "pair" names pairs.
ROUNDS = ("run", "pair", "pair", "pair", "pair", "pair", "pair")
#: The rounds of the second parse, which names long passages.
LONG_ROUNDS = ("run", "pair", "pair", "pair") * 6
#: Odd multipliers of the fingerprints of word ranges.
BASES = (0xD6E8FEB86659FD93, 0xCA5A826395121157)
ONE = np.uint64(1)


def next_round(number: int, kind: str, names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """One round over the symbols of many documents: where each new symbol begins among the old ones, its name, and for pairs its side.

    A name is a function of what it stands for, so tasks that never meet name
    equal substrings alike. Sides are drawn from the names: a pair is a symbol
    of one side and the next one of the other.
    """
    same = doc[1:] == doc[:-1]
    if kind == "run":
        head = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | ~same)))
        count = np.diff(np.append(head, len(names))).astype(np.uint64)
        return head, np.where(count > ONE, mix(names[head] + mix(count, 7), 2000 + number), names[head]), None
    first = (mix(names, number) & ONE) == 0
    joined = np.append(first[:-1] & ~first[1:] & same, False)
    head = np.flatnonzero(~np.concatenate(([False], joined[:-1])))
    new = names[head]
    pairs = joined[head]
    at = head[pairs]
    new[pairs] = mix(names[at] * np.uint64(0x9FB21C651E98DF25) + names[at + 1], 1000 + number)
    return head, new, first[head]


def parse(names: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, ...]:
    """Recompress many documents at once: (name, document, low, high) of the symbols after the rounds.

    names and docs hold a name and a document number for each word, starts and
    ends the range of words of each document. [low, high) is the range of words
    that the symbol depends on: its own and those its neighbours' choices rest
    on. Wherever these words recur the same symbol recurs. A symbol that depends
    on where its document starts or ends is left out.
    """
    n = len(names)
    low = np.arange(n, dtype=np.int64)
    high = low + 1
    doc = docs
    for number, kind in enumerate(rounds, 1):
        if len(names) < 2:
            break
        same = doc[1:] == doc[:-1]
        # what a symbol depends on if it looks at its neighbour; beyond the document is out of every window
        left = np.concatenate(([-1], np.where(same, low[:-1], -1)))
        right = np.append(np.where(same, high[1:], n + 1), n + 1)
        head, new, side = next_round(number, kind, names, doc)
        last = np.append(head[1:], len(names)) - 1
        new_low, new_high = np.minimum(low[head], low[last]), np.maximum(high[head], high[last])
        looks_left = looks_right = np.ones(len(head), bool)
        if side is not None:  # a symbol that stays alone has looked at the neighbour that it might have joined
            looks_left, looks_right = (last == head) & ~side, (last == head) & side
        low = np.where(looks_left, np.minimum(new_low, left[head]), new_low)
        high = np.where(looks_right, np.maximum(new_high, right[last]), new_high)
        names, doc = new, doc[head]
    ok = (low >= starts[doc]) & (high <= ends[doc])
    return names[ok], doc[ok], low[ok], high[ok]


def long_symbols(names: np.ndarray, docs: np.ndarray, least: int, rounds=LONG_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, end): every symbol that a round makes of `least` words or more, with the range of words that it stands for."""
    start, doc = np.arange(len(names)), docs
    n = len(names)
    found = []
    for number, kind in enumerate(rounds, 1):
        if len(names) < 2:
            break
        head, names, _ = next_round(number, kind, names, doc)
        made = np.diff(np.append(head, len(start))) > 1
        start, doc = start[head], doc[head]
        end = np.append(start[1:], n)
        made &= end - start >= least
        found.append((names[made], start[made], end[made]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)


class Prints:
    """Fingerprints of any ranges of words: polynomials modulo 2**64, from prefix sums."""

    def __init__(self, names: np.ndarray, base: int):
        n = len(names)
        inverse = np.uint64(pow(base, -1, 1 << 64))
        self.back = np.cumprod(np.concatenate(([ONE], np.full(n, inverse, np.uint64))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(names * np.cumprod(np.concatenate(([ONE], np.full(max(0, n - 1), base, np.uint64))))[:n])))

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64), 5)


def symbols(docs: DataFrame, window: int, rounds=ROUNDS) -> DataFrame:
    """(name, row, at): each symbol that fits a window, at = low * 256 + (high - low); and one row with at = -words - 1 for each document."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, words, bounds = words_of(batch.column("text"))
            rows, starts, ends = np.asarray(batch.column("row")), bounds[:-1], bounds[1:]
            name, at_doc, low, high = parse(word_names(words, 11)[codes], np.repeat(np.arange(len(rows)), ends - starts), starts, ends, rounds)
            fits = high - low <= window
            name, at_doc, low, high = name[fits], at_doc[fits], low[fits], high[fits]
            name = np.concatenate((name.view(np.int64), mix(rows.view(np.uint64), 99).view(np.int64)))
            at = np.concatenate(((low - starts[at_doc]) * 256 + high - low, starts - ends - 1))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.concatenate((rows[at_doc], rows))), pa.array(at)], ["name", "row", "at"])

    return docs.mapInArrow(parsed, "name long, row long, at long")


def open_windows(alone: DataFrame, window: int) -> DataFrame:
    """(row, spans): the runs [first, end) of window starts that hold no symbol that is alone; documents without any are left out."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, ats in zip(batch.column("row").to_pylist(), batch.column("ats"), strict=True):
                at = np.asarray(ats.values)
                n = int(-at.min() - 1) - window + 1  # window starts
                if n <= 0:
                    continue
                at = at[at >= 0]
                low, high = at >> 8, (at >> 8) + (at & 255)
                first, end = np.clip(high - window, 0, n), np.clip(low + 1, 0, n)
                cover = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n]
                edge = np.flatnonzero(np.diff(np.concatenate(([1], (cover > 0).astype(np.int8), [1]))))
                if len(edge):
                    rows.append(row)
                    out.append(edge)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["row", "spans"])

    return alone.groupBy("row").agg(F.collect_list("at").alias("ats")).mapInArrow(spans, "row long, spans array<long>")


def spread(spans: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans [first, end) of window starts of many rows, as places among all words: row of each span, first, end."""
    edges = np.asarray(spans.flatten())
    row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)) // 2)
    return row, edges[::2] + bounds[row], edges[1::2] + bounds[row]


def passages(opened: DataFrame, window: int) -> DataFrame:
    """(name, print, row, first, size): the long symbols of each run of open windows, which is parsed as a text of its own.

    And a row (row, spans, words) for each document: the words of its runs, all
    that later rounds need of it.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, words, bounds = words_of(batch.column("text"))
            at, first, end = spread(batch.column("spans"), bounds)
            many = end - first + window - 1
            ahead = np.cumsum(many) - many
            place = np.arange(many.sum()) + np.repeat(first - ahead, many)
            own = codes[place]
            span = np.repeat(np.arange(len(at)), many)
            name, a, b = long_symbols(word_names(words, 31)[own], span, window)
            check = Prints(word_names(words, 32)[own], BASES[0]).of(a, b)
            rows = np.asarray(batch.column("row"))[at[span[a]]]
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(check.view(np.int64)), pa.array(rows), pa.array(place[a] - bounds[at[span[a]]]), pa.array(b - a), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.string())], names)
            k = batch.num_rows
            sizes = np.bincount(at, weights=many, minlength=k).astype(np.int64)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), words.take(pa.array(own))), " ")
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, batch.column("row"), none, none, batch.column("spans"), texts], names)

    names = ["name", "print", "row", "first", "size", "spans", "words"]
    return opened.mapInArrow(parsed, "name long, print long, row long, first long, size long, spans array<long>, words string")


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges [first, end)."""
    step = np.bincount(np.minimum(first, n), minlength=n + 1) - np.bincount(np.minimum(end, n), minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def windows(opened: DataFrame, window: int) -> DataFrame:
    """(w1, w2, row, pos): two fingerprints of each open window in none of the passages in `found`; and, with pos -1, of each in a passage that is the first of its kind."""

    def to_compare(spans: pa.Scalar, found: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        edges = np.asarray(spans.values)
        is_open = covered(int(edges.max(initial=0)), edges[::2], edges[1::2])
        if not found.is_valid:
            return np.flatnonzero(is_open), np.zeros(0, np.int64)
        first, size, rep = (np.asarray(found.values.field(k)) for k in ("first", "size", "rep"))
        end = first + size - window + 1
        settled = covered(len(is_open), first, end)
        return np.flatnonzero(is_open & ~settled), np.flatnonzero(is_open & covered(len(is_open), first[rep > 0], end[rep > 0]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", most=1 << 20):
            codes, words, bounds = words_of(batch.column("words"))
            prints = [Prints(word_names(words, seed)[codes], base) for seed, base in zip((21, 22), BASES, strict=True)]
            start, row, pos = [], [], []
            for at, own, spans, found in zip(bounds.tolist(), batch.column("row").to_pylist(), batch.column("spans"), batch.column("found"), strict=False):
                edges = np.asarray(spans.values)
                # where each run of open windows begins among the words that are left
                shift = at + np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2] + window - 1)[:-1])) - edges[::2]
                for sure, p in enumerate(to_compare(spans, found)):
                    start.append(p + shift[np.searchsorted(edges[::2], p, "right") - 1])
                    row.append(np.full(len(p), own, np.int64))
                    pos.append(np.full(len(p), -1, np.int64) if sure else p)
            start, row, pos = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (start, row, pos))
            yield pa.RecordBatch.from_arrays([*(pa.array(p.of(start, start + window).view(np.int64)) for p in prints), pa.array(row), pa.array(pos)], ["w1", "w2", "row", "pos"])

    return opened.select("row", "spans", "words", "found").mapInArrow(rows, "w1 long, w2 long, row long, pos long")


def remove_repeats(docs: DataFrame, window: int = 35, rounds=ROUNDS) -> DataFrame:
    """docs with the kept words joined by one space as text, and n_words and n_removed.

    Words are runs of anything but ASCII white space. A word goes if it is in a
    window of `window` words whose sequence also starts anywhere else, in another
    row or the same one. Windows are judged on the input.

    Documents are recompressed in rounds of runs and pairs whose names are
    functions of what they stand for, so all tasks name equal substrings alike.
    Two Spark rounds count the names of all documents. In the first, a symbol
    that is found once closes every window that holds all it depends on. In the
    second, the runs of windows left open are recompressed on to passages of
    `window` words and more; one whose name and fingerprint are found twice
    settles all windows in it as repeats. The windows at the edges of such
    passages and in texts too short or too regular for long symbols are counted
    by 128-bit fingerprints of their own, against each other and against one
    occurrence of each passage.

    A null text has no words and becomes the empty text. Repeated rows are
    repeats of each other. Rows are told apart by a 64-bit hash of id and text.
    An empty table gives an empty result. Other columns pass unchanged, under
    any names; n_words and n_removed are replaced.
    """
    docs = docs.drop("n_words", "n_removed")
    columns = [f.name for f in docs.schema.fields]
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), text_of()).alias("row"), F.struct("*").alias("doc"))
    slim = docs.select(F.xxhash64(F.col("doc_id").cast("string"), text_of()).alias("row"), "text")
    named = symbols(slim, window, rounds)
    alone = named.groupBy("name").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("at").alias("at")).where("n = 1 OR at < 0").select("row", "at")
    spans = cut(open_windows(alone, window))

    found = cut(passages(slim.join(spans, "row"), window))
    long = found.where("words IS NULL").select("name", "print", "row", "first", "size")
    twice = long.groupBy("name", "print", "size").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("rep")).where("n > 1").drop("n")
    one = (F.struct("row", "first") == F.col("rep")).cast("int").alias("rep")
    settled = cut(long.join(twice, ["name", "print", "size"]).select("row", F.struct("first", "size", one).alias("p")).groupBy("row").agg(F.collect_list("p").alias("found")))

    rows = windows(found.where("words IS NOT NULL").select("row", "spans", "words").join(settled, "row", "left"), window)
    once = rows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos")).where("n = 1 AND pos >= 0")
    closed = once.groupBy("row").agg(F.collect_list("pos").alias("shut"))
    verdict = cut(spans.join(closed, "row", "left"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    at_text = f"c{columns.index('text')}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_text):
            texts, n_words, n_removed = [], [], []
            own = [batch.column(f"c{i}") for i in range(len(columns))]
            for text, spans, shut in zip(batch.column(at_text).cast(pa.binary()).to_pylist(), batch.column("spans"), batch.column("shut"), strict=True):
                words = (text or b"").split()
                kept = words
                if spans.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    edges = np.asarray(spans.values)
                    hit = np.zeros(len(words), bool)
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        hit[a:b] = True
                    if shut.is_valid:
                        hit[np.asarray(shut.values)] = False
                    at = np.flatnonzero(hit)
                    step[at] += 1
                    step[at + window] -= 1
                    gone = np.cumsum(step)[:-1] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                texts.append(b" ".join(kept))
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(new if c == "text" else x for c, x in zip(columns, own, strict=True)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*columns, "n_words", "n_removed"])

    joined = keyed.join(verdict, "row", "left")
    return joined.select(*(F.col("doc")[c].alias(f"c{i}") for i, c in enumerate(columns)), "spans", "shut").mapInArrow(clean, schema)
