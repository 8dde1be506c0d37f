"""Text and answer columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The section types that hold no prose.
NO_PROSE = ("TABLE", "REF", "COMP_INT", "AUTH_CONT", "SUPPL")
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: what stands in a lambda is else worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scrub_control(s: Column) -> Column:
    """Without the control bytes that XML forbids."""
    return F.regexp_replace(s, CONTROL, "")


def scrub_escapes(s: Column) -> Column:
    """Table markup without spelled-out byte escapes."""
    return F.regexp_replace(s, r"\\x..", "")


def scrub_newlines(s: Column) -> Column:
    """Cell text without spelled-out line ends."""
    return F.replace(s, F.lit("\\n"), F.lit(""))


def unescape_text(s: Column) -> Column:
    """Spelled-out escapes (\\n, \\t, \\r, \\\\ and \\xNN in UTF-8) resolved; the text itself where that fails."""

    @F.pandas_udf("string")
    def resolve(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return t.encode("utf-8").decode("unicode_escape").encode("latin-1").decode("utf-8")
            except (AttributeError, UnicodeError):
                return t

        return texts.map(one)

    # few texts have a backslash: only they go to Python, once (what is not deterministic is not copied into filters)
    escaped = F.instr(s, "\\") > 0
    return F.when(escaped, resolve.asNondeterministic()(F.when(escaped, s))).otherwise(s)


def is_prose(section_type: Column) -> Column:
    return ~F.upper(F.coalesce(section_type, F.lit(""))).isin(*NO_PROSE)


def strip(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def answer_key(s: Column) -> Column:
    """The form in which two answer lines are the same: lower case, without outer asterisks."""
    return F.trim(F.btrim(F.lower(s), F.lit("*")))


def is_number(s: Column) -> Column:
    """Whether a cell reads as a number; a type suffix makes it text."""
    return F.coalesce(s.try_cast("double").isNotNull() & ~s.rlike("[dDfF]$"), F.lit(False))


def present_or(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


def answer_lines(answer: Column) -> Column:
    """An answer's lines, stripped, without blank ones."""
    return F.filter(F.transform(F.split(answer, r"\r\n|\r|\n"), strip), lambda x: x != "")


def says_something(answer: Column) -> Column:
    """Not one of the answers that say none, unless they say what they contain."""
    low = F.lower(answer)
    return ~F.contains(low, F.lit("none")) | F.contains(low, F.lit("contain"))


def alternatives(in_trans: Column) -> Column:
    """The variants of a curated in-trans cell; null where it says there are none."""
    return F.when(in_trans != "NA", F.split(in_trans, " +"))


def fixed_chunks(text: Column, width: int = 1500, overlap: int = 100) -> Column:
    """Windows of `width` characters, each `overlap` into the one before."""
    stride = width - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / stride), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * stride + 1, F.lit(width)))


#: Where texts are broken, the coarsest first; then between any two characters.
BREAKS = ("\n\n", "\n", " ")


def broken(text: Column, width: int, overlap: int, breaks: tuple[str, ...] = BREAKS) -> Column:
    """A text as (kind, part) in order: a `piece` to be packed with its neighbours, a `chunk` as it is, or an `end` of what is packed together.

    The first separator found in the text cuts it, and stays at the head of what
    follows. A piece that is too long is cut by the finer separators, and is
    packed apart from what stands around it. A text without any is cut in windows.
    """

    def item(kind: str, part: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.alias("part"))

    def by(sign: str, finer: tuple[str, ...]) -> Column:
        end = F.array(item("end", F.lit("")))

        def headed(piece: Column, i: Column) -> Column:
            return F.when(i > 0, F.concat(F.lit(sign), piece)).otherwise(piece)

        def apart(piece: Column) -> Column:
            return F.when(F.length(piece) >= width, F.concat(end, broken(piece, width, overlap, finer), end)).otherwise(F.array(item("piece", piece)))

        return F.flatten(F.transform(F.filter(F.transform(F.split(text, sign, -1), headed), lambda piece: piece != ""), apart))

    step = width - min(overlap, width - 1)
    last = F.greatest(F.ceil((F.length(text) - width) / step), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: item("chunk", F.substring(text, i * step + 1, F.lit(width))))
    for at in reversed(range(len(breaks))):
        cut = F.when(F.contains(text, F.lit(breaks[at])), by(breaks[at], breaks[at + 1 :])).otherwise(cut)
    return cut


def packed(items: Column, width: int, overlap: int) -> Column:
    """Chunks of broken() items: pieces are packed greedily; a new pack begins with the end of the one before, at most `overlap` characters. Chunks are stripped, empty ones dropped."""
    none = F.array().cast("array<string>")

    def with_chunk(chunks: Column, chunk: Column) -> Column:
        return bound(strip(chunk), lambda c: F.when(c != "", F.array_append(chunks, c)).otherwise(chunks))

    def tail(pack: Column, most: Column) -> Column:
        # how many of the last pieces fit, and their characters
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))

        def take(s: Column, piece: Column) -> Column:
            fits = s["open"] & (s["size"] + F.length(piece) <= most)
            return F.struct((s["n"] + fits.cast("int")).alias("n"), F.when(fits, s["size"] + F.length(piece)).otherwise(s["size"]).alias("size"), fits.alias("open"))

        return F.aggregate(F.reverse(pack), start, take)

    def state(pack: Column, size: Column, chunks: Column) -> Column:
        return F.struct(pack.alias("pack"), size.alias("size"), chunks.alias("chunks"))

    def step(s: Column, x: Column) -> Column:
        piece = x["part"]
        closed = with_chunk(s["chunks"], F.array_join(s["pack"], ""))
        added = state(F.array_append(s["pack"], piece), s["size"] + F.length(piece), s["chunks"])
        again = bound(
            tail(s["pack"], F.least(F.lit(overlap), width - F.length(piece))),
            lambda t: state(F.array_append(F.slice(s["pack"], F.size(s["pack"]) - t["n"] + 1, t["n"]), piece), t["size"] + F.length(piece), closed),
        )
        full = (F.size(s["pack"]) > 0) & (s["size"] + F.length(piece) > width)
        return F.when(x["kind"] == "end", state(none, F.lit(0), closed)).when(x["kind"] == "chunk", state(none, F.lit(0), with_chunk(s["chunks"], piece))).when(full, again).otherwise(added)

    end = F.array(F.struct(F.lit("end").alias("kind"), F.lit("").alias("part")))
    return F.aggregate(F.concat(items, end), state(none, F.lit(0), none), step, lambda s: s["chunks"])


def recursive_chunks(text: Column, width: int = 1500, overlap: int = 100) -> Column:
    """A text's chunks of at most `width` characters, broken at the coarsest separator that does; null for null."""
    return F.when(text.isNotNull(), packed(broken(text, width, overlap), width, overlap))
