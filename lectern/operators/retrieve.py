"""Prose: from passages to the chunks that mention a variant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hgvs, text
from ..shared import kept

#: Of longer numbers the last or first so many digits are join tokens.
LONGEST_TOKEN = 12
#: Letters that count as others where case does not count.
ODD_CASE = ("\u017f\u0131\u0130\u212a", "siik")
PAIR = ["paper_id", "variant_id"]
KEY = ["way", "form", "pattern"]
#: Of a form's chunks, and of its variants, about so many meet in one place.
TILE = 2048


def prose(passages: DataFrame) -> DataFrame:
    """Passages of sections that hold prose, of a collection's first document; an unnamed section does."""
    first = F.col("doc_seq") == 0 if "doc_seq" in passages.columns else F.lit(True)
    return passages.where(text.is_prose(F.col("section_type")) & first)


def flatten_papers(passages: DataFrame) -> DataFrame:
    """(paper_id, body): the passages' texts in order, one to a line."""
    return passages.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "\n").alias("body"))


def chunk(papers: DataFrame, width: int = 1500, overlap: int = 100, how: str = "fixed") -> DataFrame:
    """(paper_id, chunk_seq, text): `fixed` windows, or `recursive` breaks at paragraphs, lines and words."""
    cutter = text.fixed_chunks if how == "fixed" else text.recursive_chunks
    return papers.select("paper_id", F.posexplode(cutter(F.col("body"), width, overlap)).alias("chunk_seq", "text"))


def prepare_variants(variants: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """variants (variant_id, hgvs) with their change, core, patterns and protein forms.

    proteins (hgvs, description) is the table of an outside name service; a
    variant without a row there, or with a description that names no change, has
    no protein forms and says why in protein_status.
    """
    if proteins is None:
        described = variants.withColumn("description", F.lit(None).cast("string"))
    else:
        described = variants.join(proteins.select("hgvs", "description"), "hgvs", "left")
    change = hgvs.strip_reference(F.col("hgvs"))
    return (
        described.withColumn("c_variant", change)
        .withColumn("var_dna", hgvs.dna_core(change))
        .withColumn("dna_pattern", hgvs.dna_pattern(F.col("var_dna")))
        .withColumn("protein_status", hgvs.protein_status(F.col("description")))
        .withColumn("plong", hgvs.long_form(F.col("description")))
        .withColumn("pshort", hgvs.short_form(F.col("description")))
    )


def by_dna(body: Column, pattern: Column) -> Column:
    """Whether a text holds the pattern; case does not count, and all Unicode spaces are spaces."""
    return F.coalesce(F.regexp_like(body, F.concat(F.lit("(?iU)"), pattern)), F.lit(False))


def by_form(body: Column, form: Column) -> Column:
    """Whether a text holds a protein form, which must not be empty."""
    return F.coalesce(F.contains(body, form) & (form != ""), F.lit(False))


def squeezed(s: Column) -> Column:
    """A text without white space, in the case in which DNA changes are compared."""
    return F.regexp_replace(F.lower(F.translate(s, *ODD_CASE)), r"(?U)\s+", "")


def forms_of(variants: DataFrame) -> DataFrame:
    """(variant_id, way, form, pattern): what a chunk may hold of a variant: its DNA change, or its long or short protein form."""
    none = F.lit(None).cast("string")
    all_forms = F.array(*(F.struct(F.lit(way).alias("way"), F.col(form).alias("form"), pattern.alias("pattern")) for way, form, pattern in (("dna", "var_dna", F.col("dna_pattern")), ("long", "plong", none), ("short", "pshort", none))))
    return variants.select("variant_id", F.explode(all_forms).alias("f")).select("variant_id", "f.*").where("form <> ''")


#: A digit run behind a sign and white space, if they are there; and the white space and the sign that follow.
RUN = r"(?U)([^0-9\s]?\s*[0-9]++)(?=(\s*+[^0-9\s]?))"


def numbers_in(s: Column) -> Column:
    """The digit runs of a text as (run, before, after, dna_before, dna_after): with the signs next to them, and with those beyond white space in the case of DNA changes; empty at the ends."""
    pairs = F.zip_with(F.regexp_extract_all(s, F.lit(RUN), 1), F.regexp_extract_all(s, F.lit(RUN), 2), lambda b, a: F.struct(b.alias("b"), F.regexp_extract(b, "([0-9]+)$", 1).alias("run"), a.alias("after")))

    def signs(x: Column) -> Column:
        before = F.left(x["b"], F.length(x["b"]) - F.length(x["run"]))
        return F.struct(x["run"].alias("run"), F.right(before, F.lit(1)).alias("before"), F.left(x["after"], F.lit(1)).alias("after"), squeezed(before).alias("dna_before"), squeezed(x["after"]).alias("dna_after"))

    return F.transform(pairs, signs)


def token(kind: str, tok: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), tok.alias("tok"))


def form_tokens(forms: DataFrame) -> DataFrame:
    """(way, form, pattern, kind, tok, n): the n things of which a chunk must hold each for a form to match.

    A number between two signs must stand in the text as a whole between the same
    signs (whole). A form's first number, with no sign before it, must be the
    end of a number before the same sign (end); its last, with no sign after it,
    the beginning of one behind the same sign (begin). DNA changes are looked for in
    the squeezed text, protein forms in the text as it is. A form without such
    a number has its first one or two signs that stand together (gram).
    """
    dna = F.col("way") == "dna"

    def of(n: Column) -> Column:
        before, run, after = F.when(dna, n["dna_before"]).otherwise(n["before"]), n["run"], F.when(dna, n["dna_after"]).otherwise(n["after"])
        whole = F.struct(F.lit("whole").alias("kind"), F.concat(before, run, after).alias("tok"))
        end = F.struct(F.lit("end").alias("kind"), F.concat(F.right(run, F.lit(LONGEST_TOKEN)), after).alias("tok"))
        begin = F.struct(F.lit("begin").alias("kind"), F.concat(before, F.left(run, F.lit(LONGEST_TOKEN))).alias("tok"))
        return F.when((before != "") & (after != ""), whole).when(after != "", end).when(before != "", begin)

    own = F.array_distinct(F.array_compact(F.transform(numbers_in(F.col("form")), of)))
    together = F.lower(F.regexp_extract("form", r"([A-Za-z]+|[0-9]+|[^A-Za-z0-9])", 1))
    gram = F.array(F.struct(F.lit("gram").alias("kind"), F.left(together, F.lit(2)).alias("tok"), F.lit(1).alias("n")))
    named = text.bound(own, lambda all_own: F.transform(all_own, lambda t: F.struct(F.concat(F.when(dna, "dna ").otherwise("as is "), t["kind"]).alias("kind"), t["tok"].alias("tok"), F.size(all_own).alias("n"))))
    tokens = text.bound(named, lambda found: F.when(F.size(found) > 0, found).otherwise(gram))
    return forms.select("way", "form", "pattern", F.explode(tokens).alias("t")).select("way", "form", "pattern", "t.*")


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_seq, kind, tok) of chunks (paper_id, chunk_seq, text, body): all that form_tokens() may ask for, but for grams."""

    def parts(space: str, n: Column) -> Column:
        before, run, after = (n["dna_before"], n["run"], n["dna_after"]) if space == "dna" else (n["before"], n["run"], n["after"])
        lengths = F.sequence(F.lit(1), F.least(F.length(run), F.lit(LONGEST_TOKEN)))
        whole = F.when((before != "") & (after != ""), F.array(token(f"{space} whole", F.concat(before, run, after))))
        ends = F.when(after != "", F.transform(lengths, lambda k: token(f"{space} end", F.concat(F.right(run, k), after))))
        begins = F.when(before != "", F.transform(lengths, lambda k: token(f"{space} begin", F.concat(before, F.left(run, k)))))
        return F.flatten(F.array_compact(F.array(whole, ends, begins)))

    def all_parts(numbers: Column, *spaces: str) -> Column:
        return text.bound(F.array_distinct(numbers), lambda d: F.concat(*(F.flatten(F.transform(d, partial(parts, space))) for space in spaces)))

    same = all_parts(numbers_in(F.col("text")), "dna", "as is")
    apart = F.concat(all_parts(numbers_in(F.col("body")), "dna"), all_parts(numbers_in(F.col("text")), "as is"))
    found = F.when(F.col("text") == F.col("body"), same).otherwise(apart)
    return chunks.where(F.col("body").rlike("[0-9]") | F.col("text").rlike("[0-9]")).select("paper_id", "chunk_seq", F.explode(F.array_distinct(found)).alias("t")).select("paper_id", "chunk_seq", "t.*")


def chunk_grams(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(paper_id, chunk_seq, kind, tok): which of the wanted grams a chunk holds. There are at most as many as pairs of signs, and none where each form has a number."""
    grams = wanted.where("kind = 'gram'").agg(F.collect_set("tok").alias("grams")).scalar()
    rows = chunks.select("paper_id", "chunk_seq", F.lower("body").alias("low"), grams.alias("grams")).where("size(grams) > 0")
    return rows.select("paper_id", "chunk_seq", F.lit("gram").alias("kind"), F.explode(F.filter("grams", lambda t: F.contains(F.col("low"), t))).alias("tok"))


def unescaped(chunks: DataFrame) -> DataFrame:
    """chunks with `body`, the text with its escapes resolved, in which DNA changes are looked for."""
    return chunks.select("paper_id", "chunk_seq", "text", text.unescape_text(F.col("text")).alias("body"))


def candidates(chunks: DataFrame, forms: DataFrame) -> DataFrame:
    """(paper_id, chunk_seq, way, form, pattern): chunks (as unescaped() gives them) and distinct forms that share the form's rarest token.

    Forms with one token are joined by it. For the others the chunks that hold each
    of their tokens are counted: the rarest is the join key, and a form of which a
    token is nowhere matches nothing and goes. Forms' tokens, and those of them that
    chunks hold, are written once for all these steps.
    """
    wanted = kept(form_tokens(forms.select(*KEY).distinct()))
    single, several = (wanted.where(which).drop("n") for which in ("n = 1", "n > 1"))
    asked = chunk_tokens(chunks).join(wanted.select("kind", "tok").distinct(), ["kind", "tok"], "left_semi")
    tokens = kept(asked.select("paper_id", "chunk_seq", "kind", "tok").union(chunk_grams(chunks, single)))
    common = tokens.groupBy("kind", "tok").agg(F.count("*").alias("n"))
    counted = several.join(common, ["kind", "tok"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy(*KEY).agg(F.min(F.struct("n", "kind", "tok")).alias("r")).where("r.n > 0")
    keys = single.union(rarest.select(*KEY, "r.kind", "r.tok"))
    return tokens.join(keys, ["kind", "tok"]).select("paper_id", "chunk_seq", *KEY)


def tiles(held: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (paper_id, chunk_seq, held) and variants (variant_id, own), each once for every tile (KEY, slice, block) that they meet in.

    held (paper_id, chunk_seq, KEY) says which forms the chunks hold, forms (variant_id, KEY) which the variants have.
    The chunks that hold a form are dealt into slices and the variants that have it into blocks, of about TILE rows each.
    Of a variant's own forms only those count that are held anywhere; own is null where that is one.
    """
    found = held.groupBy(*KEY).agg(F.ceil(F.count("*") / TILE).cast("int").alias("slices"))
    sizes = forms.groupBy(*KEY).agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")).join(found, KEY)
    key = F.struct(*KEY)
    in_chunk = held.groupBy("paper_id", "chunk_seq").agg(F.collect_set(key).alias("held"))
    hits = in_chunk.select("*", F.explode("held").alias("k")).select("paper_id", "chunk_seq", "held", "k.*").join(sizes.hint("merge"), KEY)
    met = forms.join(sizes, KEY).groupBy("variant_id").agg(F.collect_set(F.struct(*KEY, "slices", "blocks")).alias("met"))
    own = F.when(F.size("met") > 1, F.transform("met", lambda m: F.struct(*(m[k].alias(k) for k in KEY))))
    variants = met.select("variant_id", own.alias("own"), F.explode("met").alias("m")).select("variant_id", "own", "m.*")

    def part(n: str, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    return (
        hits.select("paper_id", "chunk_seq", "held", *KEY, part("slices", "paper_id", "chunk_seq").alias("slice"), every("blocks").alias("block")),
        variants.select("variant_id", "own", *KEY, every("slices").alias("slice"), part("blocks", "variant_id").alias("block")),
    )


def variants_held(held: DataFrame, forms: DataFrame) -> DataFrame:
    """(paper_id, chunk_seq, variant_id, by_dna, by_long, by_short) of held and forms, as tiles() takes them.

    A chunk that holds a form shared by many variants gives as many rows. They come out of
    the last join and are not shuffled: a variant of which a chunk holds several forms
    is given where it meets the first of them. The number of partitions and the kind of
    join are stated, as the sizes of what is joined don't tell how much comes of it.
    """
    tile = [*KEY, "slice", "block"]
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits, variants = tiles(held, forms)
    hits = hits.withColumns({flag: F.col("way") == flag[3:] for flag in FLAGS}).repartition(n, *tile)
    rows = hits.join(variants.repartition(n, *tile).hint("merge"), tile)
    alone, both = F.col("own").isNull(), F.array_intersect("own", "held")
    flags = (F.when(alone, F.col(flag)).otherwise(F.array_contains(both["way"], flag[3:])).alias(flag) for flag in FLAGS)
    return rows.where(alone | (F.get(both, F.lit(0)) == F.struct(*KEY))).select("paper_id", "chunk_seq", "variant_id", *flags)


def form_flags(rows: DataFrame) -> DataFrame:
    """rows with by_dna, by_long and by_short: which forms of its variant the text holds."""
    body = rows.withColumn("body", text.unescape_text(F.col("text")))
    return body.withColumns({"by_dna": by_dna(F.col("body"), F.col("dna_pattern")), "by_long": by_form(F.col("text"), F.col("plong")), "by_short": by_form(F.col("text"), F.col("pshort"))}).drop("body")


FLAGS = ["by_dna", "by_long", "by_short"]


def match(chunks: DataFrame, variants: DataFrame, how: str = "token") -> DataFrame:
    """(paper_id, chunk_seq, variant_id, by_dna, by_long, by_short): the chunks that mention a variant.

    how="token" joins chunks and distinct forms on tokens, verifies each form once in
    a chunk, by its signs and then by its pattern, and gives the result to all
    variants that have the form. What the chunks hold is written when this is called. chunks
    are read up to three times: where they are costly, pass them as a written table. "nested"
    tries every pair and serves few variants and tests.
    """
    if how == "nested":
        pairs = chunks.join(variants.select("variant_id", "dna_pattern", "plong", "pshort"))
        return form_flags(pairs).where("by_dna OR by_long OR by_short").select("paper_id", "chunk_seq", "variant_id", *FLAGS)
    forms, bodies = kept(forms_of(variants).where("way <> 'dna' OR pattern IS NOT NULL").fillna("", "pattern")), unescaped(chunks)
    rows = candidates(bodies, forms).join(bodies, ["paper_id", "chunk_seq"])
    literal = F.when(F.col("way") == "dna", F.contains(squeezed(F.col("body")), squeezed(F.col("form")))).otherwise(F.contains("text", F.col("form")))
    held = rows.where(literal).where(F.when(F.col("way") == "dna", by_dna(F.col("body"), F.col("pattern"))).otherwise(True))
    return variants_held(kept(held.select("paper_id", "chunk_seq", *KEY)), forms)


@dataclass(frozen=True)
class Matcher:
    """A matcher of the user's own.

    accepts takes a chunk's text and a variant's row, as columns, and gives a
    condition. text_tokens and variant_tokens give arrays of strings: a chunk and a
    variant are only compared where they share one, so that each accepted pair must.
    """

    accepts: Callable[[Column, Column], Column]
    text_tokens: Callable[[Column], Column]
    variant_tokens: Callable[[Column], Column]


def match_with(chunks: DataFrame, variants: DataFrame, matcher: Matcher | Callable[[Column, Column], Column], pairs: DataFrame | None = None) -> DataFrame:
    """(paper_id, chunk_seq, variant_id): the chunks that a user's matcher accepts.

    It is asked about the pairs that share one of its own tokens, or, also as a
    bare condition, about the pairs (paper_id, chunk_seq, variant_id) given.
    """
    rows = variants.select("variant_id", F.struct("*").alias("variant"))
    if pairs is not None:
        pairs, accepts = pairs.select("paper_id", "chunk_seq", "variant_id").distinct(), matcher.accepts if isinstance(matcher, Matcher) else matcher
    elif isinstance(matcher, Matcher):
        accepts = matcher.accepts
        held = chunks.select("paper_id", "chunk_seq", F.explode(F.array_distinct(matcher.text_tokens(F.col("text")))).alias("tok"))
        wanted = rows.select("variant_id", F.explode(F.array_distinct(matcher.variant_tokens(F.col("variant")))).alias("tok"))
        pairs = held.join(wanted, "tok").select("paper_id", "chunk_seq", "variant_id").distinct()
    else:
        raise ValueError("a matcher without tokens of its own needs pairs to look at")
    known = pairs.join(chunks, ["paper_id", "chunk_seq"]).join(rows, "variant_id")
    return known.where(F.coalesce(accepts(F.col("text"), F.col("variant")), F.lit(False))).select("paper_id", "chunk_seq", "variant_id")


def positions(variants: DataFrame) -> DataFrame:
    """(variant_id, tok): the first numbers of a variant's DNA and protein change."""
    spots = F.array(hgvs.first_digit_run(F.col("var_dna")), hgvs.first_digit_run(F.col("plong")))
    return variants.select("variant_id", F.explode(F.array_distinct(F.array_compact(spots))).alias("tok"))


def position_hits(chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """(paper_id, chunk_seq, variant_id): chunks that hold a variant's position as a whole number, with another sign on both sides."""
    alone = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(?<=\D)([0-9]+)(?=\D)"), 1))
    runs = chunks.where(F.col("text").rlike("[0-9]")).select("paper_id", "chunk_seq", F.explode(alone).alias("tok"))
    return runs.join(positions(variants), "tok").select("paper_id", "chunk_seq", "variant_id").distinct()


def position_fallback(chunks: DataFrame, variants: DataFrame, hits: DataFrame) -> DataFrame:
    """(paper_id, chunk_seq, variant_id): chunks with the bare position, for pairs of paper and variant without any hit."""
    return position_hits(chunks, variants).join(hits.select(*PAIR).distinct(), PAIR, "left_anti").select("paper_id", "chunk_seq", "variant_id")


def retrieve(chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """match() and, for pairs that it leaves empty, position_fallback(): rows with match_kind `form` or `position`.

    Positions are told by the join on numbers alone, without the text. Whether a
    pair of paper and variant has any form is a window over the pair, whose
    partitioning serves the counts and ranks that follow.
    """
    near = position_hits(chunks, variants).select("paper_id", "chunk_seq", "variant_id", *(F.lit(False).alias(flag) for flag in FLAGS), F.lit(False).alias("form"))
    both = match(chunks, variants).withColumn("form", F.lit(True)).union(near)
    known = both.withColumn("any_form", F.bool_or("form").over(Window.partitionBy(*PAIR))).where("form OR NOT any_form")
    return known.select("paper_id", "chunk_seq", "variant_id", *FLAGS, F.when(F.col("form"), "form").otherwise("position").alias("match_kind"))


def top_chunks(retrieved: DataFrame, k: int = 5) -> DataFrame:
    """The first k chunks of each pair in the order of the paper, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*PAIR).orderBy("chunk_seq"))
    return retrieved.withColumn("rank", rank).where(F.col("rank") <= k)


def match_summary(pairs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """match_counters() with ok and total_chunks of retrieval_summary(): retrieved is counted and joined once for both."""
    form = F.col("match_kind") == "form"
    counted = retrieved.groupBy(*PAIR).agg(
        F.count_if("by_dna").alias("n_dna"), F.count_if("by_long").alias("n_long"), F.count_if("by_short").alias("n_short"),
        F.count_if(form).alias("n_form"), F.count_if(~form).alias("n_position"), F.count("*").alias("n_all"),
    )
    known = pairs.join(counted, PAIR, "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_dna", "n_long", "n_short", "n_form", "n_position", "n_all")}
    return known.select(
        *PAIR, n["n_dna"].alias("dna_chunks"), n["n_long"].alias("long_chunks"), n["n_short"].alias("short_chunks"),
        (n["n_dna"] > 0).alias("dna_matched"), (n["n_long"] > 0).alias("long_matched"), (n["n_short"] > 0).alias("short_matched"),
        (n["n_form"] == 0).alias("fallback_triggered"), (n["n_position"] > 0).alias("fallback_matched"), n["n_position"].alias("fallback_chunks"),
        (n["n_all"] > 0).alias("ok"), n["n_all"].alias("total_chunks"),
    )


def match_counters(pairs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row for each requested pair: how many chunks match by each form, whether the fallback ran, and what came of it."""
    return match_summary(pairs, retrieved).drop("ok", "total_chunks")


def retrieval_summary(pairs: DataFrame, retrieved: DataFrame, variants: DataFrame) -> DataFrame:
    """One row for each requested pair: ok, all chunks found before any limit, and the short protein form."""
    counted = retrieved.groupBy(*PAIR).agg(F.count("*").alias("n"))
    known = pairs.join(counted, PAIR, "left").join(variants.select("variant_id", "pshort"), "variant_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return known.select(*PAIR, (n > 0).alias("ok"), n.alias("total_chunks"), F.col("pshort").alias("short_form"))


def stuff_context(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, variant_id, context): the pair's chunks as one text, in order, a blank line between them."""
    rows = top.select(*PAIR, "chunk_seq").join(chunks, ["paper_id", "chunk_seq"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "text"))), lambda c: c["text"]), "\n\n")
    return rows.groupBy(*PAIR).agg(joined.alias("context"))


def alias_in_sources(top: DataFrame, chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """Per pair, whether a source chunk holds the DNA change literally, and the protein change's number."""
    rows = top.select(*PAIR, "chunk_seq").join(chunks, ["paper_id", "chunk_seq"]).join(variants.select("variant_id", "c_variant", "plong"), "variant_id")
    number = hgvs.first_digit_run(F.col("plong"))
    return rows.groupBy(*PAIR).agg(F.bool_or(F.contains("text", F.col("c_variant"))).alias("dna_in_sources"), F.bool_or(F.coalesce(F.contains("text", number), F.lit(False))).alias("protein_in_sources"))


def relevant(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """The pairs for which anything was retrieved: only they are asked about."""
    return pairs.join(summary.where("ok"), PAIR, "left_semi")


def route_inputs(inputs: DataFrame) -> DataFrame:
    """inputs (path) with accepted, and the reason for those that are not: no path, or a PDF."""
    reason = F.when(F.col("path").isNull() | (F.col("path") == ""), "no path").when(F.lower("path").endswith(".pdf"), "pdf")
    return inputs.withColumn("reason", reason).withColumn("accepted", reason.isNull())
