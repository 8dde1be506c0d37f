"""Variant notation: columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residue abbreviations in the order in which they are replaced.
RESIDUES = (
    ("Ala", "A"), ("Arg", "R"), ("Asn", "N"), ("Asp", "D"), ("Cys", "C"), ("Gln", "Q"), ("Glu", "E"),
    ("Gly", "G"), ("His", "H"), ("Ile", "I"), ("Leu", "L"), ("Lys", "K"), ("Met", "M"), ("Phe", "F"),
    ("Pro", "P"), ("Ser", "S"), ("Ter", "X"), ("Thr", "T"), ("Trp", "W"), ("Tyr", "Y"), ("Val", "V"),
)
#: The shortest protein change that names a residue, a position and a change.
LEAST_PROTEIN = 5


def strip_reference(hgvs: Column) -> Column:
    """The part of an HGVS name after its last colon."""
    return F.element_at(F.split(hgvs, ":"), -1)


def dna_core(change: Column) -> Column:
    """A coding change without `c.` and parentheses."""
    return F.regexp_replace(change, r"c\.|[()]", "")


def protein_body(description: Column) -> Column:
    """What stands in the parentheses of `p.(...)`; null where the description has another form."""
    return F.nullif(F.regexp_extract(strip_reference(description), r"^p.\((.*)\)", 1), F.lit(""))


def protein_status(description: Column) -> Column:
    """ok, or why a description gives no protein forms: missing, no protein change, too short."""
    body = protein_body(description)
    return F.when(description.isNull(), "missing").when(body.isNull(), "no protein change").when(F.length(body) < LEAST_PROTEIN, "too short").otherwise("ok")


def trim_frameshift(body: Column) -> Column:
    """Cut from the three letters in front of `fs` on."""
    return F.regexp_replace(body, "[A-Za-z]{3}fs.*", "")


def to_short_form(body: Column) -> Column:
    """Three-letter residues by one-letter ones, one replacement after the other in the fixed order."""
    return reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), RESIDUES, body)


def drop_stop_symbols(body: Column) -> Column:
    """Without the two signs for a stop, which papers use in turn."""
    return F.translate(body, "X*", "")


def long_form(description: Column) -> Column:
    """The three-letter protein change to look for; null unless protein_status is ok."""
    return F.when(protein_status(description) == "ok", drop_stop_symbols(trim_frameshift(protein_body(description))))


def short_form(description: Column) -> Column:
    """The one-letter protein change to look for; null unless protein_status is ok."""
    return F.when(protein_status(description) == "ok", drop_stop_symbols(to_short_form(trim_frameshift(protein_body(description)))))


def dna_pattern(core: Column) -> Column:
    """A regular expression for the change that allows white space around numbers and `>`."""
    escaped = F.regexp_replace(core, r"([^A-Za-z0-9_>])", r"\\$1")
    numbers = F.regexp_replace(escaped, r"([0-9]+)", r"\\s*$1\\s*")
    return F.regexp_replace(numbers, ">", r"\\s*>\\s*")


def strict_dna_pattern(core: Column) -> Column:
    """dna_pattern that does not match inside a longer number on its left."""
    return F.concat(F.lit("(?<![0-9])"), dna_pattern(core))


def digit_runs(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("([0-9]+)"), 1)


def first_digit_run(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, "([0-9]+)", 1), F.lit(""))


def longest_digit_run(s: Column) -> Column:
    """The longest run of digits, the first of equals; null if there is none."""
    return F.aggregate(digit_runs(s), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))


def silent_guard(description: Column) -> Column:
    """A silent change is no protein change."""
    return F.when(strip_reference(description) != "p.(=)", description)


def table_aliases(change: Column, protein: Column) -> Column:
    """The numbers to look for in tables: the longest of the DNA change, and the first of the protein change."""
    return F.array_compact(F.array(longest_digit_run(change), first_digit_run(protein)))


def text_aliases(change: Column, protein: Column) -> Column:
    """The names to ask about in prose: the coding change, and the protein change if there is one."""
    return F.array_compact(F.array(change, F.nullif(protein, F.lit(""))))


def position_pattern(s: Column) -> Column:
    """The first number of a change with any other sign on both sides; null without a number."""
    return F.concat(F.lit(r"\D"), first_digit_run(s), F.lit(r"\D"))


def classify_notation(s: Column) -> Column:
    """Which notation a free input is in: one of five standard forms, a dbSNP id, or text."""
    t = F.trim(s)
    return (
        F.when(t.rlike(r"^rs[0-9]+$"), "rsid")
        .when(t.rlike(r"^NC_[0-9]+(\.[0-9]+)?:g\.\S+$"), "genomic")
        .when(t.rlike(r"^N[MR]_[0-9]+(\.[0-9]+)?(\([^)]+\))?:c\.\S+$"), "transcript_c")
        .when(t.rlike(r"^N[MP]_[0-9]+(\.[0-9]+)?(\([^)]+\))?:p\.\S+$"), "transcript_p")
        .when(t.rlike(r"^[A-Z][A-Z0-9-]*[: ]c\.\S+$"), "gene_c")
        .when(t.rlike(r"^[A-Z][A-Z0-9-]*[: ]p\.\S+$"), "gene_p")
        .otherwise("text")
    )


def assemble_hgvs(reference: Column, change: Column, build: Column) -> tuple[Column, Column]:
    """An HGVS name from its fields, and the genome build, GRCh37 unless said."""
    return F.concat_ws(":", F.nullif(F.trim(reference), F.lit("")), F.trim(change)), F.coalesce(F.nullif(F.trim(build), F.lit("")), F.lit("GRCh37"))
