"""Questions, answers and the report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from ..functions import hgvs
from ..functions import text as tx

PAIR = ["paper_id", "variant_id"]
#: The aliases of a variant: its DNA change, its protein change.
DNA, PROTEIN = 0, 1
#: The questions: is it mentioned, and which variants are in trans.
MENTION, IN_TRANS = 0, 1
#: The grammar of a coding change in running text.
CHANGE = r"(c\.\s*\*?[0-9]+(?:[+-][0-9]+)?(?:_\*?[0-9]+(?:[+-][0-9]+)?)?\s*(?:[ACGT]\s*>\s*[ACGT]|delins[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+))"
SECTIONS = ("Variant and genotype in tables", "Variant in the text", "Variants in trans in the text", "Diagnostics")


def ask(pairs: DataFrame, contexts: DataFrame, variants: DataFrame) -> DataFrame:
    """(paper_id, variant_id, alias_idx, qtype, alias, c_variant, context): up to four questions on each pair that has a context."""
    names = F.array(F.col("c_variant"), F.nullif(F.col("plong"), F.lit("")))
    known = pairs.join(contexts, PAIR).join(variants.select("variant_id", "c_variant", "plong"), "variant_id")
    named = known.select(*PAIR, "context", "c_variant", F.posexplode(names).alias("alias_idx", "alias")).where("alias IS NOT NULL")
    return named.select(*PAIR, "alias_idx", F.explode(F.array(F.lit(MENTION), F.lit(IN_TRANS))).alias("qtype"), "alias", "c_variant", "context")


def render_prompts(questions: DataFrame) -> DataFrame:
    """questions with a prompt: the wording for each type, the alias and the context."""
    mention = F.concat(F.lit("Does the text mention the variant "), F.col("alias"), F.lit("? Begin with yes or no and quote the sentence.\n\nText:\n"), F.col("context"))
    trans = F.concat(F.lit("Which variants occur in trans with "), F.col("alias"), F.lit(", one on each line? Say none if there are none.\n\nText:\n"), F.col("context"))
    return questions.withColumn("prompt", F.when(F.col("qtype") == MENTION, mention).otherwise(trans))


def mention_answer(context: Column, alias: Column) -> Column:
    """yes and the words around the alias, or none."""
    at = F.position(alias, context)
    around = F.substring(context, F.greatest(at - 80, F.lit(1)), F.length(alias) + F.least(at - 1, F.lit(80)) + 80)
    return F.when(at > 0, F.concat(F.lit("yes: "), F.regexp_replace(around, r"\s+", " "))).otherwise("none")


def partners(context: Column, alias: Column) -> Column:
    """The other coding changes in a context, without white space, in the order of first mention."""
    found = F.transform(F.regexp_extract_all(context, F.lit(CHANGE), 1), lambda v: F.regexp_replace(v, r"\s+", ""))
    return F.array_except(F.array_distinct(found), F.array(F.regexp_replace(alias, r"\s+", "")))


def zygosity_cue(context: Column) -> Column:
    low = F.lower(context)
    return F.when(low.rlike("compound het|in trans"), "compound heterozygous").when(F.contains(low, F.lit("homozyg")), "homozygous").otherwise("none")


def built_in_answers(questions: DataFrame) -> DataFrame:
    """questions answered by rule: a mention with its surroundings, or the co-mentioned changes one to a line."""
    lines = F.array_join(partners(F.col("context"), F.col("c_variant")), "\n")
    answer = F.when(F.col("qtype") == MENTION, mention_answer(F.col("context"), F.col("alias"))).otherwise(F.coalesce(F.nullif(lines, F.lit("")), F.lit("none")))
    return questions.select(*PAIR, "alias_idx", "qtype", answer.alias("answer"), F.lit(None).cast("string").alias("error"))


def answered_by(questions: DataFrame, answerer: Callable[[str], str]) -> DataFrame:
    """questions (with prompt) answered by a user's function; a failure is the row's error and never the job's."""

    def ask_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers, errors = [], []
            for prompt in rows["prompt"]:
                try:
                    answers.append(answerer(prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a plug-in raises
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield rows[[*PAIR, "alias_idx", "qtype"]].assign(answer=answers, error=errors)

    kind = dict(questions.dtypes)
    keys = ", ".join(f"{c} {kind[c]}" for c in (*PAIR, "alias_idx", "qtype"))
    return questions.select(*PAIR, "alias_idx", "qtype", "prompt").mapInPandas(ask_all, f"{keys}, answer string, error string")


def join_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions with the answers of an outside table; one without an answer keeps a null."""
    return questions.join(answers, [*PAIR, "alias_idx", "qtype"], "left")


def judge(answers: DataFrame) -> DataFrame:
    """answers with reason: why one is left out (error, timeout, missing, empty), null for those that count."""
    reason = (
        F.when(F.lower("error").contains("timeout") | F.lower("error").contains("timed out"), "timeout")
        .when(F.col("error").isNotNull(), "error").when(F.col("answer").isNull(), "missing").when(F.col("answer") == "", "empty")
    )
    return answers.withColumn("reason", reason)


def says_yes(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("yes"))


def variant_hit(answers: DataFrame) -> DataFrame:
    """(paper_id, variant_id, variant_hit): whether any mention answer says yes."""
    mention = F.col("qtype") == MENTION
    return answers.groupBy(*PAIR).agg(F.coalesce(F.bool_or(says_yes(F.col("answer")) & mention), F.lit(False)).alias("variant_hit"))


def compose_mention(answers: DataFrame) -> DataFrame:
    """(paper_id, variant_id, mention): the answers that say yes, DNA before protein; not found only if none does."""
    said = F.when(says_yes(F.col("answer")), F.struct("alias_idx", "answer"))
    label = lambda x: F.concat(F.when(x["alias_idx"] == DNA, "DNA match: ").otherwise("Protein match: "), x["answer"])
    rows = F.transform(F.array_sort(F.collect_list(said)), label)
    return answers.where(F.col("qtype") == MENTION).groupBy(*PAIR).agg(rows.alias("rows")).select(*PAIR, F.when(F.size("rows") > 0, F.array_join("rows", "\n")).otherwise("Variant not found in the text").alias("mention"))


def in_trans_lines(answers: DataFrame) -> DataFrame:
    """(paper_id, variant_id, pos, line): the lines of the in-trans answers that say something, in the order of asking."""
    rows = answers.where((F.col("qtype") == IN_TRANS) & tx.says_something(F.col("answer")))
    lines = rows.select(*PAIR, "alias_idx", F.posexplode(tx.answer_lines(F.col("answer"))).alias("i", "line"))
    return lines.select(*PAIR, (F.col("alias_idx").cast("long") * 1_000_000_000 + F.col("i")).alias("pos"), "line")


def first_of_each(rows: DataFrame, group: list[str], pos: str, value: str) -> DataFrame:
    """rows whose answer_key comes first in their group; the text stays as it was.

    The first of each key is a partial minimum, so a key that fills a group is
    folded before the shuffle.
    """
    keyed = rows.withColumn("__key", tx.answer_key(F.col(value)))
    best = keyed.groupBy(*group, "__key").agg(F.min(F.struct(pos, value)).alias("__first"))
    return best.select(*group, f"__first.{pos}", f"__first.{value}")


def bullet_list(rows: DataFrame, group: list[str], pos: str, value: str) -> DataFrame:
    """(group, bullets): the rows as a list, one line each, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: F.concat(F.lit("- "), x[value]))
    return rows.groupBy(*group).agg(F.array_join(lines, "\n").alias("bullets"))


def comma_union(answers: DataFrame, group: list[str], value: str) -> DataFrame:
    """The distinct pieces between commas of the answers that say something; pieces are not trimmed."""
    return answers.where(tx.says_something(F.col(value))).select(*group, F.explode(F.split(value, ",")).alias("piece")).distinct()


def merge_evidence(*parts: tuple[int, DataFrame]) -> DataFrame:
    """(paper_id, variant_id, section_idx, pos, line): evidence of several kinds as one ordered set."""
    merged = None
    for index, rows in parts:
        own = rows.select(*PAIR, F.lit(index).alias("section_idx"), F.col("pos").cast("long").alias("pos"), "line")
        merged = own if merged is None else merged.unionByName(own)
    return merged


def build_diagnostics(counters: DataFrame, summary: DataFrame, variants: DataFrame) -> DataFrame:
    """(paper_id, variant_id, diagnostics): one nested record for each pair."""
    return diagnostics_of(counters.join(summary.drop("short_form"), PAIR), variants)


def diagnostics_of(summed: DataFrame, variants: DataFrame) -> DataFrame:
    """The same from counters and summary in one, as match_summary() gives them."""
    rows = summed.join(variants, "variant_id")
    body = F.struct(
        F.col("hgvs").alias("input_hgvs"), F.col("var_dna"),
        F.struct(F.col("protein_status").alias("status"), F.col("description").alias("raw_description"), hgvs.protein_body(F.col("description")).alias("stripped"), F.col("plong").alias("long_form"), F.col("pshort").alias("short_form"), F.array_join(F.coalesce(hgvs.digit_runs(F.col("plong")), F.array().cast("array<string>")), ",").alias("digits")).alias("normalization"),
        F.struct(F.col("dna_pattern").alias("pattern"), F.col("dna_matched").alias("matched"), F.col("dna_chunks").alias("chunks")).alias("dna_search"),
        F.struct(F.col("long_matched"), F.col("long_chunks"), F.col("short_matched"), F.col("short_chunks")).alias("protein_search"),
        F.struct(F.col("fallback_triggered").alias("triggered"), hgvs.position_pattern(F.col("var_dna")).alias("dna_pattern"), hgvs.position_pattern(F.col("plong")).alias("protein_pattern"), F.col("fallback_matched").alias("matched"), F.col("fallback_chunks").alias("chunks")).alias("position_fallback"),
        F.struct(F.col("ok"), F.col("total_chunks"), F.col("pshort").alias("short_form")).alias("summary"),
    )
    return rows.select(*PAIR, body.alias("diagnostics"))


def rendered(record: Column, kind: StructType) -> list[Column]:
    """A record's lines: a field each, under its name; a record within it has its name as a heading. Flags are yes or no, what is missing is n/a."""
    lines = []
    for field in kind:
        value, label = record[field.name], field.name.replace("_", " ")
        if isinstance(field.dataType, StructType):
            lines += [F.lit(f"\n## {label}"), *rendered(value, field.dataType)]
        else:
            said = F.when(value, "yes").when(~value, "no") if isinstance(field.dataType, BooleanType) else value.cast("string")
            lines.append(F.concat(F.lit(f"{label}: "), tx.present_or(said, "n/a")))
    return lines


def build_report(pairs: DataFrame, tables: DataFrame, mentions: DataFrame, trans: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(paper_id, variant_id, report): a title and four sections in fixed order, one report for each pair.

    tables and trans hold bullets, mentions hold mention; a part that is missing
    says that nothing was found.
    """
    rows = pairs.select(*PAIR)
    for part, column, name in ((tables, "bullets", "__tables"), (mentions, "mention", "__mention"), (trans, "bullets", "__trans"), (diagnostics, "diagnostics", "__diagnostics")):
        rows = rows.join(part.select(*PAIR, F.col(column).alias(name)), PAIR, "left")
    bodies = (tx.present_or(F.col("__tables"), "No table evidence"), tx.present_or(F.col("__mention"), "Variant not found in the text"), tx.present_or(F.col("__trans"), "None"), F.concat_ws("\n", *rendered(F.col("__diagnostics"), diagnostics.schema["diagnostics"].dataType)))
    sections = F.array(*(F.struct(F.lit(t).alias("title"), b.alias("body")) for t, b in zip(SECTIONS, bodies, strict=True)))
    return rows.select(*PAIR, F.struct(F.lit("Evidence summary").alias("title"), sections.alias("sections")).alias("report"))


def ranked_transcript(candidates: DataFrame, preferences: DataFrame) -> DataFrame:
    """(variant_id, transcript): the user's choice if there is one, else the best ranked of the preferences, then the first by name.

    candidates: variant_id, transcript, chosen (boolean). preferences: transcript, pref_rank.
    """
    ranked = candidates.join(preferences, "transcript", "left")
    order = Window.partitionBy("variant_id").orderBy(F.coalesce("chosen", F.lit(False)).desc(), F.col("pref_rank").asc_nulls_last(), "transcript")
    return ranked.withColumn("n", F.row_number().over(order)).where("n = 1").select("variant_id", "transcript")


def family_warnings(members: DataFrame) -> DataFrame:
    """members (affected, carrier: yes, no or null) with their warnings, and reporting gaps named as such."""
    said = lambda c: F.coalesce(c, F.lit("not_reported_in_source"))
    warnings = F.array_compact(F.array(
        F.when((F.col("affected") == "yes") & (F.col("carrier") == "no"), "affected non-carrier"),
        F.when((F.col("affected") == "no") & (F.col("carrier") == "yes"), "unaffected carrier"),
    ))
    return members.withColumn("warnings", F.array_join(warnings, "; ")).withColumn("affected", said(F.col("affected"))).withColumn("carrier", said(F.col("carrier")))
