"""The registered queries, named by the operators they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hgvs
from ..functions import text as tx
from ..operators import answers as an
from ..operators import manifest as mf
from ..operators import retrieve as rt
from ..operators import tables as tb
from ..operators import tasks as tk
from ..shared import kept
from . import files  # noqa: F401 - registers its queries
from . import fixtures as fx
from .registry import ORACLE_SQL, QUERIES, register

__all__ = ["ORACLE_SQL", "QUERIES"]


def c(name: str):
    return F.col(name)


# Variant notation, over names derived from part


@register("SELECT variant_id, c_variant, var_dna FROM free")
def e01_e02_change_and_core(spark, sf):
    return fx.free_variants(spark, sf).select("variant_id", hgvs.strip_reference(c("hgvs")).alias("c_variant"), hgvs.dna_core(hgvs.strip_reference(c("hgvs"))).alias("var_dna"))


@register("SELECT variant_id, body, protein_status, plong, pshort FROM free")
def e03_e06_protein_forms(spark, sf):
    d = c("description")
    return fx.free_variants(spark, sf).select("variant_id", hgvs.protein_body(d).alias("body"), hgvs.protein_status(d).alias("protein_status"), hgvs.long_form(d).alias("plong"), hgvs.short_form(d).alias("pshort"))


@register("SELECT variant_id, dna_pattern FROM free")
def e07_dna_pattern(spark, sf):
    return fx.free_variants(spark, sf).select("variant_id", hgvs.dna_pattern(hgvs.dna_core(hgvs.strip_reference(c("hgvs")))).alias("dna_pattern"))


@register("SELECT variant_id, '(?<![0-9])' || dna_pattern AS dna_pattern FROM free")
def e07_strict_dna_pattern(spark, sf):
    return fx.free_variants(spark, sf).select("variant_id", hgvs.strict_dna_pattern(hgvs.dna_core(hgvs.strip_reference(c("hgvs")))).alias("dna_pattern"))


@register("""
SELECT variant_id, array_to_string(regexp_extract_all(c_variant, '[0-9]+'), '|') AS runs,
  list_reduce(list_prepend(NULL, regexp_extract_all(c_variant, '[0-9]+')), lambda a, x: CASE WHEN a IS NULL OR length(x) > length(a) THEN x ELSE a END) AS longest FROM free""")
def e08_e09_digit_runs(spark, sf):
    v = hgvs.strip_reference(c("hgvs"))
    return fx.free_variants(spark, sf).select("variant_id", fx.tidy(hgvs.digit_runs(v)).alias("runs"), hgvs.longest_digit_run(v).alias("longest"))


@register("""
SELECT variant_id, concat_ws('|', list_reduce(list_prepend(NULL, regexp_extract_all(c_variant, '[0-9]+')), lambda a, x: CASE WHEN a IS NULL OR length(x) > length(a) THEN x ELSE a END), nullif(regexp_extract(plong, '[0-9]+'), '')) AS table_aliases,
  concat_ws('|', c_variant, nullif(plong, '')) AS text_aliases, CASE WHEN regexp_replace(description, '^.*:', '') <> 'p.(=)' THEN description END AS guarded FROM free""")
def e10_e11_aliases(spark, sf):
    v, p = hgvs.strip_reference(c("hgvs")), hgvs.long_form(c("description"))
    return fx.free_variants(spark, sf).select("variant_id", fx.tidy(hgvs.table_aliases(v, p)).alias("table_aliases"), fx.tidy(hgvs.text_aliases(v, p)).alias("text_aliases"), hgvs.silent_guard(c("description")).alias("guarded"))


@register("SELECT paper_id, seq, text || '\\n\\t caf\u00e9' AS text FROM passages WHERE text NOT LIKE '%\\%'".replace("\\n\\t", "' || chr(10) || chr(9) || '"))
def e12_unescape(spark, sf):
    """All lines with spelled-out escapes at their end, resolved; the SQL holds only those without a backslash of their own, the others are tested apart."""
    spelled = F.concat("text", F.lit("\\n\\t caf\\xc3\\xa9"))
    return fx.passages(spark, sf).select("paper_id", "seq", tx.unescape_text(spelled).alias("text"))


@register(r"""
SELECT paper_id, seq, regexp_replace('<td>\x80' || line || '\x99</td>', '\\x..', '', 'g') AS markup, replace(line || '\n' || 'end', '\n', '') AS cell, regexp_replace(chr(1) || line || chr(11) || chr(127), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS clean FROM doc_lines""")
def e13_s03_scrubbed(spark, sf):
    lines = fx.table(spark, sf, "documents").select(c("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return lines.select(
        "paper_id", "seq", tx.scrub_escapes(F.concat(F.lit("<td>\\x80"), c("line"), F.lit("\\x99</td>"))).alias("markup"),
        tx.scrub_newlines(F.concat(c("line"), F.lit("\\nend"))).alias("cell"), tx.scrub_control(F.concat(F.lit("\x01"), c("line"), F.lit("\x0b\x7f"))).alias("clean"),
    )


@register("SELECT paper_id, r, c, try_cast(coalesce(text, '') AS DOUBLE) IS NOT NULL AS number FROM grid")
def e14_is_number(spark, sf):
    return fx.grid(spark, sf).select("paper_id", "r", "c", tx.is_number(F.coalesce("text", F.lit(""))).alias("number"))


ODD_NUMBERS = "CASE l_orderkey % 10 WHEN 0 THEN n WHEN 1 THEN '-' || n WHEN 2 THEN n || '.5' WHEN 3 THEN n || 'e3' WHEN 4 THEN n || 'd' WHEN 5 THEN n || 'F' WHEN 6 THEN n || ',5' WHEN 7 THEN n || ' %' WHEN 8 THEN 'x' || n ELSE '' END"


@register(f"SELECT k, v, try_cast(v AS DOUBLE) IS NOT NULL AND v <> '' AS number FROM (SELECT l_orderkey AS k, {ODD_NUMBERS} AS v FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS n FROM lineitem))")
def e14_is_odd_number(spark, sf):
    """Numbers with signs, fractions, exponents and type suffixes, and texts that look like them."""
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", c("l_partkey").cast("string").alias("n"))
    return rows.select(c("l_orderkey").alias("k"), F.expr(ODD_NUMBERS).alias("v")).select("k", "v", tx.is_number(c("v")).alias("number"))


@register("SELECT paper_id, pos, trim(trim(lower(line), '*')) AS key FROM answer_lines")
def e15_answer_key(spark, sf):
    return fx.answer_lines(spark, sf).select("paper_id", "pos", tx.answer_key(c("line")).alias("key"))


@register("SELECT paper_id, variant_id, alias_idx, coalesce(nullif(answer, ''), 'n/a') AS shown, CASE WHEN error IS NULL THEN 'yes' ELSE 'no' END AS ok FROM answers")
def e16_present_or(spark, sf):
    return fx.answers(spark, sf).select("paper_id", "variant_id", "alias_idx", tx.present_or(c("answer"), "n/a").alias("shown"), tx.yes_no(c("error").isNull()).alias("ok"))


@register("SELECT pmid, variant, CASE WHEN in_trans <> 'NA' THEN array_to_string(string_split(in_trans, ' '), '|') END AS alternatives FROM gold")
def e18_split_in_trans(spark, sf):
    return fx.gold(spark, sf).select("pmid", "variant", F.array_join(tx.alternatives(c("in_trans")), "|").alias("alternatives"))


TASKS = "SELECT event_id AS task_id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'failed' END AS state, CASE WHEN event_id % 6 <> 3 THEN 'u' || CAST(event_id AS VARCHAR) ELSE '' END AS full_zip_url, CASE WHEN event_id % 4 = 0 THEN 'd' || CAST(event_id AS VARCHAR) ELSE '' END AS data_id FROM events"


@register("SELECT CAST(task_id AS VARCHAR) AS task_id, coalesce(nullif(data_id, ''), CAST(task_id AS VARCHAR)) AS result_key, CASE WHEN state = 'done' AND full_zip_url <> '' THEN full_zip_url END AS url FROM (" + TASKS + ")")
def e19_result_keys(spark, sf):
    return tk.result_keys(_tasks(spark, sf))


def _tasks(spark, sf):
    e = c("event_id")
    return fx.table(spark, sf, "events").select(
        e.cast("string").alias("task_id"), F.when(e % 3 == 0, "done").otherwise("failed").alias("state"),
        F.when(e % 6 != 3, F.concat(F.lit("u"), e.cast("string"))).otherwise("").alias("full_zip_url"), F.when(e % 4 == 0, F.concat(F.lit("d"), e.cast("string"))).otherwise("").alias("data_id"),
    )


# Retrieval, over the paper corpus


@register("SELECT paper_id, seq, section_type, text FROM passages WHERE upper(coalesce(section_type, '')) NOT IN ('TABLE', 'REF', 'COMP_INT', 'AUTH_CONT', 'SUPPL')")
def f01_filter_sections(spark, sf):
    return rt.prose(fx.passages(spark, sf))


@register("SELECT paper_id, seq FROM passages WHERE lower(coalesce(section_type, '')) = 'table'")
def f02_table_passages(spark, sf):
    from ..sources.papers import is_table

    return fx.passages(spark, sf).where(is_table(F.lower("section_type"))).select("paper_id", "seq")


@register("SELECT event_id, path, CASE WHEN path = '' THEN 'no path' WHEN suffix(lower(path), '.pdf') THEN 'pdf' END AS reason, NOT (path = '' OR suffix(lower(path), '.pdf')) AS accepted FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'paper_' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN '.PDF' ELSE '.xml' END END AS path FROM events)")
def f03_route_inputs(spark, sf):
    e = c("event_id")
    path = F.when(e % 7 == 0, "").otherwise(F.concat(F.lit("paper_"), e.cast("string"), F.when(e % 3 == 0, ".PDF").otherwise(".xml")))
    return rt.route_inputs(fx.table(spark, sf, "events").select("event_id", path.alias("path")))


@register("SELECT count(*) AS ids, min(pmid) AS first, max(pmid) AS last FROM (SELECT DISTINCT nullif(pmid, 0) AS pmid FROM gold) WHERE pmid IS NOT NULL")
def f04_g01_wanted_ids(spark, sf):
    return mf.wanted_ids(fx.gold(spark, sf).withColumn("pmid", F.nullif("pmid", F.lit(0)))).agg(F.count("*").alias("ids"), F.min("pmid").alias("first"), F.max("pmid").alias("last"))


@register("SELECT pmid, variant, criterion FROM gold WHERE label = 'eval'")
def f05_filter_split(spark, sf):
    return fx.gold(spark, sf).where(c("label") == "eval").select("pmid", "variant", "criterion")


@register("SELECT paper_id, body FROM papers")
def r01_flatten_papers(spark, sf):
    return fx.papers(spark, sf)


@register("SELECT paper_id, chunk_seq, text FROM chunks")
def r02b_fixed_chunks(spark, sf):
    return fx.chunks(spark, sf)


@register(f"SELECT paper_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk_seq, unnest(c) AS text FROM (SELECT paper_id, {fx.recursive_sql('body')} AS c FROM papers)")
def r02_recursive_chunks(spark, sf):
    return rt.chunk(fx.papers(spark, sf), how="recursive")


def kept_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks, cut once for all that reads them."""
    return kept(fx.chunks(spark, sf))


HITS = "SELECT paper_id, chunk_seq, variant_id, by_dna, by_long, by_short FROM hits"


@register(HITS)
def r03_r05_j01_match(spark, sf):
    """The flagship: chunks and variants joined on the numbers they share, and verified."""
    return rt.match(kept_chunks(spark, sf), fx.prepared(spark))


def many_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A variant in one of many notations for each part, prepared."""
    free = fx.free_variants(spark, sf)
    return rt.prepare_variants(free.select("variant_id", "hgvs"), free.select("hgvs", "description"))


@register("""
SELECT paper_id, chunk_seq, variant_id, bool_or(h.way = 'dna') AS by_dna, bool_or(h.way = 'long') AS by_long, bool_or(h.way = 'short') AS by_short
FROM many_hits h JOIN many_forms f ON f.way = h.way AND f.form = h.form GROUP BY paper_id, chunk_seq, variant_id""")
def j01_match_many_variants(spark, sf):
    """Chunks matched with a variant for each part: thousands at sf0.1, where a nested loop would try every pair."""
    return rt.match(kept_chunks(spark, sf), many_variants(spark, sf))


@register("SELECT paper_id, chunk_seq, variant_id FROM chunks, variants WHERE coalesce(contains(lower(text), lower(nullif(pshort, ''))), false) OR contains(text, c_variant)")
def x02_matcher_plugin(spark, sf):
    """A matcher of the user's own, the short protein form in any case or the change as it is written, by its own tokens: the numbers in both."""

    def accepts(body, variant):
        return F.contains(F.lower(body), F.lower(F.nullif(variant["pshort"], F.lit("")))) | F.contains(body, variant["c_variant"])

    numbers = lambda v: F.array_compact(F.array(hgvs.first_digit_run(v["c_variant"]), hgvs.first_digit_run(v["pshort"])))
    return rt.match_with(kept_chunks(spark, sf), fx.prepared(spark), rt.Matcher(accepts, hgvs.digit_runs, numbers))


GENES = ("and", "The", "pour", "nicht", "que", "will", "est", "der")
_GENE = "element_at(array(" + ", ".join(f"'{g}'" for g in GENES) + "), CAST(n_nationkey % {} AS INT) + 1)".format(len(GENES))


@register(f"""
SELECT paper_id, chunk_seq, variant_id FROM (SELECT DISTINCT paper_id, chunk_seq, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM chunks)
JOIN (SELECT n_nationkey AS variant_id, ([{", ".join(f"'{g}'" for g in GENES)}])[CAST(n_nationkey % {len(GENES)} AS INT) + 1] AS gene FROM nation) ON gene = w""")
def x02_gene_matcher(spark, sf):
    """A matcher on gene names, here words, that finds them in chunks without any number."""
    variants = fx.table(spark, sf, "nation").select(c("n_nationkey").alias("variant_id"), F.expr(_GENE).alias("gene"))
    words = lambda body: F.regexp_extract_all(body, F.lit("([A-Za-z]+)"), 1)
    accepts = lambda body, v: F.array_contains(words(body), v["gene"])
    return rt.match_with(kept_chunks(spark, sf), variants, rt.Matcher(accepts, words, lambda v: F.array(v["gene"])))


@register("SELECT paper_id, chunk_seq, variant_id FROM spots")
def r06_position_fallback(spark, sf):
    chunks, variants = kept_chunks(spark, sf), fx.prepared(spark)
    return rt.position_fallback(chunks, variants, rt.match(chunks, variants))


@register("SELECT paper_id, variant_id, chunk_seq, match_kind, CAST(rank AS INT) AS rank FROM top")
def r07_w01_top_chunks(spark, sf):
    return rt.top_chunks(rt.retrieve(kept_chunks(spark, sf), fx.prepared(spark)), 5).select("paper_id", "variant_id", "chunk_seq", "match_kind", "rank")


@register("SELECT * EXCLUDE (total_chunks) FROM counters")
def r08_g06_match_counters(spark, sf):
    return rt.match_counters(fx.pairs(spark, sf), rt.retrieve(kept_chunks(spark, sf), fx.prepared(spark)))


@register("SELECT paper_id, c.variant_id, total_chunks > 0 AS ok, total_chunks, pshort AS short_form FROM counters c JOIN variants v ON v.variant_id = c.variant_id")
def r09_retrieval_summary(spark, sf):
    variants = fx.prepared(spark)
    return rt.retrieval_summary(fx.pairs(spark, sf), rt.retrieve(kept_chunks(spark, sf), variants), variants)


def _top(spark, sf):
    chunks, variants = kept_chunks(spark, sf), fx.prepared(spark)
    return rt.top_chunks(rt.retrieve(chunks, variants), 5), chunks, variants


@register("SELECT paper_id, variant_id, context FROM context")
def r10_stuff_context(spark, sf):
    top, chunks, _ = _top(spark, sf)
    return rt.stuff_context(top, chunks)


@register("""
SELECT t.paper_id, t.variant_id, bool_or(contains(c.text, c_variant)) AS dna_in_sources, bool_or(coalesce(contains(c.text, nullif(regexp_extract(plong, '[0-9]+'), '')), false)) AS protein_in_sources
FROM top t JOIN chunks c ON c.paper_id = t.paper_id AND c.chunk_seq = t.chunk_seq JOIN variants v ON v.variant_id = t.variant_id GROUP BY t.paper_id, t.variant_id""")
def r11_alias_in_sources(spark, sf):
    return rt.alias_in_sources(*_top(spark, sf))


@register("SELECT p.paper_id, p.variant_id FROM pairs p JOIN counters c ON c.paper_id = p.paper_id AND c.variant_id = p.variant_id WHERE total_chunks > 0")
def f07_j07_relevant(spark, sf):
    pairs, variants = fx.pairs(spark, sf), fx.prepared(spark)
    return rt.relevant(pairs, rt.retrieval_summary(pairs, rt.retrieve(kept_chunks(spark, sf), variants), variants))


@register("SELECT p.paper_id, p.variant_id, protein_status, plong, pshort FROM pairs p JOIN variants v ON v.variant_id = p.variant_id")
def j04_normalisation_join(spark, sf):
    return fx.pairs(spark, sf).join(fx.prepared(spark), "variant_id").select("paper_id", "variant_id", "protein_status", "plong", "pshort")


@register("SELECT variant_id, pshort FROM free")
def j02_residue_lookup(spark, sf):
    """The residue map as a join: the long form's residues are looked up in the table of the map, in its order."""
    residues = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(hgvs.RESIDUES)], "ord int, long3 string, short1 string")
    rules = residues.agg(F.array_sort(F.collect_list(F.struct("ord", "long3", "short1"))).alias("rules"))
    trimmed = hgvs.trim_frameshift(hgvs.protein_body(c("description")))
    short = F.aggregate("rules", c("trimmed"), lambda s, r: F.replace(s, r["long3"], r["short1"]))
    rows = fx.free_variants(spark, sf).select("variant_id", F.when(hgvs.protein_status(c("description")) == "ok", trimmed).alias("trimmed")).join(F.broadcast(rules))
    return rows.select("variant_id", hgvs.drop_stop_symbols(short).alias("pshort"))


# Paper tables, over orders and their lines


@register("SELECT paper_id, part, CAST(max(c) + 1 AS BIGINT) AS width FROM grid GROUP BY paper_id, part")
def t03_grid_width(spark, sf):
    return tb.grid_width(fx.grid(spark, sf)).select("paper_id", "part", "width")


@register("SELECT paper_id, c, header FROM headers")
def t04_merge_headers(spark, sf):
    return tb.merge_headers(fx.grid(spark, sf)).select("paper_id", "c", "header")


@register("SELECT paper_id, CASE WHEN r = 0 THEN 'head' ELSE 'body' END AS part, CASE WHEN r > 0 THEN r - 1 ELSE r END AS r, c, text FROM grid WHERE part = 'body'")
def t05_promote_first_row(spark, sf):
    return tb.promote_first_row(fx.grid(spark, sf).where("part = 'body'")).select("paper_id", "part", "r", "c", "text")


@register("SELECT paper_id, c, string_agg(coalesce(text, ''), ' ' ORDER BY r) AS header FROM grid WHERE part = 'head' GROUP BY paper_id, c")
def t06_merge_headers_all(spark, sf):
    return tb.merge_headers(fx.grid(spark, sf), distinct=False).select("paper_id", "c", "header")


@register("SELECT paper_id, part, r, c, coalesce(text, '') AS text FROM grid")
def t07_normalise_cells(spark, sf):
    return tb.normalise_cells(fx.grid(spark, sf)).select("paper_id", "part", "r", "c", "text")


@register("""
SELECT paper_id, string_agg(line, chr(10) ORDER BY r) AS csv FROM (
  SELECT paper_id, r, string_agg(t, ',' ORDER BY c) AS line FROM (
    SELECT paper_id, -1 AS r, c, header AS t FROM headers UNION ALL SELECT paper_id, r, c, coalesce(text, '') FROM grid WHERE part = 'body') GROUP BY paper_id, r) GROUP BY paper_id""")
def t08_table_to_csv(spark, sf):
    return tb.table_to_csv(fx.grid(spark, sf)).select("paper_id", "csv")


def _quoted_sql(v: str) -> str:
    return f"""CASE WHEN contains({v}, ',') OR contains({v}, '"') OR contains({v}, chr(10)) THEN '"' || replace({v}, '"', '""') || '"' ELSE {v} END"""


@register(f"""
SELECT p_brand AS paper_id, 'name,"a, b"' || chr(10) || string_agg({_quoted_sql('n')} || ',' || {_quoted_sql('t')}, chr(10) ORDER BY p_partkey) AS csv
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', etc' ELSE p_name END AS n, CASE p_partkey % 4 WHEN 0 THEN '"' || p_type || '"' WHEN 1 THEN p_type || chr(10) || 'x' ELSE p_type END AS t FROM part) GROUP BY p_brand""")
def t08_quoted_csv(spark, sf):
    """Parts as a table for each brand, with commas, quotes and line ends in cells and a header."""
    from pyspark.sql import Window

    k = c("p_partkey")
    n = F.when(k % 3 == 0, F.concat("p_name", F.lit(", etc"))).otherwise(c("p_name"))
    t = F.when(k % 4 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).when(k % 4 == 1, F.concat("p_type", F.lit("\nx"))).otherwise(c("p_type"))
    parts = fx.table(spark, sf, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    body = parts.select(c("p_brand").alias("paper_id"), F.lit(0).alias("table_seq"), F.lit("body").alias("part"), "r", F.posexplode(F.array(n, t)).alias("c", "text"))
    head = parts.select(c("p_brand").alias("paper_id")).distinct().select("paper_id", F.lit(0).alias("table_seq"), F.lit("head").alias("part"), F.lit(0).alias("r"), F.posexplode(F.array(F.lit("name"), F.lit("a, b"))).alias("c", "text"))
    return tb.table_to_csv(head.unionByName(body)).select("paper_id", "csv")


@register("SELECT DISTINCT paper_id, r FROM cell_hits")
def t09_variant_rows(spark, sf):
    return tb.variant_rows(tb.alias_hits(fx.grid(spark, sf), fx.aliases(spark, sf))).select("paper_id", "r")


@register("SELECT paper_id, c, hits FROM (SELECT paper_id, c, count(*) AS hits, row_number() OVER (PARTITION BY paper_id ORDER BY count(*) DESC, c) AS n FROM cell_hits GROUP BY paper_id, c) WHERE n = 1")
def t10_w05_variant_column(spark, sf):
    return tb.variant_column(tb.alias_hits(fx.grid(spark, sf), fx.aliases(spark, sf))).select("paper_id", "c", "hits")


@register("SELECT g.paper_id, count(DISTINCT h.r) AS hit_rows, count(DISTINCT h.c) AS hit_columns, CASE WHEN count(h.r) > 0 THEN 'match' ELSE 'no match' END AS verdict FROM (SELECT DISTINCT paper_id FROM grid) g LEFT JOIN cell_hits h ON h.paper_id = g.paper_id GROUP BY g.paper_id")
def t11_summarise_hits(spark, sf):
    grid = fx.grid(spark, sf)
    return tb.summarise_hits(grid, tb.alias_hits(grid, fx.aliases(spark, sf))).drop("table_seq")


@register("SELECT o_custkey AS paper_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS table_seq FROM orders")
def t12_number_tables(spark, sf):
    return tb.number_tables(fx.table(spark, sf, "orders").select(c("o_custkey").alias("paper_id"), c("o_orderkey").alias("k")), "k")


NESTED = "SELECT conv_id AS paper_id, CAST(turn AS INT) AS table_seq, CAST(unnest(range(0, len(l))) AS INT) AS pos, unnest(l) AS plain FROM (SELECT conv_id, turn, string_split(text, '. ') AS l FROM conversations)"


@register(f"SELECT * FROM ({NESTED}) WHERE plain <> ''")
def t13_table_answers(spark, sf):
    entries = F.transform(F.split("text", r"\. "), lambda s: F.struct(F.nullif(s, F.lit("")).alias("plainText")))
    return tb.table_answers(fx.table(spark, sf, "conversations").select(c("conv_id").alias("paper_id"), c("turn").cast("int").alias("table_seq"), entries.alias("entries")))


@register("SELECT d.doc_id AS paper_id, CAST(turn AS INT) AS table_seq, coalesce(nullif(c.text, ''), 'No table found') AS plain FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id")
def t14_default_when_no_tables(spark, sf):
    said = fx.table(spark, sf, "conversations").select(c("conv_id").alias("paper_id"), c("turn").cast("int").alias("table_seq"), F.nullif("text", F.lit("")).alias("plain"))
    return tb.or_no_table(fx.table(spark, sf, "documents").select(c("doc_id").alias("paper_id")), said)


@register("SELECT g.paper_id, g.r, string_agg(coalesce(header, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY g.c) AS lines FROM grid g LEFT JOIN headers h ON h.paper_id = g.paper_id AND h.c = g.c WHERE part = 'body' GROUP BY g.paper_id, g.r")
def t15_verbalise_rows(spark, sf):
    return tb.verbalise_rows(fx.grid(spark, sf)).select("paper_id", "r", "lines")


@register("SELECT paper_id, c, text FROM grid WHERE part = 'body' AND r = 1")
def f11_row_at(spark, sf):
    return tb.row_at(fx.grid(spark, sf), 1).select("paper_id", "c", "text")


PAGE_TEXTS = """SELECT paper_id, CAST(unnest(range(0, len(l))) AS INT) AS r, unnest(l) AS t FROM (SELECT page_id AS paper_id, regexp_extract_all(html, '>([^<>]+)<', 1) AS l FROM pages)"""


@register(f"""
SELECT paper_id, 0 AS table_seq, 'body' AS part, r, c, CASE WHEN c = 0 THEN 'all' ELSE replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') END AS text
FROM ({PAGE_TEXTS}), (VALUES (0), (1)) v(c)""")
def t01_t02_page_tables(spark, sf):
    """All texts of the raw pages as tables of two columns, one cell spanning all rows: markup to grid."""
    texts = F.regexp_extract_all("html", F.lit(">([^<>]+)<"), 1)
    rows = F.transform(texts, lambda s, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.lit("<td rowspan=0>all</td>")).otherwise(""), F.lit("<td colspan='1'>"), s, F.lit("</td></tr>")))
    raw = fx.table(spark, sf, "pages").select(c("page_id").alias("paper_id"), F.lit(0).alias("table_seq"), F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("markup"))
    return tb.table_grid(raw)


WIDE = "CASE o_orderkey % 5 WHEN 0 THEN 1000000000 WHEN 1 THEN 12345678901 ELSE o_orderkey % 4 + 1 END"


@register(f"""
SELECT k, CAST(c % 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, CASE WHEN c // 2 = n THEN s WHEN c % 2 = 0 THEN 'k' WHEN c // 2 = 0 THEN 'x' END AS text, CAST(NULL AS BIGINT) AS width
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, {WIDE} AS n, unnest(range(0, CASE WHEN o_orderkey % 5 > 1 THEN 2 * (CAST({WIDE} AS BIGINT) + 1) ELSE 0 END)) AS c FROM orders)
UNION ALL SELECT o_orderkey, -1, -1, NULL, 1000000001 FROM orders WHERE o_orderkey % 5 < 2""")
def t02_spans_within_a_limit(spark, sf):
    """Orders as tables whose first cell is up to a thousand million columns wide: grids, and as row -1 the tables that are none."""
    markup = F.concat(F.lit("<table><tr><td colspan='"), F.expr(f"CAST({WIDE} AS STRING)"), F.lit("'>k</td><td rowspan=2>"), c("o_orderstatus"), F.lit("</td></tr><tr><td>x</td></tr></table>"))
    raw = fx.table(spark, sf, "orders").select(c("o_orderkey").alias("paper_id"), F.lit(0).alias("table_seq"), markup.alias("markup"))
    laid = tb.placed(tb.table_parts(raw))
    # a table that is none has one run, of one place: both are told in one pass
    told = F.array(F.struct(F.lit(-1).alias("r"), F.lit(-1).alias("first"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("text")))
    runs = laid.select("paper_id", "width", F.explode(F.coalesce("runs", told)).alias("x"))
    grid = runs.select(c("paper_id").alias("k"), c("x.r").alias("r"), F.explode(F.sequence("x.first", c("x.end") - 1)).alias("c"), c("x.text").alias("text"), "width")
    return grid.withColumn("width", F.when(c("r") < 0, c("width")))


# Questions, answers and reports


@register("""
SELECT p.paper_id, p.variant_id, alias_idx, qtype, CASE WHEN alias_idx = 0 THEN c_variant ELSE plong END AS alias
FROM pairs p JOIN context x ON x.paper_id = p.paper_id AND x.variant_id = p.variant_id JOIN variants v ON v.variant_id = p.variant_id, (VALUES (0), (1)) a(alias_idx), (VALUES (0), (1)) q(qtype)
WHERE CASE WHEN alias_idx = 0 THEN c_variant ELSE nullif(plong, '') END IS NOT NULL""")
def a01_j06_questions(spark, sf):
    top, chunks, variants = _top(spark, sf)
    return an.ask(fx.pairs(spark, sf), rt.stuff_context(top, chunks), variants).drop("context", "c_variant")


def _questions(spark, sf):
    top, chunks, variants = _top(spark, sf)
    return an.ask(fx.pairs(spark, sf), rt.stuff_context(top, chunks), variants)


ASKED = """
SELECT x.paper_id, x.variant_id, alias_idx, qtype, CASE WHEN alias_idx = 0 THEN c_variant ELSE plong END AS alias, c_variant, context
FROM context x JOIN variants v ON v.variant_id = x.variant_id, (VALUES (0), (1)) a(alias_idx), (VALUES (0), (1)) q(qtype) WHERE CASE WHEN alias_idx = 0 THEN c_variant ELSE nullif(plong, '') END IS NOT NULL"""
PROMPT = """CASE WHEN qtype = 0 THEN 'Does the text mention the variant ' || alias || '? Begin with yes or no and quote the sentence.' || chr(10) || chr(10) || 'Text:' || chr(10) || context
  ELSE 'Which variants occur in trans with ' || alias || ', one on each line? Say none if there are none.' || chr(10) || chr(10) || 'Text:' || chr(10) || context END"""


@register(f"SELECT paper_id, variant_id, alias_idx, qtype, length({PROMPT}) AS n_chars, md5({PROMPT}) AS md5 FROM ({ASKED})")
def e17_prompts(spark, sf):
    return an.render_prompts(_questions(spark, sf)).select("paper_id", "variant_id", "alias_idx", "qtype", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("md5"))


@register(f"""
SELECT paper_id, variant_id, alias_idx, qtype, CASE WHEN n % 7 <> 0 THEN CAST(n AS VARCHAR) || ' signs about ' || alias END AS answer, CASE WHEN n % 7 = 0 THEN 'TimeoutError: too slow' END AS error, CASE WHEN n % 7 = 0 THEN 'timeout' END AS reason
FROM (SELECT *, length({PROMPT}) AS n FROM ({ASKED}))""")
def x01_answerer_plugin(spark, sf):
    """Every prompt answered by a user's function, which fails for one in seven: rows with an error, and the job goes on."""

    def answerer(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise TimeoutError("too slow")
        named = prompt.split("?")[0].split(",")[0].split(" ")[-1]
        return f"{len(prompt)} signs about {named}"

    return an.judge(an.answered_by(an.render_prompts(_questions(spark, sf)), answerer)).select("paper_id", "variant_id", "alias_idx", "qtype", "answer", "error", "reason")


@register(rf"""
SELECT x.paper_id, x.variant_id, CASE WHEN contains(context, c_variant) THEN 'yes: ' || regexp_replace(substr(context, greatest(instr(context, c_variant) - 80, 1), length(c_variant) + least(instr(context, c_variant) - 1, 80) + 80), '[ \t-\r]+', ' ', 'g') ELSE 'none' END AS mention
FROM context x JOIN variants v ON v.variant_id = x.variant_id""")
def a02_mention_answer(spark, sf):
    top, chunks, variants = _top(spark, sf)
    rows = rt.stuff_context(top, chunks).join(variants.select("variant_id", "c_variant"), "variant_id")
    return rows.select("paper_id", "variant_id", an.mention_answer(c("context"), c("c_variant")).alias("mention"))


@register("SELECT x.paper_id, x.variant_id, CASE WHEN contains(lower(context), 'compound het') OR contains(lower(context), 'in trans') THEN 'compound heterozygous' WHEN contains(lower(context), 'homozyg') THEN 'homozygous' ELSE 'none' END AS zygosity FROM context x")
def a04_zygosity(spark, sf):
    top, chunks, _ = _top(spark, sf)
    return rt.stuff_context(top, chunks).select("paper_id", "variant_id", an.zygosity_cue(c("context")).alias("zygosity"))


@register(r"""
SELECT x.paper_id, x.variant_id, regexp_replace(m, '[ \t-\r]+', '', 'g') AS partner FROM (SELECT paper_id, variant_id, unnest(regexp_extract_all(context, 'c\.[ \t-\r]*[0-9]+[ \t-\r]*[ACGT][ \t-\r]*>[ \t-\r]*[ACGT]')) AS m FROM context) x
JOIN variants v ON v.variant_id = x.variant_id WHERE regexp_replace(m, '[ \t-\r]+', '', 'g') <> c_variant GROUP BY ALL""")
def a03_in_trans_partners(spark, sf):
    top, chunks, variants = _top(spark, sf)
    rows = rt.stuff_context(top, chunks).join(variants.select("variant_id", "c_variant"), "variant_id")
    return rows.select("paper_id", "variant_id", F.explode(an.partners(c("context"), c("c_variant"))).alias("partner"))


@register("SELECT q.paper_id, q.variant_id, q.alias_idx, q.qtype, a.answer, a.error FROM (SELECT paper_id, variant_id, alias_idx, qtype FROM answers UNION SELECT paper_id + 1000000, variant_id, alias_idx, qtype FROM answers WHERE paper_id % 50 = 0) q LEFT JOIN answers a ON a.paper_id = q.paper_id AND a.variant_id = q.variant_id AND a.alias_idx = q.alias_idx AND a.qtype = q.qtype")
def j05_a05_join_answers(spark, sf):
    answers = fx.answers(spark, sf)
    keys = answers.select("paper_id", "variant_id", "alias_idx", "qtype")
    asked = keys.union(keys.where("paper_id % 50 = 0").withColumn("paper_id", c("paper_id") + 1_000_000)).distinct()
    return an.join_answers(asked, answers)


@register("SELECT paper_id, variant_id, alias_idx, answer FROM answers WHERE NOT contains(lower(answer), 'none') OR contains(lower(answer), 'contain')")
def f08_filter_none(spark, sf):
    return fx.answers(spark, sf).where(tx.says_something(c("answer"))).select("paper_id", "variant_id", "alias_idx", "answer")


@register("SELECT paper_id, variant_id, alias_idx, reason FROM judged")
def f09_failed_answers(spark, sf):
    return an.judge(fx.answers(spark, sf)).select("paper_id", "variant_id", "alias_idx", "reason")


def _good(spark, sf):
    return an.judge(fx.answers(spark, sf)).where("reason IS NULL")


LINES = r"SELECT paper_id, variant_id, alias_idx, unnest(list_filter(list_transform(regexp_split_to_array(answer, '\r\n|\r|\n|[.] '), lambda x: trim(x)), lambda x: x <> '')) AS line FROM good"


@register(LINES)
def f10_a07_answer_lines(spark, sf):
    """Sentences count as lines here."""
    lines = tx.answer_lines(F.regexp_replace("answer", r"\. ", "\n"))
    return _good(spark, sf).select("paper_id", "variant_id", "alias_idx", F.explode(lines).alias("line"))


@register("SELECT paper_id, variant_id, coalesce(bool_or(contains(lower(answer), 'yes') AND qtype = 0), false) AS variant_hit FROM good GROUP BY paper_id, variant_id")
def g05_variant_hit(spark, sf):
    return an.variant_hit(_good(spark, sf))


@register("""
SELECT paper_id, variant_id, coalesce(string_agg(CASE WHEN alias_idx = 0 THEN 'DNA match: ' ELSE 'Protein match: ' END || answer, chr(10) ORDER BY alias_idx, answer) FILTER (WHERE contains(lower(answer), 'yes')), 'Variant not found in the text') AS mention
FROM good WHERE qtype = 0 GROUP BY paper_id, variant_id""")
def a06_compose_mention(spark, sf):
    return an.compose_mention(_good(spark, sf))


@register("SELECT paper_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, trim(trim(lower(line), '*')) ORDER BY pos) AS n FROM answer_lines) WHERE n = 1")
def w02_ordered_dedupe(spark, sf):
    return an.first_of_each(fx.answer_lines(spark, sf), ["paper_id"], "pos", "line")


@register("SELECT paper_id, string_agg('- ' || line, chr(10) ORDER BY pos) AS bullets FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, trim(trim(lower(line), '*')) ORDER BY pos) AS n FROM answer_lines) WHERE n = 1 GROUP BY paper_id")
def a08_bullet_list(spark, sf):
    return an.bullet_list(an.first_of_each(fx.answer_lines(spark, sf), ["paper_id"], "pos", "line"), ["paper_id"], "pos", "line")


@register("SELECT DISTINCT paper_id, unnest(string_split(answer, ',')) AS piece FROM good WHERE NOT contains(lower(answer), 'none') OR contains(lower(answer), 'contain')")
def u02_comma_union(spark, sf):
    return an.comma_union(_good(spark, sf), ["paper_id"], "answer")


@register("""
SELECT paper_id, 0 AS variant_id, 0 AS section_idx, CAST(pos AS BIGINT) AS pos, line FROM answer_lines
UNION ALL SELECT paper_id, variant_id, CASE WHEN alias_idx = 0 THEN 1 ELSE 2 END, CAST(0 AS BIGINT), answer FROM good""")
def u03_merge_evidence(spark, sf):
    good = _good(spark, sf).select("paper_id", "variant_id", F.lit(0).alias("pos"), c("answer").alias("line"), "alias_idx")
    tables = fx.answer_lines(spark, sf).withColumn("variant_id", F.lit(0))
    return an.merge_evidence((0, tables), (1, good.where("alias_idx = 0")), (2, good.where("alias_idx = 1")))


def _found(spark, sf):
    """(found, chunks, variants): the retrieval of all pairs, written once; counters, summaries and contexts read it."""
    chunks, variants = kept_chunks(spark, sf), fx.prepared(spark)
    return kept(rt.retrieve(chunks, variants)), chunks, variants


def _diagnostics(pairs, found, variants):
    return an.diagnostics_of(rt.match_summary(pairs, found), variants)


@register(r"""
SELECT paper_id, c.variant_id, hgvs, var_dna, protein_status AS status, description, plong AS long_form, pshort AS short_form, dna_pattern AS pattern, dna_matched, dna_chunks, long_chunks, short_chunks, fallback_triggered,
  '\D' || regexp_extract(var_dna, '[0-9]+') || '\D' AS dna_position, '\D' || nullif(regexp_extract(plong, '[0-9]+'), '') || '\D' AS protein_position, fallback_chunks, total_chunks > 0 AS ok, total_chunks
FROM counters c JOIN variants v ON v.variant_id = c.variant_id""")
def a10_diagnostics(spark, sf):
    d = "diagnostics"
    names = {
        "hgvs": "input_hgvs", "var_dna": "var_dna", "status": "normalization.status", "description": "normalization.raw_description", "long_form": "normalization.long_form", "short_form": "normalization.short_form", "pattern": "dna_search.pattern", "dna_matched": "dna_search.matched",
        "dna_chunks": "dna_search.chunks", "long_chunks": "protein_search.long_chunks", "short_chunks": "protein_search.short_chunks", "fallback_triggered": "position_fallback.triggered", "dna_position": "position_fallback.dna_pattern",
        "protein_position": "position_fallback.protein_pattern", "fallback_chunks": "position_fallback.chunks", "ok": "summary.ok", "total_chunks": "summary.total_chunks",
    }
    found, _, variants = _found(spark, sf)
    return _diagnostics(fx.pairs(spark, sf), found, variants).select("paper_id", "variant_id", *(c(f"{d}.{path}").alias(n) for n, path in names.items()))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Every asked pair's report: retrieval, questions answered by rule, table evidence, diagnostics."""
    pairs = fx.pairs(spark, sf)
    found, chunks, variants = _found(spark, sf)
    contexts = rt.stuff_context(rt.top_chunks(found, 5), chunks)
    good = kept(an.judge(an.built_in_answers(an.ask(pairs, contexts, variants))).where("reason IS NULL").drop("context", "prompt"))
    trans = an.bullet_list(an.first_of_each(an.in_trans_lines(good), an.PAIR, "pos", "line"), an.PAIR, "pos", "line")
    named = variants.select("variant_id", F.explode(hgvs.table_aliases(c("c_variant"), c("plong"))).alias("alias"))
    asked = pairs.join(named, "variant_id").select("paper_id", "variant_id", "alias")
    # the tables of papers that are asked about: others are neither sorted nor spelled out
    grid = fx.grid(spark, sf, fx.table(spark, sf, "documents").select(c("doc_id").alias("paper_id")))
    hits = tb.alias_hits(grid, asked.select("paper_id", "alias").distinct()).join(asked, ["paper_id", "alias"]).select("paper_id", "table_seq", "variant_id", "r").distinct()
    lines = hits.join(tb.verbalise_rows(grid), ["paper_id", "table_seq", "r"]).select("paper_id", "variant_id", c("r").alias("pos"), F.replace("lines", F.lit("\n"), F.lit("; ")).alias("line"))
    return an.build_report(pairs, an.bullet_list(lines, an.PAIR, "pos", "line"), an.compose_mention(good), trans, _diagnostics(pairs, found, variants))


MENTIONS = rf"""
SELECT paper_id, variant_id, string_agg(CASE WHEN alias_idx = 0 THEN 'DNA match: ' ELSE 'Protein match: ' END || m, chr(10) ORDER BY alias_idx, m) FILTER (WHERE contains(lower(m), 'yes')) AS mention FROM (
  SELECT *, CASE WHEN contains(context, alias) THEN 'yes: ' || regexp_replace(substr(context, greatest(instr(context, alias) - 80, 1), length(alias) + least(instr(context, alias) - 1, 80) + 80), '[ \t-\r]+', ' ', 'g') ELSE 'none' END AS m
  FROM ({ASKED}) WHERE qtype = 0) GROUP BY paper_id, variant_id"""
CHANGES = an.CHANGE.replace(r"\s", r"[ \t-\r]")
TRANS = rf"""
SELECT paper_id, variant_id, string_agg('- ' || p, chr(10) ORDER BY i) AS trans FROM (
  SELECT paper_id, m.variant_id, regexp_replace(m, '[ \t-\r]+', '', 'g') AS p, min(i) AS i FROM (
    SELECT paper_id, variant_id, generate_subscripts(l, 1) AS i, unnest(l) AS m FROM (SELECT *, regexp_extract_all(context, '{CHANGES}') AS l FROM context x)) m
  JOIN variants v ON v.variant_id = m.variant_id WHERE regexp_replace(m, '[ \t-\r]+', '', 'g') <> c_variant GROUP BY ALL) GROUP BY paper_id, variant_id"""
TABLE_LINES = """
SELECT h.paper_id, h.variant_id, string_agg('- ' || line, chr(10) ORDER BY h.r, line) AS lines FROM (
  SELECT DISTINCT g.paper_id, v.variant_id, g.r FROM grid g JOIN pairs p ON p.paper_id = g.paper_id JOIN variants v ON v.variant_id = p.variant_id
  WHERE part = 'body' AND (contains(text, regexp_extract(c_variant, '[0-9]+')) OR coalesce(contains(text, nullif(regexp_extract(plong, '[0-9]+'), '')), false))) h
JOIN (SELECT g.paper_id, g.r, string_agg(coalesce(header, '') || ': ' || coalesce(text, ''), '; ' ORDER BY g.c) AS line FROM grid g LEFT JOIN headers h ON h.paper_id = g.paper_id AND h.c = g.c WHERE part = 'body' GROUP BY g.paper_id, g.r) l
  ON l.paper_id = h.paper_id AND l.r = h.r GROUP BY h.paper_id, h.variant_id"""


_NUMBER = r"'\D' || nullif(regexp_extract({}, '[0-9]+'), '') || '\D'"
#: The record's fields in SQL, by the record they are in; flags end in ?.
FIELDS = {
    "": {"input hgvs": "hgvs", "var dna": "var_dna"},
    "normalization": {"status": "protein_status", "raw description": "description", "stripped": fx._BODY, "long form": "plong", "short form": "pshort", "digits": "array_to_string(regexp_extract_all(plong, '[0-9]+'), ',')"},
    "dna search": {"pattern": "dna_pattern", "matched?": "dna_matched", "chunks": "dna_chunks"},
    "protein search": {"long matched?": "long_matched", "long chunks": "long_chunks", "short matched?": "short_matched", "short chunks": "short_chunks"},
    "position fallback": {"triggered?": "fallback_triggered", "dna pattern": _NUMBER.format("var_dna"), "protein pattern": _NUMBER.format("plong"), "matched?": "fallback_matched", "chunks": "fallback_chunks"},
    "summary": {"ok?": "total_chunks > 0", "total chunks": "total_chunks", "short form": "pshort"},
}


def _field(label: str, value: str) -> str:
    said = f"CASE WHEN {value} THEN 'yes' ELSE 'no' END" if label.endswith("?") else f"coalesce(nullif(CAST({value} AS VARCHAR), ''), 'n/a')"
    return f"'{label.rstrip('?')}: ' || {said}"


DIAGNOSTICS = ", ".join(line for heading, fields in FIELDS.items() for line in ([f"chr(10) || '## {heading}'"] if heading else []) + [_field(k, v) for k, v in fields.items()])
REPORT = f"""
SELECT c.paper_id, c.variant_id, 'Evidence summary' AS title, 4 AS n_sections,
  'Variant and genotype in tables' || chr(10) || coalesce(lines, 'No table evidence') || chr(10) || chr(10) || 'Variant in the text' || chr(10) || coalesce(mention, 'Variant not found in the text') || chr(10) || chr(10)
  || 'Variants in trans in the text' || chr(10) || coalesce(trans, 'None') || chr(10) || chr(10) || 'Diagnostics' || chr(10) || concat_ws(chr(10), {DIAGNOSTICS}) AS report
FROM counters c JOIN variants v ON v.variant_id = c.variant_id LEFT JOIN ({TABLE_LINES}) t ON t.paper_id = c.paper_id AND t.variant_id = c.variant_id
LEFT JOIN ({MENTIONS}) m ON m.paper_id = c.paper_id AND m.variant_id = c.variant_id LEFT JOIN ({TRANS}) x ON x.paper_id = c.paper_id AND x.variant_id = c.variant_id"""


def _flat(r):
    parts = F.transform("report.sections", lambda s: F.concat(s["title"], F.lit("\n"), s["body"]))
    return r.select("paper_id", "variant_id", c("report.title").alias("title"), F.size("report.sections").alias("n_sections"), F.array_join(parts, "\n\n").alias("report"))


@register(REPORT)
def a09_a11_reports(spark, sf):
    return _flat(reports(spark, sf))


@register(REPORT)
def s13_write_reports(spark, sf):
    """The reports as their sink keeps them."""
    from ..sources.reference import write_reports

    path = fx.scratch(spark)
    write_reports(reports(spark, sf), path)
    return _flat(spark.read.parquet(path))


# Manifests and evaluation


@register("SELECT doc_id AS pmid FROM documents ANTI JOIN labels USING (doc_id)")
def j03_u01_still_to_fetch(spark, sf):
    return mf.still_to_fetch(fx.table(spark, sf, "documents").select(c("doc_id").alias("pmid")), fx.table(spark, sf, "labels").select(c("doc_id").alias("pmid")))


LOG = "SELECT doc_id AS pmid, doc_id % 10 <> 0 AS ok FROM documents ANTI JOIN labels USING (doc_id)"


def _fetch_log(spark, sf):
    return j03_u01_still_to_fetch(spark, sf).withColumn("ok", c("pmid") % 10 != 0)


@register(f"SELECT (SELECT count(*) FROM documents) AS wanted, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS existing, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS to_do, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM ({LOG})")
def g02_fetch_counts(spark, sf):
    docs, labels = (fx.table(spark, sf, t).select(c("doc_id").alias("pmid")) for t in ("documents", "labels"))
    return mf.fetch_counts(docs, labels, _fetch_log(spark, sf))


@register(f"SELECT pmid FROM ({LOG}) WHERE NOT ok")
def s11_failed_ids(spark, sf):
    return mf.failed_ids(_fetch_log(spark, sf))


@register("SELECT label, criterion, count(*) AS pairs, count(DISTINCT pmid) AS papers, CAST(sum(try_cast(patients AS INT)) AS BIGINT) AS patients FROM gold GROUP BY label, criterion")
def g07_benchmark_profile(spark, sf):
    return mf.profile(fx.gold(spark, sf))


# what the built-in answers say: pairs with a mention, and the other known variants of their contexts
SAID = f"SELECT paper_id, variant_id FROM ({MENTIONS}) WHERE mention IS NOT NULL"
PARTNERS = rf"""
SELECT t.paper_id, t.variant_id, list(DISTINCT 'v' || CAST(w.variant_id AS VARCHAR)) AS partners
FROM (SELECT paper_id, variant_id, regexp_replace(unnest(regexp_extract_all(context, '{CHANGES}')), '[ \t-\r]+', '', 'g') AS p FROM context x) t
JOIN variants v ON v.variant_id = t.variant_id JOIN variants w ON w.c_variant = t.p WHERE t.p <> v.c_variant GROUP BY t.paper_id, t.variant_id"""
EVALUATED = f"""
SELECT g.pmid, g.variant, label, h.paper_id IS NOT NULL AS hit, CASE WHEN in_trans <> 'NA' THEN h.paper_id IS NOT NULL AND coalesce(list_has_any(string_split(in_trans, ' '), partners), false) END AS trans_hit
FROM gold g LEFT JOIN ({SAID}) h ON h.paper_id = g.pmid AND h.variant_id = g.variant LEFT JOIN ({PARTNERS}) p ON p.paper_id = g.pmid AND p.variant_id = g.variant"""


def _evaluated(spark, sf):
    """The curated pairs, every one, against what the engine's own answers say about all papers and variants."""
    found, chunks, variants = _found(spark, sf)
    contexts = rt.stuff_context(rt.top_chunks(found, 5), chunks)
    answers = kept(an.judge(an.built_in_answers(an.ask(fx.pairs(spark, sf), contexts, variants))).where("reason IS NULL").drop("context", "prompt"))
    names = variants.select(c("c_variant").alias("line"), F.concat(F.lit("v"), c("variant_id").cast("string")).alias("name"))
    partners = an.in_trans_lines(answers).join(names, "line").groupBy("paper_id", "variant_id").agg(F.collect_set("name").alias("partners"))
    predicted = an.variant_hit(answers).where("variant_hit").join(partners, ["paper_id", "variant_id"], "left")
    return mf.evaluate(fx.gold(spark, sf), predicted.select(c("paper_id").alias("pmid"), c("variant_id").alias("variant"), "partners"))


@register(EVALUATED)
def j08_evaluate(spark, sf):
    return _evaluated(spark, sf)


@register(f"SELECT label, count(*) AS pairs, count(*) FILTER (WHERE hit) AS hits, count(trans_hit) AS with_partners, count(*) FILTER (WHERE trans_hit) AS partners_found, round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(avg(CAST(trans_hit AS INT)), 6) AS in_trans_recall FROM ({EVALUATED}) GROUP BY label")
def g08_scores(spark, sf):
    return mf.scores(_evaluated(spark, sf))


# Conversion tasks


@register("""
SELECT batch_id, n_files, concat_ws('; ', CASE WHEN n_files > 200 THEN 'too many files' END, CASE WHEN heavy > 0 THEN 'file over size' END, CASE WHEN long > 0 THEN 'file over pages' END) AS violations, n_files <= 200 AS accepted
FROM (SELECT user_id % 75 AS batch_id, count(*) AS n_files, count(*) FILTER (WHERE event_id % 211 > 200) AS heavy, count(*) FILTER (WHERE event_id % 307 > 200) AS long FROM events GROUP BY user_id % 75)""")
def f06_validate_batches(spark, sf):
    files = fx.table(spark, sf, "events").select((c("user_id") % 75).alias("batch_id"), c("event_id").cast("string").alias("path"), (c("event_id") % 211).alias("mb"), (c("event_id") % 307).alias("pages"))
    return tk.validate_batches(files)


@register("""
SELECT batch_id, n_files, concat_ws('; ', CASE WHEN n_files > 200 THEN 'too many files' END, CASE WHEN heavy > 0 THEN 'file over size' END, CASE WHEN long > 0 THEN 'file over pages' END) AS violations, n_files <= 200 AS accepted
FROM (SELECT user_id % 300 AS batch_id, count(*) AS n_files, count(*) FILTER (WHERE event_id % 12 > 10) AS heavy, count(*) FILTER (WHERE event_id % 23 > 20) AS long FROM events GROUP BY user_id % 300)""")
def f06_validate_light_batches(spark, sf):
    files = fx.table(spark, sf, "events").select((c("user_id") % 300).alias("batch_id"), c("event_id").cast("string").alias("path"), (c("event_id") % 12).alias("mb"), (c("event_id") % 23).alias("pages"))
    return tk.validate_batches(files, "light")


BODIES = """SELECT event_id, CASE WHEN event_id % 7 = 4 THEN 429 WHEN event_id % 7 = 6 THEN 500 ELSE 200 END AS http_status,
 CASE event_id % 7 WHEN 0 THEN '{"code": 0, "msg": "ok"}' WHEN 1 THEN '{"code": 401}' WHEN 2 THEN '{"code": "A0202", "msg": "no"}' WHEN 3 THEN '{"code": -60001}' WHEN 4 THEN '{"msg": "slow"}' WHEN 5 THEN '<html>' ELSE '{"msg": "oops"}' END AS body FROM """


@register("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'auth' WHEN 2 THEN 'auth' WHEN 3 THEN 'api_error' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'bad_json' ELSE 'http_error' END AS kind FROM events")
def f12_classify_response(spark, sf):
    e = c("event_id")
    fx.table(spark, sf, "events").createOrReplaceTempView("lectern_events")
    return spark.sql(BODIES + "lectern_events").select(e, tk.classify_response(c("http_status"), c("body")).alias("kind"))


@register("SELECT task_id, ts, state IN ('done', 'failed') AS terminal, state = 'failed' AS failed, state IN ('pending', 'running', 'converting') AS running FROM task_events")
def f13_state_predicates(spark, sf):
    return fx.task_events(spark, sf).select("task_id", c("ts").cast("timestamp_ntz").alias("ts"), tk.is_terminal(c("state")).alias("terminal"), tk.is_failed(c("state")).alias("failed"), tk.is_running(c("state")).alias("running"))


WORDS = "CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'converting' WHEN 3 THEN 'waiting-file' WHEN 4 THEN 'uploading' WHEN 5 THEN 'processing' WHEN 6 THEN 'completed' WHEN 7 THEN 'done' ELSE 'failed' END"
KINDS = "CASE event_id % 4 WHEN 0 THEN 'precise' WHEN 1 THEN 'light' WHEN 2 THEN 'local' ELSE 'unheard-of' END"


@register(f"""
SELECT event_id, CASE vocabulary WHEN 'precise' THEN state IN ('done', 'failed') WHEN 'light' THEN state IN ('done', 'failed') WHEN 'local' THEN state IN ('completed', 'failed') END AS terminal,
  CASE WHEN vocabulary <> 'unheard-of' THEN state = 'failed' END AS failed,
  CASE vocabulary WHEN 'precise' THEN state IN ('pending', 'running', 'converting') WHEN 'light' THEN state IN ('waiting-file', 'uploading', 'pending', 'running') WHEN 'local' THEN state IN ('pending', 'processing') END AS running
FROM (SELECT event_id, {KINDS} AS vocabulary, {WORDS} AS state FROM events)""")
def f13_state_vocabularies(spark, sf):
    return tk.judge_states(fx.table(spark, sf, "events").select("event_id", F.expr(KINDS).alias("vocabulary"), F.expr(WORDS).alias("state"))).select("event_id", "terminal", "failed", "running")


@register("SELECT task_id, batch_id, state, ts FROM latest")
def w03_latest_status(spark, sf):
    return tk.latest_status(fx.task_events(spark, sf)).withColumn("ts", c("ts").cast("timestamp_ntz"))


BATCH_STATES = """
SELECT b.batch_id, CASE WHEN count(task_id) = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE state = 'done') = count(task_id) THEN 'done'
  WHEN count(*) FILTER (WHERE state = 'failed') > 0 AND count(*) FILTER (WHERE state IN ('pending', 'running', 'converting')) = 0 THEN 'failed' ELSE 'running' END AS state,
  count(*) FILTER (WHERE state = 'done') AS done, count(task_id) AS total FROM batches b LEFT JOIN latest l ON l.batch_id = b.batch_id GROUP BY b.batch_id"""


@register(BATCH_STATES)
def g03_g04_batch_states(spark, sf):
    return tk.batch_states(fx.batches(spark, sf), tk.latest_status(fx.task_events(spark, sf)))


@register("SELECT session_id, path, ts FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, path DESC) AS n FROM uploads) WHERE n = 1")
def w04_latest_uploads(spark, sf):
    return tk.latest_uploads(fx.uploads(spark, sf)).withColumn("ts", c("ts").cast("timestamp_ntz"))


@register("SELECT session_id, max(ts) AS last_ts FROM uploads GROUP BY session_id HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR")
def st4_expired_sessions(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return tk.expired_sessions(fx.uploads(spark, sf), now).withColumn("last_ts", c("last_ts").cast("timestamp_ntz"))


@register("""
SELECT event_id, 't' || CAST(event_id AS VARCHAR) AS task_id, CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'running' END AS state, CAST(event_id % 90 AS INT) AS extracted_pages, CASE WHEN event_id % 3 = 0 THEN 'b' || CAST(event_id AS VARCHAR) END AS batch_id FROM events""")
def s10_status_log(spark, sf):
    """Responses built from the events, as a task or as a batch under either result key, and read back."""
    e = c("event_id")
    task = F.struct(F.concat(F.lit("t"), e.cast("string")).alias("task_id"), F.when(e % 2 == 0, "done").otherwise("running").alias("state"), F.struct((e % 90).cast("int").alias("extracted_pages"), F.lit(90).alias("total_pages")).alias("extract_progress"))
    batch = F.concat(F.lit("b"), e.cast("string")).alias("batch_id")
    data = F.when(e % 3 != 0, F.to_json(task)).when(e % 2 == 0, F.to_json(F.struct(batch, F.array(task).alias("extract_result")))).otherwise(F.to_json(F.struct(batch, F.array(task).alias("results"))))
    bodies = fx.table(spark, sf, "events").select(F.concat(F.lit('{"code": 0, "data": '), data, F.lit("}")).alias("body"))
    rows = tk.parse_status_log(bodies)
    return rows.select(F.substring("task_id", 2, 20).cast("long").alias("event_id"), "task_id", "state", "extracted_pages", "batch_id")


# Streams over the events, run to their end


def _stream(spark, sf):
    e = fx.table(spark, sf, "events")
    events = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*")
    return fx.task_events(spark, sf, events)


@register("SELECT task_id, batch_id, state, ts FROM latest")
def st2_w03_tracked_tasks(spark, sf):
    """The stream's last state of each task, as its table holds it at the end."""
    from ..streaming.tasks import current_tasks, track_batches

    out = fx.scratch(spark)
    track_batches(_stream(spark, sf), f"{out}/kept", f"{out}/checkpoint").awaitTermination()
    return current_tasks(spark, f"{out}/kept").withColumn("ts", c("ts").cast("timestamp_ntz"))


FIRST = "SELECT task_id, date_trunc('milliseconds', min(ts)) + INTERVAL 86400 SECOND AS due FROM task_events GROUP BY task_id"
ENDED = f"""SELECT t.task_id, state, ts, row_number() OVER (PARTITION BY t.task_id ORDER BY ts, state) AS n FROM task_events t JOIN ({FIRST}) f ON f.task_id = t.task_id
  WHERE state IN ('done', 'failed') AND date_trunc('milliseconds', ts) <= due"""


@register(f"""
SELECT CAST(f.task_id AS VARCHAR) AS task_id, coalesce(state, 'timeout') AS outcome, CASE WHEN state IS NULL THEN due ELSE ts END AS ts FROM ({FIRST}) f LEFT JOIN ({ENDED}) e ON e.task_id = f.task_id AND n = 1
WHERE state IS NOT NULL OR due <= (SELECT max(ts) - INTERVAL 1 HOUR FROM task_events)""")
def st1_task_outcomes(spark, sf):
    """Each task's outcome by its own state and timer: done, failed or timeout."""
    from ..streaming.tasks import track_tasks

    out = fx.scratch(spark)
    tracked = track_tasks(_stream(spark, sf).select(c("task_id").cast("string").alias("task_id"), "state", "ts"), deadline=86_400)
    tracked.writeStream.outputMode("append").format("parquet").option("path", f"{out}/outcomes").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("task_id string, outcome string, ts timestamp").parquet(f"{out}/outcomes").withColumn("ts", c("ts").cast("timestamp_ntz"))


@register(f"""
SELECT CAST(f.task_id AS VARCHAR) AS task_id, coalesce(state, 'timeout') AS outcome, CASE WHEN state IS NULL THEN due ELSE ts END AS ts FROM ({FIRST}) f LEFT JOIN ({ENDED}) e ON e.task_id = f.task_id AND n = 1
WHERE coalesce(ts, due) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM task_events)""")
def st1_settled_outcomes(spark, sf):
    """The outcomes that no event still to come can change."""
    from ..streaming.tasks import track_tasks

    out = fx.scratch(spark)
    tracked = track_tasks(_stream(spark, sf).select(c("task_id").cast("string").alias("task_id"), "state", "ts"), deadline=86_400, settle=True)
    tracked.writeStream.outputMode("append").format("parquet").option("path", f"{out}/outcomes").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("task_id string, outcome string, ts timestamp").parquet(f"{out}/outcomes").withColumn("ts", c("ts").cast("timestamp_ntz"))


@register(BATCH_STATES)
def st2_tracked_batches(spark, sf):
    """The state of each batch that the stream keeps, at its end."""
    from ..streaming.tasks import current_batches, track_batches

    out = fx.scratch(spark)
    track_batches(_stream(spark, sf), f"{out}/kept", f"{out}/checkpoint", compact=1).awaitTermination()
    return current_batches(spark, f"{out}/kept", fx.batches(spark, sf))


@register("SELECT DISTINCT doc_id AS pmid, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'before' ELSE 'stream' END AS landed FROM documents")
def st3_ingested_papers(spark, sf):
    """Documents as arriving papers, those with a label landed before by another run: each is there once."""
    from ..sources.reference import land_papers
    from ..streaming.papers import ingest_new_papers

    out = fx.scratch(spark)
    docs = fx.table(spark, sf, "documents")
    land_papers(docs.join(fx.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id").select(c("doc_id").alias("pmid"), "text"), f"{out}/landed", "pmid", "before")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parquet*")
    ingest_new_papers(stream.select(c("doc_id").alias("pmid"), "text"), "pmid", f"{out}/landed", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/landed").select("pmid", F.when(c("ingest") == "before", "before").otherwise("stream").alias("landed"))


# Inputs beyond one notation


@register(r"""
SELECT k, CASE WHEN regexp_matches(s, '^rs[0-9]+$') THEN 'rsid' WHEN regexp_matches(s, '^NC_[0-9]+([.][0-9]+)?:g[.]\S+$') THEN 'genomic' WHEN regexp_matches(s, '^NM_[0-9]+([.][0-9]+)?:c[.]\S+$') THEN 'transcript_c'
  WHEN regexp_matches(s, '^NP_[0-9]+([.][0-9]+)?:p[.]\S+$') THEN 'transcript_p' WHEN regexp_matches(s, '^[A-Z][A-Z0-9-]*[: ]c[.]\S+$') THEN 'gene_c' WHEN regexp_matches(s, '^[A-Z][A-Z0-9-]*[: ]p[.]\S+$') THEN 'gene_p' ELSE 'text' END AS notation
FROM (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'rs' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'NC_000001.11:g.' || CAST(o_orderkey AS VARCHAR) || 'A>G' WHEN 2 THEN 'NM_000546.6:c.71G>A' WHEN 3 THEN 'NP_000537.3:p.Leu24Arg' WHEN 4 THEN 'TP53:c.71G>A' WHEN 5 THEN 'TP53 p.Leu24Arg' ELSE 'the usual change' END AS s FROM orders)""")
def p01_classify_notation(spark, sf):
    k = c("o_orderkey")
    s = (
        F.when(k % 7 == 0, F.concat(F.lit("rs"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("NC_000001.11:g."), k.cast("string"), F.lit("A>G"))).when(k % 7 == 2, "NM_000546.6:c.71G>A")
        .when(k % 7 == 3, "NP_000537.3:p.Leu24Arg").when(k % 7 == 4, "TP53:c.71G>A").when(k % 7 == 5, "TP53 p.Leu24Arg").otherwise("the usual change")
    )
    return fx.table(spark, sf, "orders").select(k.alias("k"), hgvs.classify_notation(s).alias("notation"))


@register("SELECT variant_id, CASE WHEN variant_id % 5 = 0 THEN c_variant ELSE 'NM_' || CAST(variant_id AS VARCHAR) || '.1:' || c_variant END AS name, CASE WHEN variant_id % 3 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS build FROM free")
def p02_assemble_hgvs(spark, sf):
    v = c("variant_id")
    name, build = hgvs.assemble_hgvs(F.when(v % 5 == 0, " ").otherwise(F.concat(F.lit("NM_"), v.cast("string"), F.lit(".1"))), hgvs.strip_reference(c("hgvs")), F.when(v % 3 == 0, "GRCh38"))
    return fx.free_variants(spark, sf).select("variant_id", name.alias("name"), build.alias("build"))


@register("""
SELECT k AS variant_id, transcript FROM (SELECT l_orderkey AS k, 'NM_' || CAST(l_suppkey AS VARCHAR) AS transcript, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 13 = 0 DESC, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 10 END ASC NULLS LAST, 'NM_' || CAST(l_suppkey AS VARCHAR)) AS n FROM lineitem) WHERE n = 1""")
def p03_pick_transcript(spark, sf):
    name = lambda k: F.concat(F.lit("NM_"), k.cast("string"))
    candidates = fx.table(spark, sf, "lineitem").select(c("l_orderkey").alias("variant_id"), name(c("l_suppkey")).alias("transcript"), (c("l_suppkey") % 13 == 0).alias("chosen"))
    preferences = fx.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(name(c("s_suppkey")).alias("transcript"), (c("s_suppkey") % 10).alias("pref_rank"))
    return an.ranked_transcript(candidates, preferences)


@register("""
SELECT k, concat_ws('; ', CASE WHEN a = 'yes' AND b = 'no' THEN 'affected non-carrier' END, CASE WHEN a = 'no' AND b = 'yes' THEN 'unaffected carrier' END) AS warnings, coalesce(a, 'not_reported_in_source') AS affected, coalesce(b, 'not_reported_in_source') AS carrier
FROM (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS a, CASE c_custkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'yes' END AS b FROM customer)""")
def p04_family_warnings(spark, sf):
    k = c("c_custkey")
    members = fx.table(spark, sf, "customer").select(k.alias("k"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").alias("affected"), F.when(k % 4 == 0, "no").when(k % 4 < 3, "yes").alias("carrier"))
    return an.family_warnings(members)
