"""A paper corpus and its companions, derived from the given tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hgvs import RESIDUES
from ..operators import retrieve
from ..shared import shared_folder

#: Variants 0 to VARIANTS - 1 are asked about.
VARIANTS = 20
NBSP = " "
SECTION = ("ABSTRACT", "INTRO", "METHODS", "RESULTS", "Table", "REF", "SUPPL", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(v: str, letters: str) -> str:
    return f"substring('{letters}', 1 + CAST({v} % 4 AS INT), 1)"


def number(v: str, start: int, step: int) -> str:
    return f"CAST({start} + {step} * {v} AS STRING)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, seq, section_type, text): the lines of each document, with mentions of variants."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    vi = "((3 * paper_id + seq) % 20)"
    pos, ppos = number(vi, 71, 37), number(vi, 24, 12)
    ref, alt = base(vi, "ACGT"), base(vi, "GTAC")
    mention = f"""CASE CAST(floor(paper_id / 5) AS BIGINT) % 5
        WHEN 0 THEN concat('c.', {pos}, {ref}, '>', {alt}, ' was found')
        WHEN 1 THEN concat('c.', {pos}, '{NBSP}', {ref}, ' > ', {alt}, ' in trans')
        WHEN 2 THEN concat('p.Leu', {ppos}, 'Arg change')
        WHEN 3 THEN concat('codon ', {ppos}, ' is hot')
        ELSE concat('allele L', {ppos}, 'R here') END"""
    section = F.when(F.col("seq") == 0, "TITLE").otherwise(F.element_at(F.array(*(F.lit(s) for s in SECTION)), ((7 * F.col("paper_id") + F.col("seq")) % 8 + 1).cast("int")))
    text = F.when((F.col("paper_id") + F.col("seq")) % 5 == 0, F.concat(F.col("line"), F.lit(" "), F.expr(mention))).otherwise(F.col("line"))
    return lines.select("paper_id", "seq", section.alias("section_type"), text.alias("text"))


def variants(spark: SparkSession) -> DataFrame:
    """(variant_id, hgvs) of the variants asked about."""
    v = spark.range(VARIANTS).select(F.col("id").cast("int").alias("variant_id"))
    return v.select("variant_id", F.expr(f"concat('NM_00', lpad(CAST(variant_id AS STRING), 4, '0'), '.1:c.', {number('variant_id', 71, 37)}, {base('variant_id', 'ACGT')}, '>', {base('variant_id', 'GTAC')})").alias("hgvs"))


def proteins(spark: SparkSession) -> DataFrame:
    """(hgvs, description): the name service's table; silent, missing and frameshift changes among them."""
    v = variants(spark)
    pos = number("variant_id", 24, 12)
    return v.where("variant_id % 10 <> 8").select(
        "hgvs", F.expr(f"CASE variant_id % 10 WHEN 7 THEN 'NP_000001.1:p.(=)' WHEN 9 THEN concat('NP_000001.1:p.(Leu', {pos}, 'Argfs*5)') ELSE concat('NP_000001.1:p.(Leu', {pos}, 'Arg)') END").alias("description")
    )


def prepared(spark: SparkSession) -> DataFrame:
    return retrieve.prepare_variants(variants(spark), proteins(spark))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.flatten_papers(retrieve.prose(passages(spark, sf_dir)))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunk(papers(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, variant_id): every paper is asked about every variant."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"))
    return docs.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant_id"))


#: A line's columns, by which an order's lines are ordered.
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def line_cells() -> tuple[Column, ...]:
    """The texts of a line's cells in its order's table."""
    return F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linestatus"))


def grid(spark: SparkSession, sf_dir: str, papers: DataFrame | None = None) -> DataFrame:
    """The grid of a table for each order: its lines as body rows, two stacked header rows, holes in the last column of odd tables.

    Given papers (paper_id), only of those: what is not asked for is then not sorted either.
    """
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(*LINE)
    if papers is not None:
        lines = lines.join(papers.select(F.col("paper_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = lines.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)) - 1)
    # explode() of places and texts: Spark drops a branch that a filter on part leaves empty, but not below posexplode()
    placed = F.array(*(F.struct(F.lit(i).alias("c"), text.alias("text")) for i, text in enumerate(line_cells())))
    cells = rows.select(F.col("l_orderkey").alias("paper_id"), F.lit(0).alias("table_seq"), F.lit("body").alias("part"), "r", F.explode(placed).alias("x")).select("paper_id", "table_seq", "part", "r", "x.c", "x.text")
    heads = (("Part", "Part", "Flag", "Status"), ("Part", "Quantity", "Flag", None))
    stacked = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(i).alias("c"), F.lit(text).cast("string").alias("text")) for r, row in enumerate(heads) for i, text in enumerate(row)))
    tables = rows.select(F.col("l_orderkey").alias("paper_id")).distinct()
    head = tables.select("paper_id", F.lit(0).alias("table_seq"), F.lit("head").alias("part"), F.explode(stacked).alias("x")).select("paper_id", "table_seq", "part", "x.r", "x.c", "x.text")
    return head.unionByName(cells)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, alias): for each order, the numbers of its customer and of the next part."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("paper_id"), F.explode(F.array_distinct(F.array((F.col("o_custkey") % 100).cast("string"), (F.col("o_orderkey") % 50).cast("string")))).alias("alias"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, variant_id, alias_idx, qtype, answer, error): the assistant's turns as answers."""
    c = table(spark, sf_dir, "conversations")
    return c.where("role = 'assistant'").select(
        F.col("conv_id").alias("paper_id"), (F.col("turn") % 20).cast("int").alias("variant_id"), F.expr("CAST(turn AS INT) % 2").alias("alias_idx"), F.expr("CAST(conv_id % 2 AS INT)").alias("qtype"),
        F.expr("CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 13 = 0 THEN '' ELSE text END").alias("answer"),
        F.expr("CASE WHEN conv_id % 17 = 0 THEN 'request timed out' WHEN conv_id % 19 = 0 THEN 'ValueError: no answer' END").alias("error"),
    )


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, pos, line): documents' lines, every other one again between asterisks."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    again = rows.where("seq % 2 = 0").select("paper_id", (F.col("seq") * 2 + 1).alias("pos"), F.concat(F.lit("*"), F.translate("line", "abcdefgh", "ABCDEFGH"), F.lit("*")).alias("line"))
    return rows.select("paper_id", (F.col("seq") * 2).alias("pos"), "line").unionByName(again)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def task_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(task_id, batch_id, state, ts): events as the states of conversion tasks."""
    state = "CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'converting' END"
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(F.col("user_id").alias("task_id"), (F.col("user_id") % 75).alias("batch_id"), F.expr(state).alias("state"), F.col("ts").cast("timestamp").alias("ts"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id): the batches of the events, and five that no task is in."""
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 75).alias("batch_id")).distinct()
    return own.unionByName(spark.range(75, 80).select(F.col("id").alias("batch_id")))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.concat(F.lit("paper_"), F.col("event_id").cast("string"), F.lit(".xml")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, variant, criterion, patients, label, in_trans): curated pairs for one variant in seventeen of each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"))
    some = F.filter(F.sequence(F.lit(0), F.lit(VARIANTS - 1)), lambda v: (F.col("pmid") + v) % 17 == 0)
    rows = docs.select("pmid", F.explode(some).alias("variant"))
    name = lambda v: F.concat(F.lit("v"), v.cast("string"))
    v = F.col("variant")
    return rows.select(
        "pmid", "variant", F.concat(F.lit("PM"), (F.col("pmid") % 4).cast("string")).alias("criterion"),
        F.when(F.col("pmid") % 9 == 0, "several").otherwise((F.col("pmid") % 7).cast("string")).alias("patients"),
        F.element_at(F.array(F.lit("eval"), F.lit("others"), F.lit("fine-tune")), (F.col("pmid") % 3 + 1).cast("int")).alias("label"),
        F.when(F.col("pmid") % 4 == 0, "NA").otherwise(F.concat_ws(" ", name((v + 1) % 20), name((v + 2) % 20))).alias("in_trans"),
    )


def free_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, hgvs, description): names in many notations, one for each part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"))
    n, m = "CAST(variant_id AS STRING)", "CAST(variant_id % 90 + 10 AS STRING)"
    ref, alt = base("variant_id", "ACGT"), base("variant_id", "GTAC")
    change = f"""CASE variant_id % 9 WHEN 0 THEN concat('c.', {n}, {ref}, '>', {alt}) WHEN 1 THEN concat('c.(', {n}, {ref}, '>', {alt}, ')')
        WHEN 2 THEN concat('c.', {n}, '-', {m}, {ref}, '>', {alt}) WHEN 3 THEN concat('c.', {n}, '+1', {ref}, '>', {alt}) WHEN 4 THEN concat('c.', {n}, '_', {m}, 'dup')
        WHEN 5 THEN concat('c.', {m}, 'del', {ref}) WHEN 6 THEN concat('c.*', {m}, {ref}, '>', {alt}) WHEN 7 THEN 'c.=' ELSE concat('c.', {m}, '_', {n}, 'del') END"""
    body = f"""CASE variant_id % 8 WHEN 0 THEN concat('Leu', {n}, 'Arg') WHEN 1 THEN concat('Cys', {n}, 'Glnfs*29') WHEN 2 THEN concat('Cys', {n}, 'Ter') WHEN 3 THEN '='
        WHEN 4 THEN concat('Trp', {n}, '*') WHEN 5 THEN concat('Met', {m}, 'Val') WHEN 6 THEN concat('Gly', {m}, 'Aspfs') ELSE concat('His', {n}, 'Tyr') END"""
    described = f"CASE WHEN variant_id % 10 = 8 THEN NULL WHEN variant_id % 10 = 9 THEN 'NP_1.1:p.?' ELSE concat('NP_1.1:p.(', {body}, ')') END"
    return p.select("variant_id", F.expr(f"concat('NM_', {n}, '.1:', {change})").alias("hgvs"), F.expr(described).alias("description"))


def tidy(column: Column) -> Column:
    """An array as one string, for results that compare as scalars."""
    return F.coalesce(F.array_join(column, "|"), F.lit(""))


def _sql(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


# Named pieces of the oracle's SQL; each may use those before it.
_VI = "((3 * paper_id + seq) % 20)"
_FORMS = {v: (number(v, 71, 37), number(v, 24, 12), base(v, "ACGT"), base(v, "GTAC")) for v in (_VI, "v")}
_P, _Q, _R, _A = _FORMS[_VI]
_PV, _QV, _RV, _AV = _FORMS["v"]
_SPACE = r"[\s\x{00A0}]*"
_CORE = "regexp_replace(regexp_replace(regexp_replace(hgvs, '^.*:', ''), 'c\\.', '', 'g'), '[()]', '', 'g')"


def pattern_sql(core: str, space: str = r"\\s*") -> str:
    """The DNA pattern; space is how optional white space is spelled in the replacement."""
    escaped = rf"regexp_replace({core}, '([^A-Za-z0-9_>])', '\\\1', 'g')"
    return rf"regexp_replace(regexp_replace({escaped}, '([0-9]+)', '{space}\1{space}', 'g'), '>', '{space}>{space}', 'g')"


def short_sql(expr: str) -> str:
    for long3, short1 in RESIDUES:
        expr = f"replace({expr}, '{long3}', '{short1}')"
    return expr


_BODY = r"nullif(regexp_extract(regexp_replace(description, '^.*:', ''), '^p.\((.*)\)', 1), '')"
_TRIM = f"regexp_replace({_BODY}, '[A-Za-z]{{3}}fs.*', '')"
_STATUS = f"CASE WHEN description IS NULL THEN 'missing' WHEN {_BODY} IS NULL THEN 'no protein change' WHEN length({_BODY}) < 5 THEN 'too short' ELSE 'ok' END"
_LONG = f"CASE WHEN {_STATUS} = 'ok' THEN translate({_TRIM}, 'X*', '') END"
_SHORT = f"CASE WHEN {_STATUS} = 'ok' THEN translate({short_sql(_TRIM)}, 'X*', '') END"

CTE: dict[str, str] = {
    "passages": _sql(f"""
SELECT paper_id, seq, CASE WHEN seq = 0 THEN 'TITLE' ELSE (['ABSTRACT', 'INTRO', 'METHODS', 'RESULTS', 'Table', 'REF', 'SUPPL', NULL])[1 + CAST((7 * paper_id + seq) % 8 AS INT)] END AS section_type,
  CASE WHEN (paper_id + seq) % 5 = 0 THEN line || ' ' || CASE CAST(floor(paper_id / 5) AS BIGINT) % 5
    WHEN 0 THEN concat('c.', {_P}, {_R}, '>', {_A}, ' was found') WHEN 1 THEN concat('c.', {_P}, chr(160), {_R}, ' > ', {_A}, ' in trans')
    WHEN 2 THEN concat('p.Leu', {_Q}, 'Arg change') WHEN 3 THEN concat('codon ', {_Q}, ' is hot') ELSE concat('allele L', {_Q}, 'R here') END ELSE line END AS text
FROM (SELECT doc_id AS paper_id, unnest(range(0, len(l))) AS seq, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""),
    "papers": "SELECT paper_id, string_agg(text, chr(10) ORDER BY seq) AS body FROM passages WHERE upper(coalesce(section_type, '')) NOT IN ('TABLE', 'REF', 'COMP_INT', 'AUTH_CONT', 'SUPPL') GROUP BY paper_id",
    "chunks": """
SELECT paper_id, CAST(i AS INT) AS chunk_seq, substr(body, CAST(i * 1400 + 1 AS BIGINT), 1500) AS text FROM (SELECT paper_id, body, unnest(range(0, greatest(CAST(ceil((length(body) - 100) / 1400.0) AS BIGINT), 1))) AS i FROM papers)""",
    "vars": _sql(f"""
SELECT CAST(v AS INT) AS variant_id, concat('NM_00', lpad(CAST(v AS STRING), 4, '0'), '.1:c.', {_PV}, {_RV}, '>', {_AV}) AS hgvs,
  CASE WHEN v % 10 = 8 THEN NULL WHEN v % 10 = 7 THEN 'NP_000001.1:p.(=)' WHEN v % 10 = 9 THEN concat('NP_000001.1:p.(Leu', {_QV}, 'Argfs*5)') ELSE concat('NP_000001.1:p.(Leu', {_QV}, 'Arg)') END AS description
FROM (SELECT unnest(range(0, {VARIANTS})) AS v)"""),
    "variants": f"SELECT *, {_CORE} AS var_dna, regexp_replace(hgvs, '^.*:', '') AS c_variant, {pattern_sql(_CORE)} AS dna_pattern, {pattern_sql(_CORE, '[chars]*').replace('[chars]', '[' + chr(92) + chr(92) + 's' + chr(92) + chr(92) + 'x{00A0}]')} AS re, {_STATUS} AS protein_status, {_LONG} AS plong, {_SHORT} AS pshort FROM vars",
    "hits": """
SELECT paper_id, chunk_seq, variant_id, regexp_matches(text, '(?i)' || re) AS by_dna, coalesce(contains(text, plong) AND plong <> '', false) AS by_long, coalesce(contains(text, pshort) AND pshort <> '', false) AS by_short
FROM chunks, variants WHERE regexp_matches(text, '(?i)' || re) OR coalesce(contains(text, plong) AND plong <> '', false) OR coalesce(contains(text, pshort) AND pshort <> '', false)""",
    "spots": """
SELECT DISTINCT paper_id, chunk_seq, variant_id FROM chunks, variants
WHERE (regexp_matches(text, '[^0-9]' || regexp_extract(var_dna, '[0-9]+') || '[^0-9]') OR coalesce(regexp_matches(text, '[^0-9]' || nullif(regexp_extract(plong, '[0-9]+'), '') || '[^0-9]'), false))
  AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.paper_id = chunks.paper_id AND h.variant_id = variants.variant_id)""",
    "retrieved": "SELECT *, 'form' AS match_kind FROM hits UNION ALL SELECT *, false, false, false, 'position' FROM spots",
    "pairs": f"SELECT paper_id, v AS variant_id FROM (SELECT doc_id AS paper_id, CAST(unnest(range(0, {VARIANTS})) AS INT) AS v FROM documents)",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, variant_id ORDER BY chunk_seq) AS rank FROM retrieved) WHERE rank <= 5",
    "counters": """
SELECT p.paper_id, p.variant_id, count(*) FILTER (WHERE by_dna) AS dna_chunks, count(*) FILTER (WHERE by_long) AS long_chunks, count(*) FILTER (WHERE by_short) AS short_chunks,
  count(*) FILTER (WHERE by_dna) > 0 AS dna_matched, count(*) FILTER (WHERE by_long) > 0 AS long_matched, count(*) FILTER (WHERE by_short) > 0 AS short_matched,
  count(*) FILTER (WHERE match_kind = 'form') = 0 AS fallback_triggered, count(*) FILTER (WHERE match_kind = 'position') > 0 AS fallback_matched, count(*) FILTER (WHERE match_kind = 'position') AS fallback_chunks, count(match_kind) AS total_chunks
FROM pairs p LEFT JOIN retrieved r ON r.paper_id = p.paper_id AND r.variant_id = p.variant_id GROUP BY p.paper_id, p.variant_id""",
    "context": "SELECT t.paper_id, t.variant_id, string_agg(c.text, chr(10) || chr(10) ORDER BY c.chunk_seq) AS context FROM top t JOIN chunks c ON c.paper_id = t.paper_id AND c.chunk_seq = t.chunk_seq GROUP BY t.paper_id, t.variant_id",
    "lines0": "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS r FROM lineitem",
    "grid": """
SELECT l_orderkey AS paper_id, 0 AS table_seq, 'body' AS part, CAST(r AS INT) AS r, CAST(unnest([0, 1, 2, 3]) AS INT) AS c,
  unnest([CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR), l_returnflag, CASE WHEN l_orderkey % 2 = 0 THEN l_linestatus END]) AS text FROM lines0
UNION ALL SELECT k, 0, 'head', r, c, t FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem), (VALUES (0, 0, 'Part'), (0, 1, 'Part'), (0, 2, 'Flag'), (0, 3, 'Status'), (1, 0, 'Part'), (1, 1, 'Quantity'), (1, 2, 'Flag'), (1, 3, NULL)) h(r, c, t)""",
    "headers": """
SELECT paper_id, table_seq, c, string_agg(t, ' ' ORDER BY r) AS header FROM (
  SELECT paper_id, table_seq, c, coalesce(text, '') AS t, min(r) AS r FROM grid WHERE part = 'head' GROUP BY ALL) GROUP BY paper_id, table_seq, c""",
    "aliases": "SELECT DISTINCT o_orderkey AS paper_id, unnest([CAST(o_custkey % 100 AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR)]) AS alias FROM orders",
    "cell_hits": "SELECT g.paper_id, table_seq, r, c, alias FROM grid g JOIN aliases a ON a.paper_id = g.paper_id WHERE part = 'body' AND contains(text, alias)",
    "answers": """
SELECT conv_id AS paper_id, CAST(turn % 20 AS INT) AS variant_id, CAST(turn AS INT) % 2 AS alias_idx, CAST(conv_id % 2 AS INT) AS qtype,
  CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 13 = 0 THEN '' ELSE text END AS answer,
  CASE WHEN conv_id % 17 = 0 THEN 'request timed out' WHEN conv_id % 19 = 0 THEN 'ValueError: no answer' END AS error FROM conversations WHERE role = 'assistant'""",
    "judged": "SELECT *, CASE WHEN contains(lower(error), 'timed out') OR contains(lower(error), 'timeout') THEN 'timeout' WHEN error IS NOT NULL THEN 'error' WHEN answer IS NULL THEN 'missing' WHEN answer = '' THEN 'empty' END AS reason FROM answers",
    "good": "SELECT * FROM judged WHERE reason IS NULL",
    "doc_lines": "SELECT doc_id AS paper_id, unnest(range(0, len(l))) AS seq, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "answer_lines": "SELECT paper_id, seq * 2 AS pos, line FROM doc_lines UNION ALL SELECT paper_id, seq * 2 + 1, '*' || translate(line, 'abcdefgh', 'ABCDEFGH') || '*' FROM doc_lines WHERE seq % 2 = 0",
    "task_events": "SELECT user_id AS task_id, user_id % 75 AS batch_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'converting' END AS state, ts FROM events",
    "latest": "SELECT task_id, batch_id, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, state DESC) AS n FROM task_events) WHERE n = 1",
    "batches": "SELECT DISTINCT user_id % 75 AS batch_id FROM events UNION ALL SELECT unnest(range(75, 80))",
    "uploads": "SELECT user_id AS session_id, 'paper_' || CAST(event_id AS VARCHAR) || '.xml' AS path, ts FROM events",
    "gold": f"""
SELECT pmid, variant, 'PM' || CAST(pmid % 4 AS VARCHAR) AS criterion, CASE WHEN pmid % 9 = 0 THEN 'several' ELSE CAST(pmid % 7 AS VARCHAR) END AS patients, (['eval', 'others', 'fine-tune'])[1 + pmid % 3] AS label,
  CASE WHEN pmid % 4 = 0 THEN 'NA' ELSE concat('v', (variant + 1) % 20, ' v', (variant + 2) % 20) END AS in_trans
FROM (SELECT doc_id AS pmid, CAST(unnest(range(0, {VARIANTS})) AS INT) AS variant FROM documents) WHERE (pmid + variant) % 17 = 0""",
    "free": "",
}


def _free_sql() -> str:
    n, m = "CAST(variant_id AS VARCHAR)", "CAST(variant_id % 90 + 10 AS VARCHAR)"
    ref, alt = base("variant_id", "ACGT"), base("variant_id", "GTAC")
    change = f"""CASE variant_id % 9 WHEN 0 THEN concat('c.', {n}, {ref}, '>', {alt}) WHEN 1 THEN concat('c.(', {n}, {ref}, '>', {alt}, ')')
        WHEN 2 THEN concat('c.', {n}, '-', {m}, {ref}, '>', {alt}) WHEN 3 THEN concat('c.', {n}, '+1', {ref}, '>', {alt}) WHEN 4 THEN concat('c.', {n}, '_', {m}, 'dup')
        WHEN 5 THEN concat('c.', {m}, 'del', {ref}) WHEN 6 THEN concat('c.*', {m}, {ref}, '>', {alt}) WHEN 7 THEN 'c.=' ELSE concat('c.', {m}, '_', {n}, 'del') END"""
    body = f"""CASE variant_id % 8 WHEN 0 THEN concat('Leu', {n}, 'Arg') WHEN 1 THEN concat('Cys', {n}, 'Glnfs*29') WHEN 2 THEN concat('Cys', {n}, 'Ter') WHEN 3 THEN '='
        WHEN 4 THEN concat('Trp', {n}, '*') WHEN 5 THEN concat('Met', {m}, 'Val') WHEN 6 THEN concat('Gly', {m}, 'Aspfs') ELSE concat('His', {n}, 'Tyr') END"""
    described = f"CASE WHEN variant_id % 10 = 8 THEN NULL WHEN variant_id % 10 = 9 THEN 'NP_1.1:p.?' ELSE concat('NP_1.1:p.(', {body}, ')') END"
    raw = f"SELECT variant_id, concat('NM_', {n}, '.1:', {change}) AS hgvs, {described} AS description FROM (SELECT p_partkey AS variant_id FROM part)"
    return f"SELECT *, {_CORE} AS var_dna, regexp_replace(hgvs, '^.*:', '') AS c_variant, {pattern_sql(_CORE)} AS dna_pattern, {_STATUS} AS protein_status, {_BODY} AS body, {_LONG} AS plong, {_SHORT} AS pshort FROM ({raw})"


CTE["free"] = _free_sql()
_MANY = "SELECT variant_id, '{}' AS way, {} AS form, {} AS re FROM free WHERE {} <> ''"
_RE = pattern_sql("var_dna", "[chars]*").replace("[chars]", "[" + chr(92) * 2 + "s" + chr(92) * 2 + "x{00A0}]")
CTE["many_forms"] = " UNION ALL ".join(_MANY.format(way, form, re_, form) for way, form, re_ in (("dna", "var_dna", _RE), ("long", "plong", "''"), ("short", "pshort", "''")))
# each distinct form is tried in every chunk by its signs, and where they are there by its pattern
CTE["many_tried"] = """
SELECT paper_id, chunk_seq, text, way, form, re FROM (SELECT *, lower(regexp_replace(text, '[\\s\\x{00A0}]+', '', 'g')) AS sq FROM chunks), (SELECT DISTINCT way, form, re FROM many_forms)
WHERE CASE WHEN way = 'dna' THEN contains(sq, lower(form)) ELSE contains(text, form) END"""
CTE["many_hits"] = "SELECT paper_id, chunk_seq, way, form FROM many_tried WHERE CASE WHEN way = 'dna' THEN regexp_matches(text, '(?i)' || re) ELSE true END"


def recursive_sql(text: str, width: int = 1500, overlap: int = 100) -> str:
    """The recursive chunks of a text as a list, by list functions and one list_reduce."""
    end, step = "struct_pack(kind := 'end', part := '')", width - min(overlap, width - 1)

    def broken(t: str, breaks: tuple[str, ...], depth: int = 0) -> str:
        cut = f"list_transform(range(0, greatest(CAST(ceil((length({t}) - {width}) / {step}.0) AS BIGINT), 0) + 1), lambda w{depth}: struct_pack(kind := 'chunk', part := substr({t}, CAST(w{depth} * {step} + 1 AS BIGINT), {width})))"
        for at in reversed(range(len(breaks))):
            sign, d = breaks[at], f"{depth}{at}"
            pieces = f"list_filter(list_transform(string_split({t}, {sign}), lambda p{d}, i{d}: CASE WHEN i{d} > 1 THEN {sign} || p{d} ELSE p{d} END), lambda q{d}: q{d} <> '')"
            apart = f"CASE WHEN length(r{d}) >= {width} THEN list_concat(list_concat([{end}], {broken(f'r{d}', breaks[at + 1 :], depth + 1)}), [{end}]) ELSE [struct_pack(kind := 'piece', part := r{d})] END"
            cut = f"CASE WHEN contains({t}, {sign}) THEN flatten(list_transform({pieces}, lambda r{d}: {apart})) ELSE {cut} END"
        return cut

    def state(kind: str, part: str, pack: str, size: str, chunks: str) -> str:
        return f"struct_pack(kind := {kind}, part := {part}, pack := CAST({pack} AS VARCHAR[]), size := CAST({size} AS BIGINT), chunks := CAST({chunks} AS VARCHAR[]))"

    def grown(chunk: str) -> str:
        stripped = f"regexp_replace({chunk}, '^\\s+|\\s+$', '', 'g')"
        return f"CASE WHEN {stripped} <> '' THEN list_append(a.chunks, {stripped}) ELSE a.chunks END"

    size = lambda some: f"coalesce(list_sum(list_transform({some}, lambda y: length(y))), 0)"
    most = f"least({overlap}, {width} - length(x.part))"
    n = f"len(list_filter(range(1, len(a.pack) + 1), lambda k: {size('a.pack[len(a.pack) - k + 1 : len(a.pack)]')} <= {most}))"
    tail = f"list_slice(a.pack, len(a.pack) - {n} + 1, len(a.pack))"
    closed = grown("array_to_string(a.pack, '')")
    items = f"list_concat({broken(text, ('chr(10) || chr(10)', 'chr(10)', 'chr(32)'))}, [{end}])"
    elements = f"list_concat([{state(repr(''), repr(''), '[]', '0', '[]')}], list_transform({items}, lambda z: {state('z.kind', 'z.part', '[]', '0', '[]')}))"
    step_sql = (
        f"CASE WHEN x.kind = 'end' THEN {state('x.kind', 'x.part', '[]', '0', closed)} WHEN x.kind = 'chunk' THEN {state('x.kind', 'x.part', '[]', '0', grown('x.part'))}"
        f" WHEN len(a.pack) > 0 AND a.size + length(x.part) > {width} THEN {state('x.kind', 'x.part', f'list_append({tail}, x.part)', f'{size(tail)} + length(x.part)', closed)}"
        f" ELSE {state('x.kind', 'x.part', 'list_append(a.pack, x.part)', 'a.size + length(x.part)', 'a.chunks')} END"
    )
    return f"(list_reduce({elements}, lambda a, x: {step_sql})).chunks"


def with_(final: str) -> str:
    """final with the named pieces it uses, and those they use."""
    needed: list[str] = []
    names = list(CTE)

    def need(text: str, below: int) -> None:
        for name in names[:below]:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(CTE[name], names.index(name))
                needed.append(name)

    need(final, len(names))
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n].strip()})" for n in needed) + "\n" if needed else "") + final
