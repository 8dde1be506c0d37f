"""Papers packed many to a file, in parts, and tables laid out without a shuffle."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lectern.operators import tables as tb
from lectern.plans import files as fl
from lectern.sources import papers as ps

TABLE = "<table><tbody><tr><td>{0}</td></tr><tr><td>{0}b</td></tr></tbody></table>"
PASSAGE = '<passage><infon key="type">{1}</infon><infon key="id">T</infon><infon key="xml">&lt;table&gt;{0}&lt;/table&gt;</infon><text>{0}</text></passage>'


def packed(spark, path, bodies):
    ps.pack_files(spark.createDataFrame(bodies, "paper_id long, part int, body string"), str(path))
    return ps.read_packed(spark, str(path))


def test_places_count_on_through_the_parts_of_a_paper(spark, tmp_path):
    article = lambda *names: "<article>" + "".join(TABLE.format(n) for n in names) + "<table>none</table></article>"
    files = packed(spark, tmp_path / "a", [(1, 1, article("c")), (1, 0, article("a", "b")), (2, 0, article("d")), (1, 2, article("e"))])
    placed = lambda df: {(r["paper_id"], r["table_seq"], r["markup"][22:23]) for r in df.collect()}
    assert placed(ps.article_tables(files, "all")) == {(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (1, 5, "e"), (2, 0, "d")}
    assert placed(ps.article_tables(files)) == {(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "e"), (2, 0, "d")}
    assert {(p, s) for p, s, _ in placed(ps.markdown_tables(files))} == {(1, s) for s in range(7)} | {(2, 0), (2, 1)}


def test_documents_of_a_collection_in_parts(spark, tmp_path):
    doc = lambda *passages: "<document><id>1</id>" + "".join(PASSAGE.format(*p) for p in passages) + "</document>"
    first, second = doc(("a", "table"), ("x", "text")) + doc(("b", "table")), doc(("c", "table"))
    files = packed(spark, tmp_path / "b", [(7, 1, f"<collection>{second}</collection>"), (7, 0, f"<collection>{first}</collection>")])
    passages = ps.bioc_passages(files)
    assert {(r["doc_seq"], r["seq"], r["text"]) for r in passages.collect()} == {(0, 0, "a"), (0, 1, "x"), (1, 0, "b"), (2, 0, "c")}
    rows = lambda df: {tuple(r) for r in df.select("paper_id", "table_seq", "name", "markup").collect()}
    assert rows(ps.bioc_file_tables(files)) == rows(ps.bioc_tables(passages)) == {(7, i, "T", f"<table>{n}</table>") for i, n in enumerate("abc")}


def test_papers_do_not_get_a_folder_each(spark, tmp_path):
    """A folder for each paper is work for the driver that grows with them."""
    fl.packed(spark, spark.range(300).selectExpr("id AS paper_id", "'<a/>' AS body")).count()
    names = fl.packed(spark, spark.range(300).selectExpr("id AS paper_id", "'<a/>' AS body"))
    assert names.count() == 300
    assert len({Path(p) for p in names.inputFiles()}) < 20


def test_layout_of_nested_cells_equals_that_of_single_ones(spark):
    rng = random.Random(3)
    span = lambda: rng.choice(["", "", " rowspan=2", " colspan='3'", " rowspan=0", ' colspan="0"'])
    row = lambda: "<tr>" + "".join(f"<td{span()}>{rng.randrange(99)}</td>" for _ in range(rng.randrange(4))) + "</tr>"
    markup = ["<table>" + rng.choice(["", f"<thead>{row()}{row()}</thead>"]) + "".join(row() for _ in range(rng.randrange(6))) + "</table>" for _ in range(200)]
    markup += ["<table><tr><td colspan=1000000000>a</td></tr></table>", "<table></table>"]
    raw = spark.createDataFrame(list(enumerate(markup)), "paper_id int, markup string").selectExpr("paper_id", "0 AS table_seq", "markup")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(tb.table_grid(raw)) == rows(tb.expand_spans(tb.table_cells(raw)))
    assert rows(tb.too_large(tb.placed(tb.table_parts(raw)))) == rows(tb.oversized(tb.table_cells(raw))) != []
    plan = tb.table_grid(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert tb.table_grid(raw).where(F.col("paper_id") >= 200).count() == 0


def test_promoting_within_a_row_equals_promoting_the_grid(spark):
    rng = random.Random(5)
    cell = lambda: rng.choice(["<td>{0}</td>", "<TD>{0}</TD>", "<td>a<i>{0}</i></td>", "<td>{0}&amp;</td>", "<td></td>", "<td rowspan=2>{0}</td>", "<td colspan='0'>{0}</td>", "<td>{0}", "<td>{0}<td>b</td>"] if rng.random() < 0.1 else ["<td>{0}</td>"]).format(rng.randrange(99))
    row = lambda n: "<tr>" + "".join(cell() for _ in range(n)) + "</tr>"
    heads = ["", "", "<thead></thead>", "<thead><tr></tr></thead>", "<thead><tr><td colspan=0>none</td></tr></thead>", "<thead><tr><td colspan=1000000000>far</td></tr></thead>"]
    markup = [f"<table>{rng.choice([*heads, f'<thead>{row(3)}</thead>'])}<tbody>{''.join(row(rng.choice([3, 3, 3, 2])) for _ in range(rng.randrange(4)))}</tbody></table>" for _ in range(300)]
    raw = spark.createDataFrame(list(enumerate(markup)), "paper_id int, markup string").selectExpr("paper_id", "0 AS table_seq", "markup")
    rows = lambda df: sorted(map(str, df.select("paper_id", "part", "r", "c", "text").collect()))
    assert rows(tb.promoted_grid(raw)) == rows(tb.promote_first_row(tb.expand_spans(tb.table_cells(raw)))) != []
    assert "Exchange" not in tb.promoted_grid(raw)._jdf.queryExecution().executedPlan().toString()


def test_plain_tables_need_no_python(spark):
    """Of tables without spans nothing goes to Python, and no limit is passed by them."""
    markup = "<table><tr><td>1</td><td>2 > 1</td></tr><tr><td></td><td>4</td></tr></table>"
    raw = spark.createDataFrame([(1, 0, markup)], "paper_id int, table_seq int, markup string")
    assert tb.table_parts(raw).where("part = 'body'").first()["cells"] == ([["1", "2 > 1"], ["", "4"]], None)
    assert [tuple(r)[3:] for r in tb.table_grid(raw).orderBy("r", "c").collect()] == [(0, 0, "1"), (0, 1, "2 > 1"), (1, 0, ""), (1, 1, "4")]
    assert [tuple(r)[2:] for r in tb.too_large(tb.placed(tb.table_parts(raw), 3)).collect()] == [("body", 2, 2)]


def test_packs_are_read_in_small_row_groups(spark, tmp_path):
    """Spark holds up to 4096 rows of a row group at once: those of large papers hold few."""
    import pyarrow.parquet as pq

    rows = spark.range(400).selectExpr("id AS paper_id", "concat_ws(' ', transform(sequence(1, 4000), i -> substr(md5(concat(id, i)), 1, 8))) AS body").repartition(1)
    ps.pack_files(rows, str(tmp_path / "p"))
    meta = [pq.ParquetFile(p).metadata for p in (tmp_path / "p").glob("*.parquet")]
    assert max(m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)) < 8 << 20


def test_papers_are_parsed_once(spark, tmp_path):
    """Parsing stands in one place of the plan that reads tables, and in none of the one that numbers them."""
    doc = "<collection><document><id>1</id>" + PASSAGE.format("a", "table") + "</document></collection>"
    ps.pack_files(spark.createDataFrame([(1, doc)], "paper_id long, body string"), str(tmp_path / "a"))
    plan = ps.bioc_file_tables(ps.read_packed(spark, str(tmp_path / "a")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert "from_xml" not in ps.bioc_file_tables(packed(spark, tmp_path / "b", [(1, 0, doc)]))._jdf.queryExecution().optimizedPlan().toString()
