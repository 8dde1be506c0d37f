import random

from pyspark.sql import functions as F

from lectern.operators import tables as tb
from lectern.sources import papers, reference

HTML = """<table><thead><tr><td rowspan="2">Patient</td><td colspan="2">Variant</td></tr><tr><td>DNA</td><td>Protein</td></tr></thead>
<tbody><tr><td>1</td><td>c.71G&gt;A</td><td><i>p.Leu24Arg</i></td></tr><tr><td rowspan=9>2</td><td colspan=0>both</td></tr><tr><td>x</td></tr></tbody></table>"""
BIOC = """<?xml version="1.0"?><!DOCTYPE collection SYSTEM "BioC.dtd"><collection><document><id>7</id>
<passage><infon key="section_type">TITLE</infon><text>A title\x01</text></passage><passage><infon key="section_type">ref</infon><text>A reference</text></passage>
<passage><infon key="type">table</infon><infon key="id">T1</infon><infon key="xml">&lt;table&gt;&lt;tr&gt;&lt;td&gt;a&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;</infon><text>cells</text></passage></document>
<document><id>8</id><passage><text>no section</text></passage></document></collection>"""
ARTICLE = "<article><abstract>Short</abstract><section><content>One</content><content>Two</content></section><table><thead><tr><td>H</td></tr></thead><tbody><tr><th>n</th><td>v</td></tr></tbody></table></article>"


def spread(rows):
    """The grid of rows of (rowspan, colspan, text), cell by cell."""
    return [[text for a, b, text in row for _ in range(a, b)] for row in tb.laid_out(rows, tb.grid_size(rows)[1])]


def cell_by_cell(rows):
    """The same by a table of taken cells."""
    width, grid = 0, {}
    for i, row in enumerate(rows):
        reach = sum(1 for j in range(i) for s, _, _ in rows[j] if (j + s if s else len(rows)) > i)
        width = max(width, sum(s for _, s, _ in row) + reach)
    for i, row in enumerate(rows):
        c = 0
        for down, across, text in row:
            while (i, c) in grid:
                c += 1
            last = c + across if across else max(c, width)
            grid |= {(y, x): text for y in range(i, min(i + down, len(rows)) if down else len(rows)) for x in range(c, min(last, width))}
            c = last
    return [[grid.get((y, x)) for x in range(width)] for y in range(len(rows))]


def test_spans():
    assert spread([[(1, 1, "a"), (2, 1, "b")], [(1, 1, "c")]]) == [["a", "b"], ["c", "b"]]
    assert spread([[(0, 1, "a"), (1, 2, "b")], [(1, 1, "c")]]) == [["a", "b", "b"], ["a", "c", None]]
    assert spread([[(9, 1, "a")], [], []]) == [["a"], ["a"], ["a"]]
    assert spread([]) == []
    rng = random.Random(2)
    for _ in range(2000):
        rows = [[(rng.choice([1, 1, 1, 2, 3, 0]), rng.choice([1, 1, 1, 2, 4, 0]), f"{i}.{k}") for k in range(rng.randrange(4))] for i in range(rng.randrange(1, 6))]
        assert spread(rows) == cell_by_cell(rows), rows


def test_spans_beyond_the_limit_are_rejected(spark):
    """A huge colspan costs nothing and is told; a huge rowspan ends with the table."""
    markup = ["<table><tr><td colspan='1000000000'>a</td></tr><tr><td>b</td></tr></table>", "<table><tr><td colspan=99999999999999999999>a</td></tr></table>", "<table><tr><td rowspan=1000000000>a</td><td>b</td></tr><tr><td>c</td></tr></table>"]
    cells = tb.table_cells(spark.createDataFrame(list(enumerate(markup)), "paper_id int, markup string").selectExpr("paper_id", "0 AS table_seq", "markup"))
    assert {(r["paper_id"], r["n_rows"], r["width"]) for r in tb.oversized(cells).collect()} == {(0, 2, 10**9), (1, 1, 10**9)}
    grid = {(r["paper_id"], r["r"], r["c"], r["text"]) for r in tb.expand_spans(cells).collect()}
    assert grid == {(2, 0, 0, "a"), (2, 0, 1, "b"), (2, 1, 0, "a"), (2, 1, 1, "c")}


def test_markup_to_grid_and_csv(spark):
    raw = spark.createDataFrame([("p", 0, HTML), ("q", 0, "<table><tr><th>h</th></tr><tr><td>a,b\"c</td></tr></table>")], "paper_id string, table_seq int, markup string")
    grid = tb.promote_first_row(tb.expand_spans(tb.table_cells(raw)))
    csv = {r["paper_id"]: r["csv"] for r in tb.table_to_csv(grid).collect()}
    assert csv["p"] == "Patient,Variant DNA,Variant Protein\n1,c.71G>A,p.Leu24Arg\n2,both,both\n2,x,"
    assert csv["q"] == 'h\n"a,b""c"'
    wide = tb.wide_view(grid, "p", 0, "one_table")
    assert wide.columns == ["r", "Patient", "Variant DNA", "Variant Protein"]
    assert spark.sql("SELECT Patient FROM one_table WHERE `Variant DNA` = 'both'").first()[0] == "2"


def test_hits(spark):
    grid = spark.createDataFrame([(1, 0, "body", 0, 0, "71"), (1, 0, "body", 0, 1, "x"), (1, 0, "body", 1, 1, "171")], "paper_id long, table_seq int, part string, r int, c int, text string")
    hits = tb.alias_hits(grid, spark.createDataFrame([(1, "71")], "paper_id long, alias string"))
    assert tuple(tb.variant_column(hits).first()) == (1, 0, 0, 1)
    assert tb.summarise_hits(grid, hits).first()["hit_rows"] == 2


def test_papers(spark, tmp_path):
    for name, body in (("ok.xml", BIOC), ("art.xml", ARTICLE), ("bad.xml", "<collection><document>")):
        (tmp_path / name).write_text(body)
    files = papers.read_files(spark, str(tmp_path))
    passages = papers.bioc_passages(files).orderBy("doc_seq", "seq").collect()
    assert [(r["doc_seq"], r["seq"], r["section_type"], r["text"]) for r in passages] == [(0, 0, "TITLE", "A title"), (0, 1, "ref", "A reference"), (0, 2, None, "cells"), (1, 0, None, "no section")]
    table = papers.bioc_tables(papers.bioc_passages(files)).first()
    assert (table["name"], table["markup"]) == ("T1", "<table><tr><td>a</td></tr></table>")
    assert [r["text"] for r in papers.article_passages(files).orderBy("seq").collect()] == ["Short", "One", "Two"]
    assert [r["paper_id"] for r in papers.rejected(files).collect()] == ["bad"]
    grid = tb.expand_spans(tb.table_cells(papers.article_tables(files)))
    assert {(r["part"], r["text"]) for r in grid.collect()} == {("head", "H"), ("body", "v")}
    assert papers.read_passages(spark, str(tmp_path)).count() == 7


def test_markdown_and_csv(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/paper.md").write_text(f"# Title\n\n{HTML}\n\ntext\n\n<table><tr><td>z</td></tr></table>\n")
    found = papers.markdown_tables(papers.read_files(spark, str(tmp_path / "m")))
    assert [(r["paper_id"], r["table_seq"]) for r in found.orderBy("table_seq").collect()] == [("paper", 0), ("paper", 1)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/t.csv").write_text('a,"b, c"\nd,e\n1,2,3\n')
    cells, bad = papers.read_csv_tables(spark, str(tmp_path / "c"), 2)
    assert {(r["r"], r["c"], r["text"]) for r in cells.collect()} >= {(0, 0, "a"), (0, 1, "b, c"), (1, 1, "e")}
    assert bad.count() == 1


def test_reference_files_and_sinks(spark, tmp_path):
    (tmp_path / "res.txt").write_text("Ala\tA\nArg\tR\n")
    assert [tuple(r) for r in reference.read_residues(spark, str(tmp_path / "res.txt")).collect()] == [(0, "Ala", "A"), (1, "Arg", "R")]
    (tmp_path / "b.json").write_text('[{"PMID": "1", "Variant Name": "v", "labels": "eval", "In trans Variants": "NA"}, {"Variant Name": "w"}]')
    rows = reference.read_benchmark(spark, str(tmp_path / "b.json")).collect()
    assert [(r["pmid"], r["variant"], r["label"]) for r in rows] == [("1", "v", "eval"), (None, "w", None)]
    log = spark.createDataFrame([("1", True), ("2", False)], "pmid string, ok boolean")
    reference.write_failed_ids(log, str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed"), schema="pmid string").first()[0] == "2"
    body = spark.createDataFrame([("1", "x"), ("2", "y")], "pmid string, body string")
    for _ in range(2):
        reference.write_papers(body, str(tmp_path / "papers"))
    assert spark.read.parquet(str(tmp_path / "papers")).count() == 2


def test_status_log(spark, tmp_path):
    (tmp_path / "log").write_text(
        '{"code": 0, "data": {"task_id": "a", "state": "done", "extract_progress": {"extracted_pages": 3, "total_pages": 4}}}\n{"code": "A0202", "msg": "no"}\n{"code": 0, "data": {"batch_id": "b", "extract_result": [{"data_id": "x", "state": "failed"}]}}\n'
    )
    got = {(r["batch_id"], r["task_id"], r["data_id"], r["state"], r["extracted_pages"]) for r in reference.read_status_log(spark, str(tmp_path / "log")).collect()}
    assert got == {(None, "a", None, "done", 3), ("b", None, "x", "failed", None)}


def test_is_table(spark):
    assert [r[0] for r in spark.createDataFrame([("table",), ("x",), (None,)], "t string").select(papers.is_table(F.col("t"))).collect()] == [True, False, False]


def test_tables_of_articles(spark, tmp_path):
    """Without a head the first row is one; a single row is no table, nor is a head alone; texts are stripped."""
    tables = (
        "<table><tbody><tr><td> H </td><td>I</td></tr><tr><td>1</td><td>\n2 </td></tr></tbody></table>"
        "<table><tbody><tr><td>lone</td></tr></tbody></table><table><thead><tr><td>only</td></tr></thead></table>"
        "<table><thead><tr><td>A</td></tr></thead><tbody><tr><td> b c </td></tr></tbody></table>"
    )
    (tmp_path / "a.xml").write_text(f"<article><tables>{tables}</tables></article>")
    raw = papers.article_tables(papers.read_files(spark, str(tmp_path)))
    csv = tb.table_to_csv(tb.promote_first_row(tb.expand_spans(tb.table_cells(raw)))).orderBy("table_seq").collect()
    assert [(r["table_seq"], r["csv"]) for r in csv] == [(0, "H,I\n1,2"), (1, "A\nb c")]


def test_many_documents_number_their_tables(spark):
    passages = spark.createDataFrame([("p", 3000 * k, 1, {"type": "table", "xml": f"<table>{k}</table>"}, "table") for k in range(3)], "paper_id string, doc_seq int, seq int, infons map<string,string>, type string")
    assert [(r["table_seq"], r["markup"]) for r in papers.bioc_tables(passages).orderBy("table_seq").collect()] == [(k, f"<table>{k}</table>") for k in range(3)]


def test_article_text_in_order(spark, tmp_path):
    """Whole texts of the outermost elements, nested ones once, equal ones each time; comments and CDATA are text or none."""
    body = """<?xml version="1.0"?><!-- <content>no</content> --><article><abstract> A &lt;1&gt; </abstract><section><content>same</content></section>
    <main_content><section><p>HBB c.20A&gt;T</p> <content>inner <text>deep</text></content></section></main_content><content/><content a="x > y">same</content>
    <text><![CDATA[<content> & raw]]></text><abstract>  </abstract><title>none</title><context>none</context></article>"""
    (tmp_path / "a.xml").write_text(body)
    got = papers.article_passages(papers.read_files(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["A <1>", "same", "HBB c.20A>T inner deep", "same", "<content> & raw"]


def test_odd_infons_do_not_stop_a_job(spark, tmp_path):
    passage = '<passage><infon key="type">x</infon><infon key="type">table</infon><infon>v</infon><infon key="xml">&lt;table/&gt;</infon><text>t</text></passage>'
    (tmp_path / "a.xml").write_text(f"<collection><document><id>1</id>{passage}<passage><text>bare</text></passage></document></collection>")
    files = papers.read_files(spark, str(tmp_path))
    last, first, every = (papers.bioc_passages(files, r).orderBy("seq").first() for r in papers.REPEATED)
    assert (last["infons"], last["type"]) == ({"type": "table", "xml": "<table/>"}, "table")
    assert (first["infons"]["type"], first["type"]) == ("x", "x")
    assert (every["infons"]["type"], every["type"]) == (["x", "table"], "table")
    assert papers.bioc_passages(files).count() == 2 and papers.bioc_tables(papers.bioc_passages(files)).count() == 1
    assert {(r["seq"], r["reason"], r["key"], r["n"]) for r in papers.rejected_infons(files).collect()} == {(0, "no key", None, 1), (0, "repeated key", "type", 2)}


def test_csv_files_of_their_own_width(spark, tmp_path):
    bodies = {
        "two": 'a,"b ""q"", c"\r\n\r\nd,\n"",x', "one": "lone", "three": "1,2,3\n4\n5,6,7,8\n9,,\n", "open": 'a,"b\nc,d', "stray": 'pipe of 5",a 6" b\nb,c', "empty": "",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_bytes(body.encode())
    cells, bad = papers.read_csv_tables(spark, str(tmp_path))
    grid = {}
    for r in cells.orderBy("paper_id", "r", "c").collect():
        grid.setdefault(r["paper_id"], {}).setdefault(r["r"], []).append(r["text"])
    assert {k: list(v.values()) for k, v in grid.items()} == {"two": [["a", 'b "q", c'], ["d", None], ["", "x"]], "one": [["lone"]], "three": [["1", "2", "3"], ["4", None, None], ["9", None, None]]}
    assert {(r["paper_id"], r["reason"]) for r in bad.collect()} == {("three", "fields"), ("open", "open quote"), ("stray", "quote within a field")}
    assert {r["paper_id"] for r in papers.read_csv_tables(spark, str(tmp_path), whole_files=True)[0].collect()} == {"two", "one"}


def test_csv_files_are_read_in_splits(spark, tmp_path):
    """Files cut anywhere give the records that they give whole, also where a split begins within quotes."""
    rng = random.Random(4)
    field = lambda: rng.choice(["", "x", '""', '"a, b"', '"l\n\n1"', '"q""\r\n""q"', "y" * 30, '"' + "z\n" * 40 + '"'])
    for name in range(6):
        records = [",".join(field() for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(300)]
        (tmp_path / f"{name}.csv").write_bytes(rng.choice(["\n", "\r\n", "\n\n"]).join(["1,2,3", *records]).encode() + (b',"open' if name == 5 else b'\na,b"c"\n' if name == 4 else b""))

    def read(**how):
        cells, bad = papers.read_csv_tables(spark, str(tmp_path), **how)
        return sorted(map(str, cells.collect())), sorted(map(str, bad.collect()))

    whole = [read(), read(columns=3), read(whole_files=True)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    most = papers.RECORDS
    try:
        papers.RECORDS = 7
        assert len({(r["path"], r["block"]) for r in papers.csv_lines(spark, str(tmp_path)).select("path", "block").distinct().collect()}) > 60
        assert [read(), read(columns=3), read(whole_files=True)] == whole
    finally:
        papers.RECORDS = most
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # the same by Python's own reader
    import csv

    for name in range(4):
        with open(tmp_path / f"{name}.csv", newline="") as f:
            fitting = [r for r in csv.reader(f) if r and len(r) <= 3 and "".join(r).strip() + "," * (len(r) - 1)]
        own = [r for r in papers.read_csv_tables(spark, str(tmp_path))[0].where(f"paper_id = {name}").orderBy("r", "c").collect()]
        assert [(r["r"], r["c"], r["text"] or "") for r in own] == [(i, k, (row + [""] * 3)[k]) for i, row in enumerate(fitting) for k in range(3)]


def test_sql_over_tables_of_any_headers(spark):
    """Tables with other headers, repeated ones and none answer one question together."""
    markup = ["<table><thead><tr><td>Gene</td><td>n</td></tr></thead><tr><td>HBB</td><td>3</td></tr><tr><td>TP53</td></tr></table>", "<table><thead><tr><td>n</td><td>n</td><td></td></tr></thead><tr><td>1</td><td>2</td><td>z</td></tr></table>"]
    raw = spark.createDataFrame(list(enumerate(markup)), "paper_id int, markup string").selectExpr("paper_id", "0 AS table_seq", "markup")
    tb.variant_rows_of(tb.expand_spans(tb.table_cells(raw))).createOrReplaceTempView("any_tables")
    got = spark.sql("SELECT paper_id, r, try_variant_get(row, '$.Gene', 'string') AS gene, try_variant_get(row, '$.n', 'int') AS n, try_variant_get(row, '$.n_1', 'int') AS n1, try_variant_get(row, '$.column_2', 'string') AS z FROM any_tables")
    assert sorted(map(tuple, got.collect()), key=repr) == [(0, 0, "HBB", 3, None, None), (0, 1, "TP53", None, None, None), (1, 0, None, 1, 2, "z")]
