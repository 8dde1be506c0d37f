"""Paper tables: from markup to a grid of cells in long form, and what is asked of it.

A grid is rows (paper_id, table_seq, part, r, c, text): part is head or body, r
and c count from 0. Duplicate headers are legal, so a grid becomes wide only where
it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

TABLE = ["paper_id", "table_seq"]
LONGEST_SPAN = 1_000_000_000
#: A table part of more cells than this is rejected, not laid out.
MOST_CELLS = 10_000_000

# The entities of cell text, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


#: Rows and cells, each cut at its end tag.
ROW = r"(?is)(<tr\b.*?</tr>)"
CELL_MARKUP = r"(?is)(<t[dh]\b.*?</t[dh]>)"
#: What makes markup more than plain: an entity, a tag with attributes or of another kind, a cell that holds a tag. A plain cell is its text.
NOT_PLAIN = r"(?i)&|<(?!/?(?:table|tbody|tr|td|th)>)|<t[dh]>[^<]*+<(?!/t[dh]>)"
PLAIN_CELL = r"(?i)<t[dh]>([^<]*+)</t[dh]>"


def markup_text(s: Column) -> Column:
    """Cell markup without tags and with entities resolved."""
    bare = F.regexp_replace(s, "(?s)<[^>]*>", "")
    return F.when(F.contains(s, F.lit("&")), reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare)).otherwise(bare)


def span(cell: Column, name: str) -> Column:
    """A cell's rowspan or colspan; 1 if it has none that is a number, LONGEST_SPAN for longer ones."""
    digits = F.regexp_extract(cell, rf"(?is)^<t[dh][^>]*\b{name}\s*=\s*[\"']?0*(\d+)", 1)
    told = tx.bound(digits, lambda d: F.when(F.length(d) > 9, LONGEST_SPAN).otherwise(F.coalesce(d.try_cast("int"), F.lit(1))))
    return F.when(F.contains(F.lower(cell), F.lit(name)), told).otherwise(1)


def head_and_body(raw_tables: DataFrame) -> DataFrame:
    """(paper_id, table_seq, head, body) of raw_tables (paper_id, table_seq, markup): the markup of their parts, empty where there is none."""
    clean = raw_tables.select(*TABLE, tx.scrub_escapes(F.col("markup")).alias("m"))
    known = clean.select(*TABLE, "m", F.regexp_extract("m", r"(?is)<thead[^>]*>(.*?)</thead>", 1).alias("head"))
    return known.select(*TABLE, "head", F.when(F.col("head") == "", F.col("m")).otherwise(F.regexp_replace("m", r"(?is)<thead[^>]*>.*?</thead>", "")).alias("body"))


def one_by_one(tables: DataFrame, value: str) -> DataFrame:
    """tables (paper_id, table_seq, head, body, ...) as rows (paper_id, table_seq, ..., part, value).

    The outer generator, here and below: before a plain one Spark puts a filter on the
    array's size, which works out anew whatever the array is made by.
    """
    p = F.array(*(F.struct(F.lit(part).alias("part"), F.col(part).alias(value)) for part in ("head", "body")))
    rest = [c for c in tables.columns if c not in ("head", "body")]
    return tables.select(*rest, F.explode_outer(p).alias("p")).select(*rest, "p.*")


def table_cells(raw_tables: DataFrame) -> DataFrame:
    """(paper_id, table_seq, part, tr, cell_seq, rowspan, colspan, text) of raw_tables (paper_id, table_seq, markup).

    Rows are cut at their end tags and cells at theirs, so tables within cells are
    not told apart. Without a head, all rows are body.
    """
    rows = one_by_one(head_and_body(raw_tables), "m").select(*TABLE, "part", F.posexplode(F.regexp_extract_all("m", F.lit(ROW), 1)).alias("tr", "row"))
    cells = rows.select(*TABLE, "part", "tr", F.posexplode(F.regexp_extract_all("row", F.lit(CELL_MARKUP), 1)).alias("cell_seq", "cell"))
    return cells.select(*TABLE, "part", "tr", "cell_seq", span(F.col("cell"), "rowspan").alias("rowspan"), span(F.col("cell"), "colspan").alias("colspan"), markup_text(F.col("cell")).alias("text"))


def grid_size(rows: list[list[tuple[int, int, str | None]]]) -> tuple[int, int]:
    """Rows and columns of the grid of rows of (rowspan, colspan, text): as wide as a row's colspans and the cells that reach into it from above, each as one."""
    n = len(rows)
    more = [0] * (n + 1)  # cells that begin to reach into a row, less those that end before it
    for i, row in enumerate(rows):
        for rowspan, _, _ in row:
            if i + 1 < n and rowspan != 1:
                more[i + 1] += 1
                more[min(i + rowspan, n) if rowspan else n] -= 1
    return n, max((sum(cell[1] for cell in row) + reaching for row, reaching in zip(rows, accumulate(more), strict=False)), default=0)


def painted(width: int, layers: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str | None]]:
    """A row as runs (start, end, text) that fill its width; layers lie over those before them, and where there is none the text is None."""
    runs: list[tuple[int, int, str | None]] = []
    ends = sorted({0, width, *(e for a, b, _ in layers for e in (a, b))})
    for a, b in zip(ends, ends[1:], strict=False):
        runs.append((a, b, next((text for x, y, text in reversed(layers) if x <= a and b <= y), None)))
    return runs


def laid_out(rows: list[list[tuple[int, int, str | None]]], width: int) -> list[list[tuple[int, int, str | None]]]:
    """The grid as runs of each row.

    A cell takes the first free column and fills its rectangle; columns that a
    cell above still holds are skipped. Span 0 reaches to the last row or column.
    What falls outside the grid is dropped, holes have no text.
    """
    grid, above = [], []  # above: (first row below it, start, end, text) of cells that hold columns
    for i, row in enumerate(rows):
        above = [cell for cell in above if cell[0] > i]
        c, own = 0, []
        for rowspan, colspan, text in row:
            while (held := next((end for _, start, end, _ in above if start <= c < end), None)) is not None:
                c = held
            across = colspan or max(width - c, 0)
            if c < min(c + across, width):
                own.append((i + rowspan if rowspan else len(rows), c, min(c + across, width), text))
            c += across
        layers = [(a, b, text) for _, a, b, text in above + own]
        # without cells from above a row's own stand side by side from the first column on
        grid.append(painted(width, layers) if above else [*layers, *([(c, width, None)] if c < width else [])])
        above += own
    return grid


#: What a cell is laid out by, and its text.
CELL = "struct<tr:int,rowspan:int,colspan:int,text:string>"
RUNS = "struct<n_rows:long,width:long,runs:array<struct<r:int,first:int,end:int,cell:int>>>"
#: So many layouts of at most so many cells are kept by a worker: tables of a corpus repeat them.
KNOWN_LAYOUTS, KNOWN_CELLS = 10_000, 500


def with_cells(tables: DataFrame, *names: str) -> DataFrame:
    """tables with each column of markup named replaced by a struct (texts, cells): the texts of its rows' cells where it is plain and all rows are of one length, else an array of CELL in their order."""
    rest = [c for c in tables.columns if c not in names]
    rows = lambda n: F.regexp_extract_all(n, F.lit(ROW), 1)
    cell = lambda tr: lambda x: F.struct(tr.alias("tr"), span(x, "rowspan").alias("rowspan"), span(x, "colspan").alias("colspan"), markup_text(x).alias("text"))
    every = lambda n: F.flatten(F.transform(rows(n), lambda row, tr: F.transform(F.regexp_extract_all(row, F.lit(CELL_MARKUP), 1), cell(tr))))
    plain = lambda n: F.when(~F.rlike(n, F.lit(NOT_PLAIN)), F.transform(rows(n), lambda row: F.regexp_extract_all(row, F.lit(PLAIN_CELL), 1)))
    width = lambda texts: F.size(F.get(texts, F.lit(0)))
    even = lambda texts: F.when((width(texts) > 0) & F.forall(texts, lambda row: F.size(row) == width(texts)), texts)
    # step by step, so that each is worked out once
    told = tables.select("*", *(plain(F.col(n)).alias(f"__plain_{n}") for n in names))
    told = told.select(*tables.columns, *(even(F.col(f"__plain_{n}")).alias(f"__texts_{n}") for n in names))
    return told.select(*rest, *(F.struct(F.col(f"__texts_{n}").alias("texts"), F.when(F.col(f"__texts_{n}").isNull(), every(F.col(n))).alias("cells")).alias(n) for n in names))


def table_parts(raw_tables: DataFrame) -> DataFrame:
    """(paper_id, table_seq, part, cells) of raw_tables (paper_id, table_seq, markup): table_cells() within a row, as with_cells() gives them.

    A table is one row here, so nothing is shuffled to bring its cells together.
    """
    return with_cells(one_by_one(head_and_body(raw_tables), "cells"), "cells")


def cell_lists(cells: DataFrame) -> DataFrame:
    """The same of cells that come apart, as table_cells() gives them."""
    found = F.array_sort(F.collect_list(F.struct("tr", "cell_seq", "rowspan", "colspan", "text")))
    return cells.groupBy(*TABLE, "part").agg(found.alias("cells")).select(*TABLE, "part", F.struct(F.lit(None).cast("array<array<string>>").alias("texts"), F.transform("cells", lambda x: F.struct(x["tr"], x["rowspan"], x["colspan"], x["text"])).cast(f"array<{CELL}>").alias("cells")).alias("cells"))


def layout(spans: np.ndarray, most: int) -> tuple[int, int, np.ndarray | None]:
    """Rows, width and runs (r, first, end, cell; -1 for none) of the cells (tr, rowspan, colspan) of a table part; no runs where it has more than `most` cells."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(int(spans[:, 0].max()) + 1)]
    for at, (tr, rowspan, colspan) in enumerate(spans.tolist()):
        rows[tr].append((rowspan, colspan, at))
    n, width = grid_size(rows)
    if n * width > most:
        return n, width, None
    runs = [(r, a, b, -1 if at is None else at) for r, row in enumerate(laid_out(rows, width)) for a, b, at in row]
    return n, width, np.array(runs, np.int32).reshape(-1, 4)


def with_layout(rows: DataFrame, *names: str, most: int = MOST_CELLS) -> DataFrame:
    """rows with each column named, as with_cells() gives it, replaced by a struct (n_rows, width, runs), null where there are no cells.

    runs are arrays of (r, first, end, text) that fill each row, null for more than
    `most` cells. Plain texts stand where they are; of other cells only the spans go to
    Python, where equal layouts are worked out once, and texts stay in the JVM.
    """
    known: dict[bytes, tuple[int, int, np.ndarray | None]] = {}

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            flat = cells.flatten()
            spans = np.stack([flat.field(i).to_numpy() for i in range(3)], axis=1) if len(flat) else np.zeros((0, 3), np.int32)
            counts = pc.fill_null(pc.list_value_length(cells), 0).to_numpy()
            ends = np.cumsum(counts)
            found: list[tuple[int, int, np.ndarray | None] | None] = [None] * len(cells)
            for i in np.flatnonzero(counts).tolist():
                own = spans[ends[i] - counts[i] : ends[i]]
                if counts[i] > KNOWN_CELLS:
                    found[i] = layout(own, most)
                    continue
                name = own.tobytes()
                if name not in known and len(known) < KNOWN_LAYOUTS:
                    known[name] = layout(own, most)
                found[i] = known[name] if name in known else layout(own, most)
            laid = [(None, None, None) if x is None else x for x in found]
            runs = [x[2] for x in laid if x[2] is not None]
            every = np.concatenate(runs) if runs else np.zeros((0, 4), np.int32)
            offsets = np.cumsum([0, *(0 if x[2] is None else len(x[2]) for x in laid)])
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, i])) for i in range(4)], ["r", "first", "end", "cell"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, mask=pa.array([x[2] is None for x in laid], pa.bool_()))
            none = pa.array([x is None for x in found], pa.bool_())
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in laid], pa.int64()), pa.array([x[1] for x in laid], pa.int64()), lists], ["n_rows", "width", "runs"], mask=none)

    # the module's annotations are text, and Spark asks for types
    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # told nondeterministic, the function stays a step of its own: within the generator that follows Spark can't run it
    place_spans = F.arrow_udf(place, RUNS).asNondeterministic()
    rest = [c for c in rows.columns if c not in names]
    spans = lambda n: F.transform(f"{n}.cells", lambda x: F.struct(x["tr"].alias("tr"), x["rowspan"].alias("rowspan"), x["colspan"].alias("colspan")))
    laid = rows.select("*", *(place_spans(spans(n)).alias(f"__laid_{n}") for n in names))
    run = lambda r, first, end, text: F.struct(r.alias("r"), first.alias("first"), end.alias("end"), text.alias("text"))

    def whole(n: str) -> Column:
        texts, cells, found = F.col(f"{n}.texts"), F.col(f"{n}.cells"), F.col(f"__laid_{n}")
        height, width = F.size(texts).cast("long"), F.size(F.get(texts, F.lit(0))).cast("long")
        plain = F.flatten(F.transform(texts, lambda row, r: F.transform(row, lambda text, i: run(r, i, i + 1, text))))
        spanned = F.transform(found["runs"], lambda x: run(x["r"], x["first"], x["end"], F.when(x["cell"] >= 0, F.get(cells, x["cell"])["text"])))
        struct = lambda n_rows, width, runs: F.struct(n_rows.alias("n_rows"), width.alias("width"), runs.alias("runs"))
        return F.when(texts.isNotNull(), struct(height, width, F.when(height * width <= most, plain))).when(found.isNotNull(), struct(found["n_rows"], found["width"], spanned)).alias(n)

    return laid.select(*rest, *(whole(n) for n in names))


def placed(parts: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """parts (as table_parts() gives them) that have cells, with n_rows, width and runs: arrays of (r, first, end, text) that fill each row, null for parts of more than `most` cells."""
    return with_layout(parts, "cells", most=most).where("cells IS NOT NULL").select(*TABLE, "part", "cells.n_rows", "cells.width", "cells.runs")


def filled(laid: DataFrame) -> DataFrame:
    """The grid (paper_id, table_seq, part, r, c, text) of placed() parts, a null text where no cell reaches."""
    runs = laid.select(*TABLE, "part", F.explode_outer("runs").alias("x")).where("x IS NOT NULL").select(*TABLE, "part", "x.*")
    return runs.select(*TABLE, "part", "r", F.explode_outer(F.sequence("first", F.col("end") - 1)).alias("c"), "text")


def table_grid(raw_tables: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The grid of each table part of raw_tables (paper_id, table_seq, markup): expand_spans(table_cells()) without a shuffle."""
    return filled(placed(table_parts(raw_tables), most))


def promoted_grid(raw_tables: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """promote_first_row(table_grid()): a table's row tells whether it has a head, so no cell is shuffled to meet it."""
    laid = with_layout(with_cells(head_and_body(raw_tables), "head", "body"), "head", "body", most=most).select(*TABLE, F.col("head.runs").alias("head"), F.col("body.runs").alias("body"))
    bare = F.coalesce(F.size("head") <= 0, F.lit(True))
    first = lambda x: F.when(x["r"] == 0, "head").otherwise("body")
    up = lambda x: F.struct(F.greatest(x["r"] - 1, F.lit(0)).alias("r"), x["first"].alias("first"), x["end"].alias("end"), x["text"].alias("text"))
    own = laid.select(*TABLE, F.when(~bare, F.col("head")).otherwise(F.filter("body", lambda x: first(x) == "head")).alias("head"), F.when(~bare, F.col("body")).otherwise(F.transform(F.filter("body", lambda x: first(x) == "body"), up)).alias("body"))
    return filled(one_by_one(own, "runs"))


def expand_spans(cells: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The grid of each table part: rows (paper_id, table_seq, part, r, c, text), a null text where no cell reaches.

    Spans are placed one after the other within a table part, many parts in a
    batch and side by side, as runs of a row; what they fill is made in the JVM. Parts
    of more than `most` cells are left out: see oversized().
    """
    return filled(placed(cell_lists(cells), most))


def oversized(cells: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """(paper_id, table_seq, part, n_rows, width) of the table parts that expand_spans() leaves out."""
    return too_large(placed(cell_lists(cells), most))


def too_large(laid: DataFrame) -> DataFrame:
    """(paper_id, table_seq, part, n_rows, width) of the placed() parts that have no grid."""
    return laid.where("runs IS NULL").select(*TABLE, "part", "n_rows", "width")


def grid_width(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*TABLE, "part").agg((F.max("c") + 1).cast("long").alias("width"))


def promote_first_row(grid: DataFrame) -> DataFrame:
    """Tables without a head take their first body row as one."""
    headed = grid.where("part = 'head'").select(*TABLE).distinct().withColumn("headed", F.lit(True))
    known = grid.join(headed, TABLE, "left")
    bare = F.col("headed").isNull()
    return known.select(*TABLE, F.when(bare & (F.col("r") == 0), "head").otherwise(F.col("part")).alias("part"), F.when(bare & (F.col("r") > 0), F.col("r") - 1).otherwise(F.col("r")).alias("r"), "c", "text")


def in_row_order(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("r"), value.alias("t")))), lambda x: x["t"])


def merge_headers(grid: DataFrame, distinct: bool = True) -> DataFrame:
    """(paper_id, table_seq, c, header): the stacked header cells of a column by a space, each distinct one once where it first stands.

    distinct=False repeats them, and cuts all rows to the shortest.
    """
    head = grid.where("part = 'head'")
    if not distinct:
        rows = head.groupBy(*TABLE, "r").agg((F.max("c") + 1).alias("w")).groupBy(*TABLE).agg(F.min("w").alias("w"))
        head = head.join(rows, TABLE).where("c < w")
    values = in_row_order(F.coalesce("text", F.lit("")))
    return head.groupBy(*TABLE, "c").agg(F.array_join(F.array_distinct(values) if distinct else values, " ").alias("header"))


def normalise_cells(grid: DataFrame) -> DataFrame:
    """Holes become empty texts, and body cells lose spelled-out line ends."""
    value = F.coalesce("text", F.lit(""))
    return grid.withColumn("text", F.when(F.col("part") == "body", tx.scrub_newlines(value)).otherwise(value))


def quoted(value: Column) -> Column:
    """A CSV field, quoted where it must be."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def table_to_csv(grid: DataFrame, distinct_headers: bool = True) -> DataFrame:
    """(paper_id, table_seq, csv): a header line and the body rows; cells are dealt out once, by table, for all that follows."""
    clean = normalise_cells(grid).repartition(*TABLE)
    head = merge_headers(clean, distinct_headers).select(*TABLE, F.lit(-1).alias("r"), "c", F.col("header").alias("text"))
    cells = head.unionByName(clean.where("part = 'body'").select(*TABLE, "r", "c", "text"))
    lines = cells.groupBy(*TABLE, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: quoted(x["text"])), ",").alias("line"))
    return lines.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("csv"))


def alias_hits(grid: DataFrame, aliases: DataFrame) -> DataFrame:
    """(paper_id, table_seq, r, c, alias) for each body cell that holds an alias (paper_id, alias)."""
    return grid.where("part = 'body'").join(aliases, "paper_id").where(F.contains("text", F.col("alias"))).select(*TABLE, "r", "c", "alias")


def variant_rows(hits: DataFrame) -> DataFrame:
    return hits.select(*TABLE, "r").distinct()


def variant_column(hits: DataFrame) -> DataFrame:
    """(paper_id, table_seq, c, hits): the column with most hits, the first of equals."""
    counted = hits.groupBy(*TABLE, "c").agg(F.count("*").alias("hits"))
    return counted.groupBy(*TABLE).agg(F.min(F.struct((-F.col("hits")).alias("n"), "c")).alias("best")).select(*TABLE, "best.c", (-F.col("best.n")).alias("hits"))


def summarise_hits(tables: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each table: the hit rows and columns, or that there is no match."""
    counted = hits.groupBy(*TABLE).agg(F.count_distinct("r").alias("n_rows"), F.count_distinct("c").alias("n_cols"))
    known = tables.select(*TABLE).distinct().join(counted, TABLE, "left")
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return known.select(*TABLE, n.alias("hit_rows"), F.coalesce("n_cols", F.lit(0)).cast("long").alias("hit_columns"), F.when(n > 0, "match").otherwise("no match").alias("verdict"))


def number_tables(raw: DataFrame, order: str) -> DataFrame:
    """raw with table_seq from 0 in each paper, in the order of a column."""
    return raw.withColumn("table_seq", F.row_number().over(Window.partitionBy("paper_id").orderBy(order)) - 1)


def table_answers(answers: DataFrame) -> DataFrame:
    """(paper_id, table_seq, pos, plain): nested answers as rows; entries without text are left out."""
    rows = answers.select(*TABLE, F.posexplode("entries").alias("pos", "entry"))
    return rows.select(*TABLE, "pos", F.col("entry.plainText").alias("plain")).where("plain IS NOT NULL")


def or_no_table(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """(paper_id, table_seq, plain): a paper without tables says so in one row."""
    return papers.select("paper_id").join(answers, "paper_id", "left").select("paper_id", "table_seq", F.coalesce("plain", F.lit("No table found")).alias("plain"))


def headed_rows(grid: DataFrame) -> DataFrame:
    """(paper_id, table_seq, r, cells): each body row as an array of (c, header, text), a null header where the column has none.

    A row's cells are brought together first and then meet their table's headers, an
    array too: joined cell by cell they would be shuffled twice.
    """
    clean = normalise_cells(grid)
    heads = merge_headers(clean).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("c", "header"))).alias("heads"))
    rows = clean.where("part = 'body'").groupBy(*TABLE, "r").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("cells"))
    # without gaps a column's header is at its place
    gapless = F.element_at("heads", -1)["c"] == F.size("heads") - 1
    found = lambda x: F.when(gapless, F.get("heads", x["c"])["header"]).otherwise(F.get(F.filter("heads", lambda h: h["c"] == x["c"]), F.lit(0))["header"])
    return rows.join(heads, TABLE, "left").select(*TABLE, "r", F.transform("cells", lambda x: F.struct(x["c"].alias("c"), found(x).alias("header"), x["text"].alias("text"))).alias("cells"))


def verbalise_rows(grid: DataFrame) -> DataFrame:
    """(paper_id, table_seq, r, lines): each body row as lines `header: value`."""
    line = lambda x: F.concat(F.coalesce(x["header"], F.lit("")), F.lit(": "), x["text"])
    return headed_rows(grid).select(*TABLE, "r", F.array_join(F.transform("cells", line), "\n").alias("lines"))


def row_at(grid: DataFrame, index: int) -> DataFrame:
    """The body row of each table at an index, as cells."""
    return grid.where((F.col("part") == "body") & (F.col("r") == index)).select(*TABLE, "c", "text")


def wide_view(grid: DataFrame, paper_id, table_seq: int, view: str) -> DataFrame:
    """One table as a temporary view with a column for each header; a repeated header gets its number.

    A table's width is a matter of its markup, so its headers fit the driver.
    """
    one = normalise_cells(grid.where((F.col("paper_id") == paper_id) & (F.col("table_seq") == table_seq)))
    names: list[str] = []
    columns = []
    for row in merge_headers(one).orderBy("c").collect():
        name = base = row["header"] or f"column_{row['c']}"
        while name in names:
            name = f"{base}_{row['c']}"
        names.append(name)
        columns.append(F.max(F.when(F.col("c") == row["c"], F.col("text"))).alias(name))
    wide = one.where("part = 'body'").groupBy("r").agg(*columns).orderBy("r")
    wide.createOrReplaceTempView(view)
    return wide


def variant_rows_of(grid: DataFrame) -> DataFrame:
    """(paper_id, table_seq, r, row): the body rows of all tables, each a VARIANT object of its cells' texts under the headers.

    A repeated header gets its column's number, one without text is column_<c>. So a
    question in SQL runs over every table, whatever its headers: a table without
    the header asked for gives null.
    """
    rows = headed_rows(grid)

    def named(found: Column) -> Column:
        plain = F.transform(found, lambda x: F.coalesce(F.nullif(x["header"], F.lit("")), F.concat(F.lit("column_"), x["c"].cast("string"))))
        return tx.bound(plain, lambda names: F.zip_with(names, F.sequence(F.lit(1), F.size(names)), lambda n, i: F.when(F.array_position(names, n) < i, F.concat(n, F.lit("_"), F.get(found, (i - 1).cast("int"))["c"].cast("string"))).otherwise(n)))

    def as_map(found: Column) -> Column:
        keyed = tx.bound(named(found), lambda names: F.zip_with(names, found, lambda n, x: F.struct(n.alias("k"), x["text"].alias("v"))))
        last = lambda pairs, k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
        return tx.bound(keyed, lambda pairs: tx.bound(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: last(pairs, k)))))

    return rows.select(*TABLE, "r", F.parse_json(F.to_json(as_map(F.col("cells")))).alias("row"))
