"""Papers as files: BioC and article XML, Markdown, CSV tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound, scrub_control, strip
from ..shared import kept

INFON = "array<struct<_key:string,_VALUE:string>>"
BIOC = "document array<struct<id string, passage array<struct<infon array<struct<_key string, _VALUE string>>, text string>>>>"
# The elements of article XML that hold prose.
PROSE_ELEMENTS = ("content", "abstract", "text", "main_content")
#: Signs of Unicode's private area that mark where these begin and end; a file's own are dropped.
BEGIN, END = "\ue000", "\ue001"
#: Which value of a repeated infon key counts; `all` gives arrays.
REPEATED = ("last", "first", "all")


#: Bytes of a row group as compressed, and the rows after which the writer looks at them.
PACK = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "8"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, path, body): whole files, without control bytes and document type.

    A paper is named by its file, or by the folder where the files lie in folders paper_id=...
    """
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return named(files.select("*", F.col("_metadata.file_path").alias("path")))


def pack_files(files: DataFrame, path: str) -> None:
    """Write files (paper_id, body), where papers come in several parts also `part` (int, from 0), as rows of a table: many papers to a file.

    A folder or file for each paper costs the driver a listing and a rename each,
    and a task's opening; packed papers are read in splits like any table. Spark
    reads up to 4096 rows of a row group at once, so row groups are small.
    """
    files.write.options(**PACK).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """read_files() of packed papers: (paper_id, path, body), and `part` where they have parts. path is the paper's name within the pack."""
    return named(spark.read.parquet(path).withColumn("path", F.concat(F.lit(f"{path}/paper_id="), F.col("paper_id").cast("string"))))


def place_in_paper(rows: DataFrame, place: str) -> DataFrame:
    """rows (paper_id, part, place) without part, place counted on through the parts of a paper, in their order.

    The rows of each part are counted first, so no paper's rows need to come
    together; they are written before that, so that papers are read once. Where
    papers have no parts, rows stay as they are.
    """
    if "part" not in rows.columns:
        return rows
    rows = kept(rows)
    counted = rows.groupBy("paper_id", "part").agg((F.max(place) + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("paper_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = counted.select("paper_id", "part", before.alias("__before")).where("__before > 0")
    known = rows.join(F.broadcast(later), ["paper_id", "part"], "left")
    return known.withColumn(place, (F.col(place) + F.coalesce("__before", F.lit(0))).cast("int")).select(*(c for c in rows.columns if c != "part"))


def part_of(files: DataFrame) -> list[str]:
    return ["part"] if "part" in files.columns else []


def named(files: DataFrame, *more: str) -> DataFrame:
    paper = F.col("paper_id") if "paper_id" in files.columns else F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    body = F.regexp_replace(scrub_control(F.col("body")), r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "")
    return files.select(paper.alias("paper_id"), *part_of(files), "path", *more, body.alias("body"))


def parsed(files: DataFrame) -> DataFrame:
    """files with `bioc`, null where the body is not a BioC collection; what has no element of that name is not parsed."""
    named = F.contains(F.lower("body"), F.lit("<document"))
    return files.withColumn("bioc", F.when(named, F.from_xml("body", BIOC, {"mode": "PERMISSIVE"}))).withColumn("bioc", F.when(F.col("bioc.document").isNotNull(), F.col("bioc")))


def numbered_rows(files: DataFrame, found: Column, place: str, name: str) -> DataFrame:
    """(paper_id, place, name) for each element of the array `found` of a file.

    Files are told apart within `found`, which is null for those that don't count: a
    filter before it, and the one on its size that Spark puts before a plain
    generator, would parse each file anew.
    """
    rows = files.select("paper_id", *part_of(files), F.posexplode_outer(found).alias(place, name)).where(F.col(place).isNotNull())
    return place_in_paper(rows, place)


def infon_map(infons: Column, repeated: str = "last") -> Column:
    """A passage's infons (_key, _VALUE) by their keys in order of appearance; of a repeated key the last or first value, or all. Those without a key are left out."""
    if repeated not in REPEATED:
        raise ValueError(f"repeated is one of {', '.join(REPEATED)}")
    named = F.filter(F.coalesce(infons, F.array().cast(INFON)), lambda i: i["_key"].isNotNull())
    own = lambda k: F.transform(F.filter(named, lambda i: i["_key"] == k), lambda i: i["_VALUE"])
    keys = F.array_distinct(F.transform(named, lambda i: i["_key"]))
    pick = {"last": lambda k: F.element_at(own(k), -1), "first": lambda k: F.element_at(own(k), 1), "all": own}[repeated]
    return F.map_from_arrays(keys, F.transform(keys, pick))


def raw_passages(files: DataFrame) -> DataFrame:
    """(paper_id, doc_seq, seq, p) of the BioC collections among files; p has the passage's infons and text."""
    docs = numbered_rows(parsed(files), F.col("bioc.document"), "doc_seq", "d")
    return docs.select("paper_id", "doc_seq", F.posexplode("d.passage").alias("seq", "p"))


def bioc_passages(files: DataFrame, repeated: str = "last") -> DataFrame:
    """(paper_id, doc_seq, seq, infons, text, section_type, type) of the BioC collections among files; prose takes doc_seq 0.

    A key that a passage repeats has its last value, its first, or with
    repeated="all" all of them in an array; section_type and type are then the last.
    """
    rows = raw_passages(files).select("paper_id", "doc_seq", "seq", infon_map(F.col("p.infon"), repeated).alias("infons"), F.col("p.text").alias("text"))
    value = lambda k: F.element_at(F.col("infons")[k], -1) if repeated == "all" else F.col("infons")[k]
    return rows.withColumn("section_type", value("section_type")).withColumn("type", value("type"))


def rejected_infons(files: DataFrame) -> DataFrame:
    """(paper_id, doc_seq, seq, reason, key, n) for each passage and key: `no key` for infons without one, `repeated key` for one that comes n times; the passages are read all the same."""
    keys = raw_passages(files).select("paper_id", "doc_seq", "seq", F.explode("p.infon").alias("i")).select("paper_id", "doc_seq", "seq", F.col("i._key").alias("key"))
    counted = keys.groupBy("paper_id", "doc_seq", "seq", "key").agg(F.count("*").alias("n")).where("key IS NULL OR n > 1")
    return counted.select("paper_id", "doc_seq", "seq", F.when(F.col("key").isNull(), "no key").otherwise("repeated key").alias("reason"), "key", "n")


def well_formed(body: Column) -> Column:
    """Whether a body parses as XML of any kind."""
    return F.from_xml(body, "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNull() & F.trim(body).startswith("<")


def marked(body: Column) -> Column:
    """XML with a sign of its own behind the start and before the end of every prose element; comments and CDATA stay as they are."""
    names = "|".join(PROSE_ELEMENTS)
    attributes = r"""(?:\s+[^\s=<>/]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""

    def tags(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(s, f"<(?:{names}){attributes}>", f"$0{BEGIN}"), rf"</(?:{names})\s*>", f"{END}$0")

    clean = F.translate(body, BEGIN + END, "")
    pieces = F.split(clean, r"(?=<!\[CDATA\[|<!--)|(?<=\]\]>|-->)")
    apart = F.array_join(F.transform(pieces, lambda s: F.when(F.startswith(s, F.lit("<!")), s).otherwise(tags(s))), "")
    return F.when(F.contains(clean, F.lit("<![CDATA[")) | F.contains(clean, F.lit("<!--")), apart).otherwise(tags(clean))


def prose_texts(body: Column) -> Column:
    """The whole texts of the outermost prose elements of well-formed XML, in the order of the document.

    The document's text holds the signs of marked(); how many are open decides
    which text belongs to an element, and an element within another is part of it.
    """
    signs = F.regexp_extract_all(F.xpath_string(marked(body), F.lit("/")), F.lit(f"([{BEGIN}{END}]|[^{BEGIN}{END}]+)"), 1)
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("own"), F.array().cast("array<string>").alias("texts"))

    def step(s: Column, sign: Column) -> Column:
        ends = (sign == END) & (s["open"] == 1)
        opened = s["open"] + F.when(sign == BEGIN, 1).when((sign == END) & (s["open"] > 0), -1).otherwise(0)
        own = F.when(ends | (opened == 0), "").when((sign == BEGIN) | (sign == END), s["own"]).otherwise(F.concat(s["own"], sign))
        return F.struct(opened.alias("open"), own.alias("own"), F.when(ends, F.array_append(s["texts"], s["own"])).otherwise(s["texts"]).alias("texts"))

    return F.aggregate(signs, start, step, lambda s: s["texts"])


def article_passages(files: DataFrame) -> DataFrame:
    """Passages of article XML that is not BioC: a passage for each outermost prose element, with all text in it, in the order of the document.

    Equal paragraphs are passages of their own. Outer white space is dropped, and
    so are elements without text.
    """
    texts = F.filter(F.transform(prose_texts(F.col("body")), strip), lambda t: t != "")
    rows = numbered_rows(parsed(files), F.when(F.col("bioc").isNull() & well_formed(F.col("body")), texts), "seq", "text")
    return rows.select("paper_id", F.lit(0).alias("doc_seq"), "seq", F.create_map().cast("map<string,string>").alias("infons"), "text", F.lit(None).cast("string").alias("section_type"), F.lit(None).cast("string").alias("type"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return passages(read_files(spark, path))


def passages(files: DataFrame) -> DataFrame:
    return bioc_passages(files).unionByName(article_passages(files))


def rejected(files: DataFrame) -> DataFrame:
    """(paper_id, path, reason) of files that are neither BioC nor well-formed XML; the others go on."""
    return parsed(files).where("bioc IS NULL").where(~F.coalesce(well_formed(F.col("body")), F.lit(False))).select("paper_id", "path", F.lit("not well-formed").alias("reason"))


def is_table(kind: Column) -> Column:
    return F.coalesce(kind == "table", F.lit(False))


def bioc_tables(passages: DataFrame) -> DataFrame:
    """(paper_id, table_seq, name, markup) of table passages, over all documents of a collection in their order."""
    rows = passages.where(is_table(F.col("type"))).select("paper_id", "doc_seq", "seq", F.col("infons")["id"].alias("name"), F.col("infons")["xml"].alias("markup")).where("markup IS NOT NULL")
    order = Window.partitionBy("paper_id").orderBy("doc_seq", "seq")
    return rows.select("paper_id", (F.row_number().over(order) - 1).alias("table_seq"), "name", "markup")


def bioc_file_tables(files: DataFrame) -> DataFrame:
    """bioc_tables() of the collections among files: numbered where they are read, so their markup is not shuffled."""
    infons = lambda p, k: F.try_element_at(F.filter(F.coalesce(p["infon"], F.array().cast(INFON)), lambda i: i["_key"] == k), F.lit(-1))["_VALUE"]
    table = lambda p: F.struct(infons(p, "type").alias("type"), infons(p, "id").alias("name"), infons(p, "xml").alias("markup"))
    passages = F.flatten(F.filter(F.transform("bioc.document", lambda d: d["passage"]), lambda p: p.isNotNull()))
    found = F.filter(F.transform(passages, table), lambda t: is_table(t["type"]) & t["markup"].isNotNull())
    return numbered_rows(parsed(files), found, "table_seq", "t").select("paper_id", "table_seq", "t.name", "t.markup")


def article_tables(files: DataFrame, numbered: str = "accepted") -> DataFrame:
    """(paper_id, table_seq, name, markup) of the tables in article XML; cells are td alone, their texts stripped.

    A table needs a body; without a head its first row will serve as one, so it
    needs a second. table_seq counts the accepted tables, or with numbered="all"
    those that are none too.
    """
    found = F.regexp_extract_all("body", F.lit(r"(?is)(<table\b.*?</table>)"), 1)

    def whole(m: Column) -> Column:
        body = F.regexp_extract(m, r"(?is)<tbody[^>]*>(.*?)</tbody>", 1)
        return (F.regexp_count(body, F.lit(r"(?i)<tr\b")) > F.when(m.rlike("(?i)<thead"), 0).otherwise(1)) & m.rlike("(?i)<tbody")

    some = found if numbered == "all" else F.filter(found, whole)
    rows = numbered_rows(parsed(files), F.when(F.col("bioc").isNull(), some), "table_seq", "markup")
    if numbered == "all":
        rows = rows.where(whole(F.col("markup")))
    cells = F.regexp_replace(F.regexp_replace("markup", r"(?is)<th\b.*?</th>", ""), r"(?i)(<td\b[^>]*>)\s+|\s+(</td>)", "$1$2")
    return rows.select("paper_id", "table_seq", F.lit(None).cast("string").alias("name"), cells.alias("markup"))


def markdown_tables(files: DataFrame) -> DataFrame:
    """(paper_id, table_seq, name, markup) of HTML tables within Markdown."""
    rows = numbered_rows(files, F.regexp_extract_all("body", F.lit(r"(?is)(<table\b.*?</table>)"), 1), "table_seq", "markup")
    return rows.select("paper_id", "table_seq", F.lit(None).cast("string").alias("name"), "markup")


#: Signs that no scrubbed file holds: they part records and fields once quotes are followed.
RECORD, FIELD = "\x1e", "\x1f"


def outside_quotes(s: Column, pattern: str, sign: str) -> Column:
    """s with what matches outside quotes replaced: of the pieces between quotes every other one is outside."""
    replaced = (lambda p: F.regexp_replace(p, pattern, sign)) if len(pattern) > 1 else (lambda p: F.translate(p, pattern, sign))
    pieces = F.split(s, '"', -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, replaced(p)).otherwise(p)), '"')


def csv_fields(record: Column) -> Column:
    """A record's fields without their quotes; an empty one is null, a quoted empty one is empty."""
    fields = F.split(outside_quotes(record, ",", FIELD), FIELD, -1)
    unquoted = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(fields, lambda f: F.when(F.startswith(f, F.lit('"')), unquoted(f)).otherwise(F.nullif(f, F.lit(""))))


def stray_quote(record: Column) -> Column:
    """Whether a quote stands within a field: outside quotes there is nothing between a quote and the next comma or line end."""

    def stray(pieces: Column, last: Column) -> Column:
        return F.exists(F.transform(pieces, lambda p, i: (i % 2 == 0) & (p != "") & (((i > 0) & ~F.substring(p, 1, 1).isin(*ends)) | ((i < last) & ~F.substring(p, -1, 1).isin(*ends)))), lambda x: x)

    ends = (",", "\r", "\n")
    return F.contains(record, F.lit('"')) & bound(F.split(record, '"', -1), lambda pieces: stray(pieces, F.size(pieces) - 1))


#: So many records of a file are numbered in one group.
RECORDS = 20_000
#: A line and where it stands: the split of its file, its place there, the quotes before it there (odd: 1),
#: and the lines up to it, itself too, that begin a record, if the split begins outside quotes and if it begins within them.
LINES = "path string, block long, at long, body string, quotes long, odd long, begun_outside long, begun_within long"


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, LINES): the lines of files, cut at line feeds; Spark reads large files in splits, each in its order."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at, quotes, begun = None, 0, 0, np.zeros(2, np.int64)
        for batch in batches:
            paths, block = batch.column("path").dictionary_encode(), batch.column("block").to_numpy()
            counts = pc.count_substring(batch.column("body"), '"').to_numpy().astype(np.int64)
            code = paths.indices.to_numpy()
            ends = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            found = np.zeros((batch.num_rows, 4), np.int64)
            for a, b in zip(ends, ends[1:], strict=False):
                if of != (of := (paths.dictionary[int(code[a])].as_py(), int(block[a]))):
                    at, quotes, begun = 0, 0, np.zeros(2, np.int64)
                own = quotes + np.cumsum(counts[a:b])
                odd = (own - counts[a:b]) % 2
                told = begun + np.cumsum(np.stack([odd == 0, odd == 1], axis=1), axis=0)
                found[a:b] = np.column_stack([at + np.arange(b - a), odd, told])
                at, quotes, begun = at + b - a, own[-1], told[-1]
            place, odd, outside, within = (pa.array(np.ascontiguousarray(found[:, i])) for i in range(4))
            columns = [batch.column("paper_id"), batch.column("path"), batch.column("block"), place, batch.column("body"), pa.array(counts), odd, outside, within]
            yield pa.RecordBatch.from_arrays(columns, ["paper_id", "path", "block", "at", "body", "quotes", "odd", "begun_outside", "begun_within"])

    read = spark.read.text(path, lineSep="\n").withColumnRenamed("value", "body")
    lines = named(read.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")), "block")
    return lines.mapInArrow(followed, f"paper_id {lines.schema['paper_id'].dataType.simpleString()}, {LINES}")


def joined_lines(lines: DataFrame, *by: str) -> DataFrame:
    """(by, body): the lines of each group in their order."""
    in_order = F.array_sort(F.collect_list(F.struct("block", "at", "body")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(in_order, lambda x: x["body"]), "\n").alias("body"))


def read_csv_tables(spark: SparkSession, path: str, columns: int | None = None, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Headerless CSV files as grid cells (paper_id, table_seq, part, r, c, text), and rejects (paper_id, line, reason).

    Each file has a width of its own, that of its first record, or `columns`. A
    record with more fields is rejected, or with whole_files all of its file; one
    with fewer is filled up with nulls, or rejected where `columns` is given. A quoted field may hold
    line ends, commas and doubled quotes. A file whose quotes can't be followed
    is rejected, as one line without its last line feed. Blank lines don't count.

    A file of any size is read in splits. The quotes of each tell where the next one
    begins, and its records are counted on from those before; only a rejected
    file comes together.
    """
    lines = csv_lines(spark, path)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.max("begun_outside").alias("outside"), F.max("begun_within").alias("within"))
    blocks = blocks.select("path", "block", "outside", "within", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"), (F.sum("quotes").over(Window.partitionBy("path")) % 2 == 1).alias("open"))
    begun = F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))
    # these few rows for each file are written, so that Spark knows their size where they are joined
    blocks = kept(blocks.select("path", "block", "inside", "open", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("done")))
    record = F.col("done") + F.when(F.col("inside"), F.col("begun_within")).otherwise(F.col("begun_outside"))
    placed = lines.join(blocks, ["path", "block"]).where(~F.col("open")).select("paper_id", "path", "block", "at", "body", record.alias("record"))
    key = ["paper_id", "path", "bucket"]
    records = joined_lines(placed.withColumn("bucket", F.floor(F.col("record") / RECORDS)).repartition(*key), *key, "record")
    # line feeds outside quotes are gone by now: only a carriage return can end a line within
    parted = F.when(F.contains("body", F.lit("\r")), F.split(outside_quotes(F.col("body"), r"\r\n|\r|\n", RECORD), RECORD, -1)).otherwise(F.array("body"))
    own = F.filter(parted, lambda r: F.trim(r) != "")
    rows = records.select(*key, "record", stray_quote(F.col("body")).alias("stray"), F.posexplode_outer(own).alias("sub", "line")).where("line IS NOT NULL")
    rows = kept(rows.select("*", csv_fields(F.col("line")).alias("fields")).select("*", F.size("fields").alias("n")))
    width = F.lit(columns) if columns else F.min_by("n", F.struct("record", "sub"))
    files = kept(rows.groupBy("path").agg(F.max("stray").alias("stray"), width.alias("width")))

    amiss = blocks.where("open").select("path", F.lit("open quote").alias("reason")).distinct().unionByName(files.where("stray").select("path", F.lit("quote within a field").alias("reason")))
    whole = joined_lines(lines.join(kept(amiss), "path"), "paper_id", "path", "reason").select("paper_id", F.col("body").alias("line"), "reason")
    known = rows.drop("stray").join(files.where(~F.col("stray")).drop("stray"), "path")
    fits = F.col("n") == F.col("width") if columns else F.col("n") <= F.col("width")
    bad, good = known.where(~fits), known.where(fits)
    rejects = whole.unionByName(bad.select("paper_id", "line", F.lit("fields").alias("reason")))
    if whole_files:
        good = good.join(kept(bad.select("path").distinct()), "path", "left_anti")
    counted = good.groupBy("path", "bucket").agg(F.count("*").alias("n_good"))
    earlier = kept(counted.select("path", "bucket", F.coalesce(F.sum("n_good").over(Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")))
    place = F.row_number().over(Window.partitionBy("path", "bucket").orderBy("record", "sub")) - 1
    numbered = good.select("paper_id", "path", "bucket", "width", "fields", place.alias("place")).join(earlier, ["path", "bucket"])
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.get(F.col("fields"), i))
    cells = numbered.select("paper_id", F.lit(0).alias("table_seq"), F.lit("body").alias("part"), (F.col("earlier") + F.col("place")).cast("int").alias("r"), F.posexplode(padded).alias("c", "text"))
    return cells, rejects
