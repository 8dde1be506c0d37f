import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import hgvs
from lectern.functions import text as tx


def test_patterns_of_hand_made_variants(spark):
    rows = spark.createDataFrame(
        [("NM_1.1:c.71G>A", r"\s*71\s*G\s*>\s*A"), ("c.(123A>G)", r"\s*123\s*A\s*>\s*G"), ("x:c.1896-1G>C", r"\s*1896\s*\-\s*1\s*G\s*>\s*C"), ("c.1539+1G>A", r"\s*1539\s*\+\s*1\s*G\s*>\s*A"), ("c.235_236dup", r"\s*235\s*_\s*236\s*dup"), ("c.*45G>A", r"\*\s*45\s*G\s*>\s*A"), ("c.=", r"\=")],
        "h string, want string",
    )
    for r in rows.select("want", hgvs.dna_pattern(hgvs.dna_core(hgvs.strip_reference(F.col("h")))).alias("p")).collect():
        assert r["p"] == r["want"]


def test_protein_forms(spark):
    rows = spark.createDataFrame([("NP_1:p.(Leu24Arg)",), ("p.(Cys1447Glnfs*29)",), ("p.(Cys1447Ter)",), ("p.(=)",), ("p.?",), (None,)], "d string")
    d = F.col("d")
    got = [tuple(r) for r in rows.select(hgvs.long_form(d), hgvs.short_form(d), hgvs.protein_status(d)).collect()]
    assert got == [("Leu24Arg", "L24R", "ok"), ("Cys1447", "C1447", "ok"), ("Cys1447Ter", "C1447", "ok"), (None, None, "too short"), (None, None, "no protein change"), (None, None, "missing")]


def test_digits_and_aliases(spark):
    rows = spark.createDataFrame([("c.71_1234del", "Leu24Arg"), ("c.12_34del", None), ("c.=", "")], "c string, p string")
    got = [tuple(r) for r in rows.select(hgvs.longest_digit_run(F.col("c")), hgvs.table_aliases(F.col("c"), F.col("p")), hgvs.text_aliases(F.col("c"), F.col("p"))).collect()]
    assert got == [("1234", ["1234", "24"], ["c.71_1234del", "Leu24Arg"]), ("12", ["12"], ["c.12_34del"]), (None, [], ["c.="])]


def test_unescape_keeps_what_it_cannot_resolve(spark):
    rows = spark.createDataFrame([("a\\nb\\x41",), ("plain é",), ("\\u2200 \\n",), (None,), ("c\\xc3\\xa9",)], "t string")
    assert [r[0] for r in rows.select(tx.unescape_text(F.col("t"))).collect()] == ["a\nbA", "plain é", "\\u2200 \\n", None, "cé"]


def test_numbers(spark):
    rows = spark.createDataFrame([("1",), ("-1.5e3",), ("1.0d",), ("1f",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.is_number(F.col("t"))).collect()] == [True, True, False, False, False, False, False]


def chunked(spark, texts, width, overlap):
    """The recursive chunks of each text, in order."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.recursive_chunks(F.col("t"), width, overlap).alias("c"))
    found = {r["i"]: r["c"] for r in rows.collect()}
    return [found[i] for i in range(len(texts))]


def test_recursive_chunks_by_hand(spark):
    assert chunked(spark, ["short", "", "x" * 25, None], 10, 3) == [["short"], [], ["x" * 10, "x" * 10, "x" * 10, "x" * 4], None]
    assert chunked(spark, ["aa bb cc"], 5, 2) == [["aa bb", "cc"]]
    assert chunked(spark, ["one\n\ntwo\n\nthree"], 9, 0) == [["one\n\ntwo", "three"]]
    assert chunked(spark, ["aa bb cc dd"], 8, 3) == [["aa bb cc", "cc dd"]]


def test_fixed_chunks(spark):
    rows = spark.createDataFrame([("a" * 10,), ("b" * 25,), ("",)], "t string")
    got = [r[0] for r in rows.select(tx.fixed_chunks(F.col("t"), 10, 2)).collect()]
    assert [list(map(len, g)) for g in got] == [[10], [10, 10, 9], [0]]


def chunks_by_the_rule(text, width, overlap, separators=("\n\n", "\n", " ", "")):
    """The rule of recursive chunks said again, by positions: pieces are [start, end) ranges and a pack is a run of them."""
    if not text:
        return []
    found = [s for s in separators if s and s in text]
    separator = found[0] if found else ""
    finer = separators[separators.index(separator) + 1 :]
    cuts = [0, len(text)]
    if separator:
        at = text.find(separator)
        while at >= 0:
            cuts.append(at)
            at = text.find(separator, at + len(separator))
    else:
        cuts += range(len(text))
    cuts = sorted(set(cuts))
    pieces = list(zip(cuts, cuts[1:], strict=False))
    out, first, k = [], 0, 0
    while k <= len(pieces):
        long = k < len(pieces) and pieces[k][1] - pieces[k][0] >= width and finer
        full = k < len(pieces) and k > first and pieces[k][1] - pieces[first][0] > width
        if k == len(pieces) or long or full:
            if k > first:
                out.append(text[pieces[first][0] : pieces[k - 1][1]].strip())
            if k == len(pieces):
                break
            if long:
                out += chunks_by_the_rule(text[slice(*pieces[k])], width, overlap, finer)
                k, first = k + 1, k + 1
                continue
            while first < k and (pieces[k - 1][1] - pieces[first][0] > overlap or pieces[k][1] - pieces[first][0] > width):
                first += 1
        k += 1
    return [c for c in out if c]


@pytest.mark.parametrize(("width", "overlap"), [(5, 0), (8, 3), (9, 8), (20, 5), (40, 12)])
def test_recursive_chunks_follow_the_rule(spark, width, overlap):
    rng = random.Random(width)
    texts = ["".join(rng.choice("abc \n" if i % 3 else "ab\u00e9    \n\n") for _ in range(rng.randrange(400))) for i in range(250)]
    got = chunked(spark, texts, width, overlap)
    assert got == [chunks_by_the_rule(t, width, overlap) for t in texts]
    for text, chunks in zip(texts, got, strict=True):
        assert all(0 < len(c) <= width for c in chunks)
        assert set(re.sub(r"\s", "", text)) == set(re.sub(r"\s", "", "".join(chunks)))


def test_recursive_chunks_of_whole_documents(spark):
    from conftest import SMALL

    from lectern.plans import catalog
    from lectern.plans import fixtures as fx

    want = {(r["paper_id"], i, c) for r in fx.papers(spark, SMALL).collect() for i, c in enumerate(chunks_by_the_rule(r["body"], 1500, 100))}
    assert {tuple(r) for r in catalog.r02_recursive_chunks(spark, SMALL).select("paper_id", "chunk_seq", "text").collect()} == want
