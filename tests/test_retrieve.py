from conftest import SMALL

from lectern.operators import answers as an
from lectern.operators import retrieve as rt
from lectern.plans import catalog
from lectern.plans import fixtures as fx


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_join_equals_nested_loop(spark):
    chunks = spark.createDataFrame(
        [(1, 0, "171G>A and 71 g > a"), (1, 1, "Leu24Arg"), (2, 0, "Cys14479 is longer, C14470 too"), (2, 1, "nothing"), (3, 0, "= sign"), (3, 1, "*45G>A 1234567890123456G>A")], "paper_id long, chunk_seq int, text string"
    )
    variants = spark.createDataFrame([(0, "x:c.71G>A"), (1, "x:c.del35"), (2, "x:c.="), (3, "x:c.*45G>A"), (4, "x:c.1234567890123456G>A")], "variant_id int, hgvs string")
    proteins = spark.createDataFrame([("x:c.71G>A", "p.(Leu24Arg)"), ("x:c.del35", "p.(Cys1447Ter)")], "hgvs string, description string")
    known = rt.prepare_variants(variants, proteins)
    got = rows(rt.match(chunks, known))
    assert got == rows(rt.match(chunks, known, "nested"))
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 0, 0), (1, 1, 0), (2, 0, 1), (3, 0, 2), (3, 1, 3), (3, 1, 4)}


def test_fallback_only_where_nothing_hit(spark):
    chunks, variants = fx.chunks(spark, SMALL), fx.prepared(spark)
    hits = rt.match(chunks, variants)
    spots = rt.position_fallback(chunks, variants, hits)
    pairs = lambda df: {tuple(r) for r in df.select("paper_id", "variant_id").collect()}
    assert pairs(spots) and not pairs(spots) & pairs(hits)


def test_top_k_keeps_document_order(spark):
    found = spark.createDataFrame([(1, i, 0) for i in range(9)], "paper_id long, chunk_seq int, variant_id int")
    assert [r["chunk_seq"] for r in rt.top_chunks(found, 2).orderBy("rank").collect()] == [0, 1]


def test_reports_have_four_sections(spark):
    for r in catalog.reports(spark, SMALL).limit(20).collect():
        assert [s["title"] for s in r["report"]["sections"]] == list(an.SECTIONS)
        assert all(s["body"] for s in r["report"]["sections"])


def test_answerer_failure_is_a_row(spark):
    asked = spark.createDataFrame([(1, 0, 0, 0, "ok"), (1, 0, 0, 1, "bad")], "paper_id long, variant_id int, alias_idx int, qtype int, prompt string")

    def answerer(prompt):
        if prompt == "bad":
            raise TimeoutError("timed out")
        return "yes"

    got = {r["qtype"]: (r["answer"], r["reason"]) for r in an.judge(an.answered_by(asked, answerer)).collect()}
    assert got == {0: ("yes", None), 1: (None, "timeout")}


def test_dedupe_is_idempotent(spark):
    lines = spark.createDataFrame([(1, 0, "*c.1A>G*"), (1, 1, "C.1a>g "), (1, 2, "x")], "paper_id long, pos int, line string")
    once = an.first_of_each(lines, ["paper_id"], "pos", "line")
    assert rows(once) == rows(an.first_of_each(once, ["paper_id"], "pos", "line")) == [(1, 0, "*c.1A>G*"), (1, 2, "x")]


def test_partners(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("c.1319T > G with c.1896-1G > C and c.71G>A, c.1319T>G",)], "t string")
    assert row.select(an.partners(F.col("t"), F.lit("c.71G>A"))).first()[0] == ["c.1319T>G", "c.1896-1G>C"]


def test_no_registered_match_tries_every_pair(spark, monkeypatch):
    ways = []
    match = catalog.rt.match
    monkeypatch.setattr(catalog.rt, "match", lambda chunks, variants, how="token": ways.append(how) or match(chunks, variants, how))
    catalog.j01_match_many_variants(spark, SMALL)
    assert ways and "nested" not in ways


def test_forms_without_numbers_and_long_numbers(spark):
    chunks = spark.createDataFrame([(1, 0, "x A > G y"), (1, 1, "DEL here"), (2, 0, "12345678901234567890"), (2, 1, "no 7"), (3, 0, "q35w"), (3, 1, "c.991234567890123A>T")], "paper_id long, chunk_seq int, text string")
    variants = spark.createDataFrame([(0, "x:c.A>G"), (1, "x:c.del"), (2, "x:c.35"), (3, "x:c.1234567890123A>T"), (4, "x:c.90")], "variant_id int, hgvs string")
    known = rt.prepare_variants(variants)
    got = rows(rt.match(chunks, known))
    assert got == rows(rt.match(chunks, known, "nested"))
    assert {r[:3] for r in got} == {(1, 0, 0), (1, 1, 1), (3, 0, 2), (3, 1, 3), (2, 0, 4), (3, 1, 4)}


def test_retrieval_in_one_pass_is_matching_then_fallback(spark):
    chunks, variants = fx.chunks(spark, SMALL), fx.prepared(spark)
    found = rt.retrieve(chunks, variants).collect()
    hits = rt.match(chunks, variants)
    spots = rt.position_fallback(chunks, variants, hits)
    forms = {tuple(r) for r in hits.collect()}
    assert {(r["paper_id"], r["chunk_seq"], r["variant_id"], r["by_dna"], r["by_long"], r["by_short"]) for r in found if r["match_kind"] == "form"} == forms
    assert {(r["paper_id"], r["chunk_seq"], r["variant_id"]) for r in found if r["match_kind"] == "position"} == {tuple(r) for r in spots.collect()}
    assert len(found) == len(forms) + spots.count()


def test_user_matcher(spark):
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([(1, 0, "see L24R"), (1, 1, "see 24"), (2, 0, "none")], "paper_id long, chunk_seq int, text string")
    variants = spark.createDataFrame([(0, "L24R"), (1, "none")], "variant_id int, name string")
    every = chunks.select("paper_id", "chunk_seq").crossJoin(variants.select("variant_id"))
    got = rt.match_with(chunks, variants, lambda body, v: F.contains(body, v["name"]), every)
    assert rows(got) == [(1, 0, 0), (2, 0, 1)]


def test_prose_is_of_the_first_document(spark):
    passages = spark.createDataFrame([(1, 0, 0, "TITLE", "a"), (1, 0, 1, None, "b"), (1, 1, 0, "TITLE", "z"), (1, 0, 2, "ref", "r")], "paper_id long, doc_seq int, seq int, section_type string, text string")
    assert rows(rt.flatten_papers(rt.prose(passages))) == [(1, "a\nb")]


def test_many_variants_equal_the_nested_loop(spark):
    chunks, known = fx.chunks(spark, SMALL), catalog.many_variants(spark, SMALL)
    assert rows(catalog.j01_match_many_variants(spark, SMALL)) == rows(rt.match(chunks, known, "nested"))


def test_tokens_never_lose_a_match(spark):
    """Random texts and forms of few signs, with white space where patterns allow it, against every pair tried."""
    import random

    rng = random.Random(8)
    pick = lambda signs, least, most: "".join(rng.choice(signs) for _ in range(rng.randint(least, most)))
    texts = [pick("1122cG>A_*+ \u00a0\tgadel=", 0, 40) for _ in range(400)]
    chunks = spark.createDataFrame([(i // 4, i % 4, t) for i, t in enumerate(texts)], "paper_id long, chunk_seq int, text string")
    names = sorted({pick("1122G>A_*+del=", 1, 6) for _ in range(250)})
    bodies = [f"p.({pick('12AGde', 5, 7)})" for _ in names]
    variants = spark.createDataFrame([(i, f"x{i}:c.{n}") for i, n in enumerate(names)], "variant_id int, hgvs string")
    proteins = spark.createDataFrame([(f"x{i}:c.{n}", b) for i, (n, b) in enumerate(zip(names, bodies, strict=True))], "hgvs string, description string")
    known = rt.prepare_variants(variants, proteins)
    got = rows(rt.match(chunks, known))
    assert got == rows(rt.match(chunks, known, "nested")) and len(got) > 500


def test_forms_are_verified_once(spark):
    """Variants that share a form share its candidates; a form of which a token is nowhere has none."""
    chunks = rt.unescaped(spark.createDataFrame([(1, i, "c.100_123dup") for i in range(3)], "paper_id long, chunk_seq int, text string"))
    variants = spark.createDataFrame([(i, f"x{i}:c.100_123dup") for i in range(50)] + [(60, "x:c.100_999dup"), (61, "x:c.=")], "variant_id int, hgvs string")
    tried = rt.candidates(chunks, rt.forms_of(rt.prepare_variants(variants))).collect()
    assert sorted((r["chunk_seq"], r["form"]) for r in tried) == [(i, "100_123dup") for i in range(3)]


def many_of_one_form(spark):
    """Chunks and variants that share `=`; some of both share protein forms, too, and one variant stands twice in the table."""
    texts = [f"= {['Leu24Arg', 'L25R', 'Leu26Arg L26R', 'none'][i % 4]}" if i % 5 else "Leu24Arg alone, L25R" for i in range(60)]
    chunks = spark.createDataFrame([(i // 3, i % 3, t) for i, t in enumerate(texts)], "paper_id long, chunk_seq int, text string")
    variants = spark.createDataFrame([(i, f"x{i}:c.=") for i in range(70)] + [(70, "y:c.7G>A")], "variant_id int, hgvs string")
    named = [(f"x{i}:c.=", f"p.(Leu{24 + i % 9}Arg)") for i in range(0, 70, 2)] + [("x0:c.=", "p.(Leu25Arg)"), ("y:c.7G>A", "p.(Leu26Arg)")]
    return chunks, rt.prepare_variants(variants, spark.createDataFrame(named, "hgvs string, description string"))


def test_what_a_shared_form_multiplies_is_not_shuffled(spark):
    """Its rows are as many as chunks times variants: nothing may be grouped above the join that gives them."""
    import re

    plan = rt.match(*many_of_one_form(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search("Aggregate|Join", plan)[0] == "Join"


def test_tiles_give_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(rt, "TILE", 8)
    chunks, known = many_of_one_form(spark)
    want = {}
    for *key, dna, long, short in map(tuple, rt.match(chunks, known, "nested").collect()):
        before = want.get(tuple(key), (False, False, False))
        want[tuple(key)] = (before[0] or dna, before[1] or long, before[2] or short)
    got = rows(rt.match(chunks, known))
    assert got == sorted((k + v for k, v in want.items()), key=repr)
    assert {r[3:] for r in got} >= {(True, False, False), (True, True, False), (True, False, True), (True, True, True), (False, True, True), (False, True, False)}


def test_tiles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rt, "TILE", 8)
    held = spark.createDataFrame([(1, i, "dna", "=", "=") for i in range(300)] + [(2, 0, "long", "Leu24Arg", "")], "paper_id long, chunk_seq int, way string, form string, pattern string")
    forms = spark.createDataFrame([(i, "dna", "=", "=") for i in range(200)] + [(0, "long", "Leu24Arg", ""), (1, "long", "Leu99Arg", "")], "variant_id int, way string, form string, pattern string")
    sides = [{tuple(r)[:4]: r["count"] for r in side.groupBy("way", "form", "slice", "block").count().collect()} for side in rt.tiles(held, forms)]
    assert len(sides[0].keys() & sides[1].keys()) == 38 * 25 + 1
    assert all(max(side.values()) <= 4 * 8 for side in sides)


def test_a_matcher_with_its_own_tokens(spark):
    """A matcher on gene names finds chunks without numbers; without tokens it needs pairs."""
    import pytest
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([(1, 0, "the HBB gene"), (1, 1, "see 24"), (2, 0, None)], "paper_id long, chunk_seq int, text string")
    variants = spark.createDataFrame([(0, "HBB"), (1, "TP53"), (2, None)], "variant_id int, gene string")
    words = lambda body: F.split(body, " ")
    matcher = rt.Matcher(lambda body, v: F.contains(body, v["gene"]), words, lambda v: F.array_compact(F.array(v["gene"])))
    assert rows(rt.match_with(chunks, variants, matcher)) == [(1, 0, 0)]
    with pytest.raises(ValueError, match="needs pairs"):
        rt.match_with(chunks, variants, matcher.accepts)
