"""Each operator against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal
from fractions import Fraction
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from lectern.llm import queries
from lectern.llm.common import components, cut, words_of
from lectern.llm.exact_dedup import digest_runs, exact_duplicates, merge_runs
from lectern.llm.language_id import identify_languages, language_samples, learnable
from lectern.llm.line_dedup import LineRuns, dedup_lines, id_batches
from lectern.llm.mixing import Pfair, exact, mix_sources, phases, slot_table
from lectern.llm.ngram_join import drop_similar, jaccard_components, least_difference, set_sketch, sketches
from lectern.llm.packing import Encoded, best_fit, document_ids, lower_bound, pack
from lectern.llm.sharding import hilbert_index, hilbert_shards
from lectern.llm.substring_dedup import parse, remove_repeats
from lectern.llm.toxicity import drop_toxic, label_model, learn_toxicity, score_toxicity
from lectern.llm.vector_dedup import cells, links_in, similar_vectors, subspaces, units_of_work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column for every name the operators use inside.
CLASH = ("row", "n", "part", "size", "shard", "slot", "cls", "keeper", "n_lines", "n_words", "h1", "curve", "piece", "score", "mix_slot", "keep_id", "component_id")


def table(spark, rows):
    return spark.createDataFrame([(i, t, *(list(rest) + [None] * 3)[:3]) for i, t, *rest in rows], SCHEMA)


def awkward(spark):
    words = " ".join(f"w{i % 57}x{i % 13}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same line of enough length here\nx"), (6, "same line of enough length here\nx"), (7, words, None, "hot"), (8, words, "en", "hot"), (8, words, "en", "hot"), (None, "a", "de", "hot"), (9, "déjà vu ça " * 30, "fr", "hot"), (10, "same line of enough length here", "en", None)]
    df = table(spark, rows)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_words_are_what_stands_between_ascii_spaces():
    texts = ["a\x0bb\x0cc\rd", " x\xa0y ", None, "", "\n"]
    codes, words, bounds = words_of(pa.array(texts))
    own = [[words[c].as_py() for c in codes[a:b].tolist()] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert own == [["a", "b", "c", "d"], ["x\xa0y"], [], [], []]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (30, 30)] + [(100, 100 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(500, 560)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys((1, 2, 3, 9), 1), **dict.fromkeys((20, 21, 22), 20), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(500, 561), 500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact dedup


def test_exact_duplicates(spark):
    got = exact_duplicates(awkward(spark)).collect()
    assert len(got) == 12
    rows = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got}
    assert rows == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 2, True), (None, 4, 2, False), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 3, True), (8, 7, 3, False), (9, 9, 1, True), (10, 10, 1, True)}
    assert exact_duplicates(table(spark, [])).count() == 0


def test_exact_duplicates_in_any_number_of_rounds(spark):
    df = spark.range(600).select((600 - F.col("id")).alias("doc_id"), F.concat(F.lit("t \t"), (F.col("id") % 7).cast("string")).alias("text")).repartition(23)
    for bits in (1, 3):
        got = by_id(exact_duplicates(df, bits=bits))
        assert all(r["keep_id"] == min(i for i in got if got[i]["text_sha256"] == r["text_sha256"]) for r in list(got.values())[:40])


@pytest.mark.parametrize(("bits", "exchanges"), [(1, 6), (2, 3), (3, 2), (6, 1)])
def test_a_level_of_the_tree_is_an_exchange(spark, bits, exchanges):
    docs = spark.range(2000).select((2000 - F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 90).alias("text")).repartition(64)
    runs = cut(digest_runs(docs))
    top = runs.agg(F.max("run")).first()[0]
    assert 32 <= top < 64
    merged = merge_runs(runs, bits)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == exchanges
    # a task sorts its own run once and what it got in each round, and nothing else
    assert plan.count("Sort [") == exchanges + 1
    assert {(r["keep_id"], r["group_size"]) for r in merged.collect()} == {(min(x for x in range(1, 2001) if (2000 - x) % 90 == k), len(range(k, 2000, 90))) for k in range(90)}


# sharding


@given(st.integers(1, 4), st.integers(1, 3))
def test_hilbert_curve_visits_all_cells_by_steps_of_one(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = hilbert_shards(docs, 24).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    odd = hilbert_shards(awkward(spark), 5).collect()
    assert len(odd) == 12 and {r["size"] for r in odd if r["doc_id"] in (1, 2)} == {8} and {r["text_crc32"] for r in odd if r["doc_id"] == 9} == {zlib.crc32(("déjà vu ça " * 30).encode())}
    places = sorted((r["shard"], r["slot"], r["text_crc32"]) for r in odd)
    runs = [p[2] for i, p in enumerate(places) if not i or places[i - 1][2] != p[2]]
    assert len(runs) == len(set(runs))  # equal texts stand together
    assert hilbert_shards(table(spark, []), 24).count() == 0


def test_sources_with_one_beginning_stay_apart(spark):
    names = [f"commoncrawl-2023-{i:02}" for i in range(8)]
    docs = table(spark, [(i, f"text {i:04}", "en", names[i % 8]) for i in range(400)])
    rows = hilbert_shards(docs, 8).collect()
    held = defaultdict(set)
    for r in rows:
        held[r["shard"]].add(names[r["doc_id"] % 8])
    assert len({r["curve"] for r in rows}) == 8 and all(len(x) == 1 for x in held.values())


# line dedup


def brute_lines(rows, copies=3, least=20):
    blank = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(lower)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) >= copies and i != max(held[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "short", " The same LINE of twenty letters", "the same line of twenty letters\t", "ünïcödé lïnés of twenty létt", "another line that is long enough"]), max_size=5), min_size=1, max_size=12))
def test_line_dedup(spark, docs):
    rows = [(i, "\n".join(x)) for i, x in enumerate(docs)]
    got = dedup_lines(table(spark, rows), batches=3, fanin=2).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == brute_lines(rows)


def test_line_dedup_of_awkward_rows(spark):
    df = awkward(spark)
    got = dedup_lines(df)
    assert got.columns == [*(c for c in df.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    rows = by_id(got)
    assert len(got.collect()) == 12 and rows[5]["text"] == "x" and rows[6]["n_dropped"] == 1 and rows[10]["n_dropped"] == 0 and rows[1]["text"] == "" and rows[1]["n_lines"] == 1
    assert dedup_lines(table(spark, [])).count() == 0


def test_runs_are_compacted_and_order_does_not_count(spark):
    docs = table(spark, [(i, f"a line that everybody has\nonly {i % 4} has this line of text") for i in range(16)])
    answers = []
    for parts in (id_batches(docs, 8), id_batches(docs, 8)[::-1]):
        runs = LineRuns(fanin=2)
        for p in parts:
            runs.add(p)
        assert all(len(level) < 2 for level in runs.levels)
        answers.append(sorted(map(tuple, runs.settled().collect())))
    assert answers[0] == answers[1] and len(answers[0]) == 5


def test_lines_of_documents_with_ids_of_any_order(spark):
    text = "a line that everybody has\nonly {} has this line of text"
    for kind, ids in (("string", ["b7", "a", "", "ß", "zz 1", None]), ("date", [date(2020, 1, d) for d in range(1, 6)] + [None]), ("decimal(20,2)", [Decimal(d) / 4 for d in range(5)] + [None])):
        docs = spark.createDataFrame([(i, text.format(i)) for i in ids], f"doc_id {kind}, text string")
        got = by_id(dedup_lines(docs))
        # Spark orders strings by their bytes, as these letters' code points do
        last = max(i for i in ids if i is not None)
        assert {i for i in ids if got[i]["n_dropped"] == 0} == {last} and got[last]["text"] == text.format(last), kind
        assert all(got[i]["text"] == f"only {i} has this line of text" for i in ids if i != last)


# substring dedup


def brute_windows(texts, w):
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for x in words:
        gone = {j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        out.append(" ".join(t for j, t in enumerate(x) if j not in gone))
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=8), st.integers(3, 12))
def test_substrings(spark, docs, window):
    texts = [" ".join(map(str, d)) for d in docs]
    got = by_id(remove_repeats(table(spark, list(enumerate(texts))), window))
    assert [got[i]["text"] for i in range(len(texts))] == brute_windows(texts, window)


def test_passages_that_documents_share(spark):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(3000)]
    passages = [" ".join(rng.choice(words, n)) for n in (36, 35, 34, 200)]
    texts = [" ".join([*rng.choice(words, rng.integers(0, 300)), passages[i % 4], *rng.choice(words, rng.integers(0, 50))]) for i in range(40)]
    texts += ["the " * 500, "the " * 70, "on and " * 60, None, "", texts[0], texts[0]]
    got = by_id(remove_repeats(table(spark, list(enumerate(texts))), 35))
    assert [got[i]["text"] for i in range(len(texts))] == brute_windows(texts, 35)


def test_substrings_of_awkward_rows(spark):
    got = remove_repeats(awkward(spark), 35).collect()
    assert len(got) == 12
    assert {r["n_removed"] for r in got if r["doc_id"] in (7, 8)} == {4000} and {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert remove_repeats(table(spark, []), 35).count() == 0


def test_equal_words_get_equal_symbols():
    rng = np.random.default_rng(1)
    inside = rng.integers(0, 9, 80).astype(np.uint64)
    both = [np.concatenate([rng.integers(0, 9, 30).astype(np.uint64), inside, rng.integers(0, 9, 30).astype(np.uint64)]) for _ in range(2)]
    names = np.concatenate(both)
    name, doc, low, high = parse(names, np.repeat([0, 1], 140), np.array([0, 140]), np.array([140, 280]))
    own = [{(n, a - 140 * d, b - 140 * d) for n, d, a, b in zip(name, doc, low, high, strict=True) if d == k and a - 140 * d >= 30 and b - 140 * d <= 110} for k in (0, 1)]
    assert own[0] == own[1] and own[0]


# vectors


def brute_vectors(rows, cosine):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.float32(v).astype(np.float64)
            good[k] = x / np.linalg.norm(x)
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a, b in combinations(good, 2):
        if len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
            links[a] += 1
            links[b] += 1
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return sorted(((i, links[k], find(i) if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300, [0.0] * 16), (301, None), (302, []), (303, [math.nan] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [1e-30] * 16), (306, [1e30] * 16), (307, [1.0] * 4), (308, [2.0] * 4), (None, rows[0][1]), (309, [math.inf] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string")
    for blocks, chunk in ((4, 24_000), (8, 20), (3, 1)):
        got = similar_vectors(df, 0.9, blocks=blocks, chunk=chunk).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_vectors(rows, 0.9)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert similar_vectors(df.where("false")).count() == 0


def test_pairs_that_a_block_claims_meet_in_its_stripes(spark):
    first, budgets = np.array([0, 2, 3, 4]), np.array([0.1985, 0.0005, 0.0005, 0.0005])
    s, gap = math.sqrt(0.199) / 2, 0.0238  # beyond the first block's budget, and between the second one's and its slack
    x = np.array([[math.sqrt(1 - s * s - u * u), t * s, u, 0, 0] for k in range(60) for t, u in ((1, 0.0004 * k), (-1, 0.0004 * k + gap))])
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, 1, [float(c) for c in r]) for i, r in enumerate(x)], "rep long, copies long, embedding array<float>")
    links = links_in(units_of_work(cells(df, 5, np.eye(5), first, budgets), 1000), 5, first, budgets, 0.9)
    got = {r["rep"]: r["n"] for r in links.groupBy("rep").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    n = np.sqrt((x * x).sum(axis=1))
    want = ((x @ x.T) / np.outer(n, n) >= 0.9).sum(axis=1) - 1
    assert [got.get(i, 0) for i in range(len(x))] == want.tolist()


def test_budgets_add_up():
    m = np.diag([9.0, 4.0, 1.0, 1.0, 0.0])
    rotation, first, budgets = subspaces(m, 0.9, 2)
    assert np.allclose(rotation.T @ rotation, np.eye(5)) and math.isclose(budgets.sum(), 0.2) and first.tolist() == [0, 3]


# n-gram join


def brute_jaccard(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(lower).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def near_copies(seed, many):
    """Groups of near copies of all sizes, one of them large and held together by chains only."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    rows = []
    for group, size in enumerate((many, 30, 7, 3, 2, 1, 1)):
        text = list(rng.choice(vocabulary, 70 if group else 110))
        for _ in range(size):
            own = list(text)
            for _ in range(int(rng.integers(0, 5 if group else 3))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary)).upper()
            rows.append((len(rows) * 3, " ".join(own)))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    rows = near_copies(n, 60) + [(1, None), (2, ""), (4, "one two"), (5, "ONE  two"), (7, "x"), (8, " \n ")]
    got = by_id(jaccard_components(table(spark, rows), n, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_jaccard(rows, n, percent)


def test_ngram_join_of_awkward_rows(spark):
    df = awkward(spark)
    got = jaccard_components(df, 5, 80).collect()
    assert len(got) == 12 and {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7} and {r["component_id"] for r in got if r["doc_id"] in (4, None)} == {4}
    kept = drop_similar(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]
    assert jaccard_components(table(spark, []), 4, 85).count() == 0


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((5, 3), (400, 40), (3000, 2000)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[m // 2 :], rng.integers(0, 2**64, m, dtype=np.uint64)]))
        x, y = (sketches(pa.array([set_sketch(s)], pa.binary())) for s in (a, b))
        assert least_difference(x, y)[0] <= len(np.setxor1d(a, b))


# language


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = language_samples(docs, learnable())
    assert set(samples) == {"de", "en", "es", "fr"}
    held = docs.where(~learnable())
    found = identify_languages(held, samples).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.93 * len(found)
    odd = by_id(identify_languages(awkward(spark).union(awkward(spark).limit(1).withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.lit("123 !?"))), samples))
    assert {odd[i]["lang_pred"] for i in (1, 2, 3, 99)} == {"und"} and odd[9]["lang_pred"] in samples
    assert all(r["lang_pred"] == "und" for r in identify_languages(awkward(spark), {}).collect())
    assert language_samples(table(spark, []), learnable()) == {}


# toxicity


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op1_toxicity(spark, d).join(labels, "doc_id").collect()
    hit = Counter((r["held_out"], r["toxic"], r["predicted"]) for r in rows)
    assert hit[(True, 1, 1)] > 2 * hit[(True, 0, 1)] and hit[(True, 0, 1)] <= 0.02 * hit[(True, 0, 0)]
    model = learn_toxicity(docs, labels)
    odd = score_toxicity(awkward(spark), model).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()
    none = learn_toxicity(docs, labels.where("false"))
    assert score_toxicity(docs, none).where("predicted = 1").count() == 0
    assert score_toxicity(table(spark, []), learn_toxicity(table(spark, []), labels)).count() == 0


def test_label_model_weighs_voters():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.2
    good, copy, noise = (np.where(rng.random(3000) < p, a, b) for p, a, b in ((0.9, y, ~y & False), (1, y, y), (1, rng.random(3000) < 0.2, y)))
    fired = np.stack([good, good, noise, rng.random(3000) < 0.1], axis=1).astype(np.float32)
    label = np.where(rng.random(3000) < 0.3, y.astype(float), np.nan)
    post = label_model(fired, label)
    assert ((post > 0.5) == y).mean() > 0.93 and copy.any()


# packing


def test_encoding_by_words_equals_encoding_whole():
    path = queries.word_bpe()
    known = Encoded(path)
    texts = ["a<|endoftext|>b <|EndOfText|>", " x's 'S, don't!! (\"'s) ....", "İstanbul ΟΔΟΣ Σ, é́. \xa0y\x1cz q\x85r", "", None, "  \n", "x" * 900, "a b_c-d@e.f 12,3!x ''s 're're", "Straße ÉTÉ niño", "The QUICK (brown) fox; jumps... over 13 lazy-dogs?!"]
    ids, ends = document_ids(pa.array(texts), known)
    from tokenizers import Tokenizer

    whole = [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == whole


def test_control_characters_before_punctuation_stay_with_it():
    path = queries.word_bpe()
    from tokenizers import Tokenizer

    texts = [f"{core}{chr(c)}{tail}" for core in ("abc", "A1", "", "'s") for c in (*range(9), *range(14, 32), 127) for tail in ("!!", ".", "'s", ")x;", "")]
    ids, ends = document_ids(pa.array(texts), Encoded(path))
    whole = [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == whole


@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_and_bounds(lengths):
    n = np.array(lengths, np.int64)
    bins = best_fit(n, 50)
    fill = Counter()
    for b, x in zip(bins.tolist(), lengths, strict=True):
        fill[b] += x
    assert all(v <= 50 for v in fill.values()) and set(fill) == set(range(len(fill)))
    assert lower_bound(n, 50) <= len(fill)


def test_bound_beats_the_sum():
    assert lower_bound(np.array([26] * 10), 50) == 10 and len(set(best_fit(np.array([26] * 10), 50).tolist())) == 10


@pytest.mark.parametrize("group", [3, 40, 50_000])
def test_packing(spark, group):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = pack(docs, queries.word_bpe(), 512, group=group, with_ids=True).collect()
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 512
    for places in at.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 512
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert r["start"] == len(whole[r["doc_id"]])
        whole[r["doc_id"]] += r["ids"]
    known = Encoded(queries.word_bpe())
    for r in docs.limit(30).collect():
        assert whole[r["doc_id"]] == document_ids(pa.array([r["text"]]), known)[0].tolist()
    if group > 1000:
        total = sum(r["length"] for r in rows)
        assert len(at) <= 1.01 * lower_bound(np.array([r["length"] for r in rows]), 512) + 1 and len(at) * 512 >= total
        assert all(r["certified"] for r in rows) == (len(at) == lower_bound(np.array([r["length"] for r in rows]), 512))


@pytest.mark.parametrize("parts", [2, 40])
def test_packing_fills_gaps_from_all_documents(spark, parts):
    rows = [(i, "the " * 71) for i in range(120)] + [(200 + i, "the " * 23) for i in range(120)]
    docs = table(spark, rows).repartitionByRange(parts, "doc_id")
    got = pack(docs, queries.word_bpe(), 100, group=120).collect()
    assert {r["length"] for r in got} == {72, 24} and len(got) == 240
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 100 and len(fill) == 120 == lower_bound(np.array([r["length"] for r in got]), 100)
    assert all(r["certified"] for r in got) and 0 <= min(fill) <= max(fill) < 240


def test_packing_is_certified_over_all_documents_only(spark):
    docs = table(spark, [(i, "the " * (71 if i < 40 else 23)) for i in range(80)])
    got = pack(docs, queries.word_bpe(), 100, group=40, rounds=0).collect()
    assert len({r["sequence_id"] for r in got}) == 50 and not any(r["certified"] for r in got)


def test_packing_of_awkward_rows(spark):
    rows = pack(awkward(spark), queries.word_bpe(), 4096).collect()
    assert {r["doc_id"] for r in rows} == {*range(1, 11), None} and {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 8) == 2 * sum(r["length"] for r in rows if r["doc_id"] == 7)
    assert pack(table(spark, []), queries.word_bpe()).count() == 0


# mixing


def slot_by_slot(weights, n):
    """The schedule by looking at every source's next block in every slot."""
    total, done, out = sum(weights.values()), Counter(), []
    for t in range(n):
        due = {s: Fraction(done[s] + 1) / (w / total) for s, w in weights.items() if done[s] / (w / total) < t + 1}
        s = min(due, key=lambda s: (ceil(due[s]), s))
        out.append((s, done[s]))
        done[s] += 1
    return out


@given(st.lists(st.one_of(st.integers(1, 40), st.floats(0.001, 10)), min_size=1, max_size=8), st.integers(0, 300))
def test_a_schedule_entered_anywhere_is_the_schedule(weights, at):
    own = {f"s{i}": exact(w) for i, w in enumerate(weights)}
    plan, whole = Pfair(own), slot_by_slot(own, 340)
    assert plan.done(at) == [sum(s == x for s, _ in whole[:at]) for x in plan.names]
    assert [(plan.names[i], j) for i, j in plan.slots(at, 340)] == whole[at:]


def test_a_thousand_million_blocks_need_no_list():
    weights = {"a": Fraction(12345678), "b": Fraction(23456789), "c": Fraction(34567891), "d": Fraction(1)}
    total = sum(weights.values())
    blocks = {s: int(10**9 * w / total) + 1 for s, w in weights.items()}
    plan = phases(blocks, weights)
    assert sum(length for _, _, length, _ in plan) == sum(blocks.values())
    first, _, length, _ = plan[0]
    for at in (length // 3, length - 1, length):
        done = first.done(at)
        assert sum(done) == at and all(abs(n - weights[s] / total * at) < 1 for s, n in zip(first.names, done, strict=True))


def test_listed_slots_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("lectern.llm.mixing.STRETCH", 64)
    weights = {"a": Fraction(5), "b": Fraction(3), "c": Fraction(1)}
    blocks = {"a": 900, "b": 300, "c": 150}
    got = slot_table(spark, phases(blocks, weights)).collect()
    assert sorted(r["mix_slot"] for r in got) == list(range(1350))
    assert {(r["name"], r["b"]) for r in got} == {(s, j) for s, n in blocks.items() for j in range(n)}
    order = [(r["name"], r["b"]) for r in sorted(got, key=lambda r: r["mix_slot"])]
    lasting = next(t for t, (s, j) in enumerate(order) if j + 1 == blocks[s]) + 1
    assert order[:lasting] == slot_by_slot(weights, lasting)


def lag(order, weights):
    """The most that any source is from its share of a beginning of the order."""
    total = sum(exact(w) for w in weights.values())
    done, most = Counter(), 0
    for t, s in enumerate(order, 1):
        done[s] += 1
        most = max(most, *(abs(done[x] - exact(w) * t / total) for x, w in weights.items()))
    return most


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.9, "b": 0.1}, {"a": 0.7, "b": 0.2, "c": 0.05, "d": 0.05}, {"a": 3.14159265358979, "b": 2.718281828, "c": 1}, {"a": 1, "b": 0.0001}])
def test_lag_behind_the_targets_is_below_one_over_many_periods(spark, weights):
    total = sum(weights.values())
    rows = [(1000 * k + i if k else -i, f"t{i}", None, s) for k, (s, w) in enumerate(weights.items(), 1) for i in range(ceil(3000 * w / total))]
    got = mix_sources(table(spark, rows), weights, block=1).collect()
    order = [s for _, s in sorted((r["mix_slot"], r["source"]) for r in got)]
    assert sorted(r["mix_slot"] for r in got) == list(range(len(rows)))
    assert lag(order[:2900], weights) < 1


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(900)] + [(None, None, None, None)] * 2
    df = table(spark, rows).withColumn("mix_slot", F.lit("x")).withColumn("part", F.lit(1))
    weights = {"hot": 1, "s0": 2, "s1": 1, "s2": 1, "s3": 1}
    got = mix_sources(df, weights, block=4).collect()
    assert len(got) == 902
    slot = defaultdict(set)
    size = Counter()
    for r in got:
        slot[r["mix_slot"]].add((r["source"], r["mix_source_block"]))
        size[(r["source"], r["mix_source_block"])] += 1
    assert all(len(x) == 1 for x in slot.values()) and max(size.values()) == 4
    sources = {r["source"] for r in got}
    order = [next(iter(slot[k]))[0] for k in sorted(slot)]
    target = {s: weights.get(s, 1) for s in sources}
    blocks = Counter(s for s, _ in size)
    shortest = next(t for t, s in enumerate(order) if order[: t + 1].count(s) == blocks[s])
    assert None in sources and lag(order[:shortest], target) < 1
    assert mix_sources(table(spark, [])).count() == 0


def test_mixing_keeps_shares_until_a_source_ends(spark):
    df = table(spark, [(i, "x", None, "ab"[i % 4 == 0]) for i in range(4000)])
    rows = mix_sources(df, {"a": 1, "b": 1}, block=10).collect()
    order = [s for _, s in sorted({(r["mix_slot"], r["source"]) for r in rows})]
    done = Counter()
    for t, s in enumerate(order[:180], 1):
        done[s] += 1
        assert abs(done["a"] - t / 2) < 1
    assert len({r["mix_slot"] for r in rows}) == len({(r["source"], r["mix_source_block"]) for r in rows}) == 400


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given_columns = docs.columns
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == given_columns, name
        now = docs.count()
        assert now == kept if name in ("line_dedup", "source_mixing") else 0 < now <= kept
        kept = now
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len({r["doc_id"] for r in rows}) == kept


def test_stretches_of_the_packed_output_hold_the_shares(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    size = {"a": 4000, "b": 2500, "c": 1200}
    rows = [(k * 10_000 + i, f"{s}{i} " + "the " * int(rng.integers(n // 2, n)), "en", s) for k, (s, n) in enumerate(size.items()) for i in range(1750 if s == "a" else 1600)]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    with_small_files = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in with_small_files}
    try:
        for k, v in with_small_files.items():
            spark.conf.set(k, v)
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    source = {r[0]: r[3] for r in rows}
    order = [source[r["doc_id"]] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["piece"] == 0]
    assert len(order) == len(rows)
    lasting = order[:4700]  # 1600 of each source take 4800 places
    for at in range(0, len(lasting), 470):
        found = Counter(lasting[at : at + 470])
        assert all(abs(found[s] / 470 - 1 / 3) < 0.12 for s in size), (at, found)


def test_digests(spark):
    got = queries.op5_substring_dedup(spark, SMALL).limit(3).collect()
    assert all(len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest()) for r in got)


def test_vectors_that_share_an_id_have_links_of_their_own(spark, tmp_path):
    """Ids given several times with other vectors, or without one, against the query's SQL."""
    import random

    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0)], schema)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in similar_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    rng = random.Random(4)
    rows = [(rng.randrange(150), rng.choice([None, [0.0] * 4] + [[round(rng.gauss(0, 1), 1) for _ in range(4)]] * 12), 0) for _ in range(250)]
    rows += [(i, v, 0) for (_, v, _), i in zip(rows[:60], range(140, 200), strict=True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part*.parquet")).rename(tmp_path / "embeddings.parquet")
    same(spark, str(tmp_path), queries.op2_vector_dedup, queries.ORACLE_SQL["op2_vector_dedup"])


def test_shards_and_slots_recomputed(spark):
    """Shard and slot of every row from the order alone: the curve, then the text's hash, then the id; copies of a text share a place on the curve."""
    import random

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", None, ""])) for i in range(601)] + [(700, None), (701, "")]
    docs = table(spark, rows)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = by_id(hilbert_shards(docs, 7))
    order = sorted(got, key=lambda i: (got[i]["curve"], hashes[i], i))
    n = len(order)
    for place, i in enumerate(order):
        shard = place * 7 // n
        first = next(p for p in range(n) if p * 7 // n == shard)
        assert (got[i]["shard"], got[i]["slot"]) == (shard, place - first)
    curves = defaultdict(set)
    for i, text, *_ in rows:
        curves[text or ""].add(got[i]["curve"])
        assert got[i]["size"] == len((text or "").encode()) + 8 and got[i]["text_crc32"] == zlib.crc32((text or "").encode())
    assert all(len(c) == 1 for c in curves.values())
