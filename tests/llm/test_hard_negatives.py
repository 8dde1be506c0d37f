"""Hard negatives against trying every row, and the order in which cells are visited."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import hard_negatives
from lectern.llm.hard_negatives import Cells, in_order, mine, visit

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, scale, positives, negatives, every):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (anchor, v, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, own) for b, (i, w, own) in enumerate(kept) if b != a]
        near, far = sorted((s for s in scored if s[2] == label), key=key)[:positives], sorted((s for s in scored if s[2] != label), key=key)
        for score, i, _ in near:
            own = [s for s in far if 30 * score <= 100 * s[0] <= 90 * score][:negatives]
            out += [(anchor, i, rank + 1, j, score, s) for rank, (s, j, _) in enumerate(own)]
    return sorted(out, key=repr)


def rows_of(kind):
    rng = random.Random(11)
    if kind == "ties":  # small whole numbers, many equal scores, copies, a rare label, awkward rows
        rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)], rng.choice([0, 1, 1, 1])) for i in range(400)]
        rows += [(10, [1.0] * 6, 1), (10, [1.0] * 6, 1), (None, [1.0] * 6, 0), (None, [0.5] * 6, 0), (20, [1.0] * 6, 7), (30, [1.0] * 6, None), (40, None, 1), (50, [None] + [1.0] * 5, 1), (60, [math.nan] * 6, 1)]
        return rows + [(1000 + i, [0.5, 1.0] * 3, 1) for i in range(300)]
    return [(i, [rng.gauss(i % 7, 1) / 8 for _ in range(9)], rng.choice([0, 0, 1, 2, i % 7])) for i in range(900)]


@pytest.mark.parametrize("kind", ["ties", "clusters"])
@pytest.mark.parametrize("first", [40, 100_000])
def test_mined_equals_trying_all(spark, monkeypatch, kind, first):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 10)
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("rid", "whole", "cell", "rank", "score", "low"):
        df = df.withColumn(c, F.lit("own"))
    got = mine(df, scale=16, positives=3, negatives=4, anchor=lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, 16, 3, 4, 10)


def test_asks_are_not_broadcast(spark, monkeypatch):
    """Their size is anchors times cells, which no estimate from the anchors shows."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 10)
    plans, looked_at = [], hard_negatives.looked_at

    def told(*args):
        found = looked_at(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(hard_negatives, "looked_at", told)
    assert mine(spark.createDataFrame(rows_of("clusters"), SCHEMA), scale=16, anchor=lambda i: i % 10 == 0).count()
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("scale", [16, 1 << 16, 1 << 26])
def test_components_of_any_size(spark, monkeypatch, scale):
    """They travel as the narrowest whole numbers that hold them, and scores stay exact."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 10)
    rows = rows_of("clusters")[:300]
    got = mine(spark.createDataFrame(rows, SCHEMA), scale=scale, positives=3, negatives=4, anchor=lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, scale, 3, 4, 20)


def test_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0], None), (2, None, 1)]):
        got = mine(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(ValueError, match="different lengths"):
        mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 1.0], 1)], SCHEMA))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9), st.lists(st.integers(-5, 5), min_size=1, max_size=9))
def test_pairs_come_once_by_falling_sum(one, two):
    got = list(in_order(np.array(one, float), np.array(two, float)))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(len(one)) for j in range(len(two))]
    sums = [t for t, _, _ in got]
    assert sums == sorted(sums, reverse=True) and all(t == one[i] + two[j] for t, i, j in got)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(-40, 40), st.integers(-40, 40))
def test_cells_left_out_hold_nothing_wanted(seed, a, b):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-4, 5, (80, 4)).astype(float), [rng.normal(size=(3, 2)) * 3 for _ in range(2)]
    at, radius = zip(*(hard_negatives.closest(x[:, 2 * h : 2 * h + 2], book[h]) for h in range(2)), strict=True)
    radii = tuple(np.array([radius[h][at[h] == e].max(initial=0) for e in range(3)]) for h in range(2))
    cell = at[0] * 3 + at[1]
    anchor, low, high = x[0].astype(np.int64), min(a, b), max(a, b)
    found, _ = visit(Cells(tuple(book), radii, np.bincount(cell, minlength=9)), anchor, np.zeros(9, bool), low, high, None)
    score = x @ anchor
    assert set(cell[(score >= low) & (score <= high)]) <= set(found)
