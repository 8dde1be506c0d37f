"""Codes of vectors against plain loops in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.vector_codes import compress, decoded, nearest, shortlist

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]

    def choose(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[choose(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            new = list(books[p])
            for e in range(len(books[p])):
                own = [cut(kept[k][1], p) for k in range(len(kept)) if found[k][p] == e]
                if own:
                    new[e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
            books[p] = new
    out = []
    for i, v, label in kept:
        best = [choose(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], sha) for i, code, error, label in out), key=repr)


def rows_of(kind):
    rng = random.Random(3)
    if kind == "ties":  # few values, many equal distances, copies, awkward rows
        rows = [(i // 2, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
        rows += [(None, [0.25] * 8, 1), (0, None, 1), (1, [math.nan] + [0.0] * 7, 2), (2, [None] + [0.0] * 7, 2), (3, [math.inf] * 8, None)]
        return rows + [(900 + i, [0.5] * 8, 3) for i in range(700)]
    if kind == "large":  # beyond what double precision adds up exactly
        return [(i, [rng.uniform(-1, 1) * 2.0**27 for _ in range(8)], i % 3) for i in range(60)]
    return [(i, [round(rng.gauss(c, 0.1), 4) for _ in range(8)], 1) for i in range(400) for c in [i % 5]]


@pytest.mark.parametrize("kind", ["ties", "large", "clusters"])
def test_codes_equal_plain_loops(spark, kind):
    rows, scale = rows_of(kind), 1 if kind == "large" else 64
    got, books = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=2, entries=16, rounds=3, scale=scale)
    want = by_hand(rows, 2, 16, 3, scale)
    assert sorted(map(tuple, got.drop("label").collect()), key=repr) == want
    assert decoded(want[0][1], books, scale).shape == (8,)


def test_no_rows_and_odd_lengths(spark):
    for rows in ([], [(1, None, 1)]):
        got, _ = compress(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "code", "error"]
    with pytest.raises(ValueError, match="equal parts"):
        compress(spark.createDataFrame([(1, [1.0] * 7, 1)], SCHEMA))
    with pytest.raises(ValueError, match="different lengths"):
        compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], SCHEMA))
    with pytest.raises(ValueError, match="64 bits"):
        compress(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5), st.integers(1, 30), st.integers(1, 40))
def test_shortlist_holds_every_nearest_entry(seed, width, entries, n):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([2, 10, 1000]))
    book, points = rng.integers(-size, size, (entries, width)), rng.integers(-size, size, (n, width)) // int(rng.choice([1, 5]))
    lo, hi = points.min(axis=0), points.max(axis=0)
    full = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    at, distance = nearest(points, lo, hi, book)
    assert (at == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert set(full.argmin(axis=1)) <= set(shortlist(lo, hi, book).tolist())
