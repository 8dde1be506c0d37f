"""Rows and their headers, and the counts of a pair, with as few exchanges as they need."""

from pyspark.sql import functions as F

from lectern.operators import retrieve as rt
from lectern.operators import tables as tb


def shuffles(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_meet_their_headers_once(spark):
    """Columns with gaps in their headers, without one, and tables without any head."""
    head = [(1, 0, "head", 0, 0, "a"), (1, 0, "head", 1, 0, "x"), (1, 0, "head", 0, 2, "c"), (1, 1, "head", 0, 0, "h"), (1, 1, "head", 0, 1, None)]
    body = [(1, 0, "body", r, k, f"{r}{k}") for r in range(2) for k in (2, 0, 1)] + [(1, 1, "body", 0, k, None) for k in range(3)] + [(2, 0, "body", 0, 0, "z")]
    grid = spark.createDataFrame(head + body, "paper_id long, table_seq int, part string, r int, c int, text string")
    got = {tuple(r) for r in tb.verbalise_rows(grid).collect()}
    assert got == {(1, 0, 0, "a x: 00\n: 01\nc: 02"), (1, 0, 1, "a x: 10\n: 11\nc: 12"), (1, 1, 0, "h: \n: \n: "), (2, 0, 0, ": z")}
    plan = shuffles(tb.verbalise_rows(grid.withColumn("text", F.coalesce("text", F.lit("")))))
    assert "c#" not in "".join(line.split("Join")[1].split("]")[0] for line in plan.splitlines() if "Join [" in line), "cells are joined one by one"


def test_a_pair_is_counted_once_for_counters_and_summary(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "paper_id long, variant_id int")
    found = spark.createDataFrame([(1, 1, 0, True, False, True, "form"), (1, 1, 1, False, True, False, "form"), (2, 1, 0, False, False, False, "position")], "paper_id long, variant_id int, chunk_seq int, by_dna boolean, by_long boolean, by_short boolean, match_kind string")
    variants = spark.createDataFrame([(1, "L1R"), (2, None)], "variant_id int, pshort string")
    one = rt.match_summary(pairs, found)
    both = rt.match_counters(pairs, found).join(rt.retrieval_summary(pairs, found, variants).drop("short_form"), ["paper_id", "variant_id"])
    assert sorted(map(tuple, one.select(*both.columns).collect())) == sorted(map(tuple, both.collect()))
    assert shuffles(one).count("Scan") == 2
