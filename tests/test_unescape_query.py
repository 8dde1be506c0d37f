from pyspark.sql import functions as F

from lectern.plans import catalog

LINES = ["plain", "año días", "Straße", "", r"own \n and \t", r"año \\ b", r"bad \x", r"c:\users\é", "日本", r"\xc3\xb1 ñ"]


def brute(line):
    text = line + r"\n\t caf\xc3\xa9"
    try:
        return text.encode("utf-8").decode("unicode_escape").encode("latin-1").decode("utf-8")
    except UnicodeError:
        return text


def lines(spark, monkeypatch):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)], "paper_id long, seq int, text string")
    monkeypatch.setattr(catalog.fx, "passages", lambda spark, sf: df)


def test_every_line_is_resolved(spark, monkeypatch):
    lines(spark, monkeypatch)
    got = {r["seq"]: r["text"] for r in catalog.e12_unescape(spark, "").collect()}
    assert got == {i: brute(x) for i, x in enumerate(LINES)}


def test_no_line_goes_around_the_operator(spark, monkeypatch):
    lines(spark, monkeypatch)
    monkeypatch.setattr(catalog.tx, "unescape_text", lambda text: F.lit("operator"))
    assert [r["text"] for r in catalog.e12_unescape(spark, "").collect()] == ["operator"] * len(LINES)
