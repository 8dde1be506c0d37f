"""Toxicity: many weak voters, a generative label model over them, and a linear classifier on its posterior labels."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, remainder, slices, text_of, words_of

#: Fixed lexicon: common English insults and threats.
INSULTS = ("idiot", "idiots", "moron", "stupid", "dumb", "loser", "losers", "pathetic", "scum", "trash", "worthless", "disgusting", "clown", "jerk", "imbecile", "filth", "vermin", "hate", "kill", "die")
#: Patterns of single words: shouting, drawn-out letters, masked letters, piled-up marks.
PATTERNS = {"shout": r"^\P{Ll}*\p{Lu}{3,}\P{Ll}*$", "drawn": r"(\p{L})\1\1", "masked": r"\p{L}[*@$#]+\p{L}", "marks": r"[!?]{2,}"}
PREFIXES = (4, 5, 6)
#: Words whose voters a Python worker remembers, twice: those met lately, and those before them.
WORDS = 50_000
EDGE = string.punctuation
#: Columns of totals() beside the voters.
TOTALS = 3


def terms_of(word: str) -> list[str]:
    """The terms a word speaks for: itself in lower case without punctuation at its ends, and its beginnings."""
    core = word.strip(EDGE).lower()
    return [core, *(f"{core[:n]}-" for n in PREFIXES if len(core) > n)] if core else []


@dataclass
class Model:
    """Voters (terms, then patterns) and a linear classifier over them."""

    terms: dict[str, int]
    weights: np.ndarray
    bias: float

    @property
    def voters(self) -> int:
        return len(self.terms) + len(PATTERNS)


class Voters:
    """The voters of a set of terms: the numbers of those that fire for a word, remembered for words met lately."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.tests = [regex.compile(p) for p in PATTERNS.values()]
        self.begin = [(n, {t[:-1]: i for t, i in terms.items() if len(t) == n + 1 and t[-1] == "-"}) for n in PREFIXES]
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        core = word.strip(EDGE)
        low = core.lower()
        own = [begin[low[:n]] for n, begin in self.begin if len(low) > n and low[:n] in begin]
        if low in self.terms:
            own.append(self.terms[low])
        n = len(self.terms)
        if core.isalpha() and core[1:].islower():  # no shout, and no mark between letters
            if len(core) > 2 and self.tests[1].search(core):
                own.append(n + 1)
            if ("!" in word or "?" in word) and self.tests[3].search(word):
                own.append(n + 3)
        else:
            own += [n + k for k, t in enumerate(self.tests) if t.search(word)]
        return tuple(own)

    def of_all(self, words: list[str]) -> list[tuple[int, ...]]:
        recent, older = self.recent, self.older
        out = [recent.get(w) for w in words]
        for i in [i for i, x in enumerate(out) if x is None]:
            w = words[i]
            found = older.get(w)
            out[i] = recent[w] = self.of(w) if found is None else found
        if len(recent) > WORDS:
            self.older, self.recent = recent, {}
        return out


def votes(texts: pa.Array, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which voters fire in which texts: (text, voter, times) and the number of words of each text."""
    codes, words, bounds = words_of(texts)
    found = voters.of_all(words.to_pylist())
    n, m = len(bounds) - 1, len(voters.terms) + len(PATTERNS)
    many = np.fromiter(map(len, found), np.int64, len(found)) if found else np.zeros(1, np.int64)
    what = np.array([v for own in found if own for v in own], np.int64)
    first = np.cumsum(many) - many
    at = np.flatnonzero(many[codes]) if len(codes) else np.zeros(0, np.int64)
    hits = many[codes[at]] if len(codes) else np.zeros(0, np.int64)
    k = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
    voter = what[np.repeat(first[codes[at]], hits) + k] if len(k) else np.zeros(0, np.int64)
    text = np.repeat(np.searchsorted(bounds, at, side="right") - 1, hits)
    key, times = np.unique(text * m + voter, return_counts=True)
    return key // m, key % m, times, np.diff(bounds).reshape(n)


def mine_terms(sample: DataFrame, most: int = 400, least: int = 3) -> list[str]:
    """Terms that speak for label 1: by odds and likelihood ratio over the labelled documents that hold them, `most` at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            term, toxic = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {t for w in set((text or "").split()) for t in terms_of(w)}
                term += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int64())], ["term", "toxic"])

    labelled = sample.where("toxic IS NOT NULL").select("text", F.col("toxic").cast("long").alias("toxic"))
    ones, all_ = labelled.agg(F.sum("toxic"), F.count("*")).first()
    if not ones or ones == all_:
        return []
    p, q = F.col("p"), F.col("n") - F.col("p")
    odds = F.log((p + 0.5) / (ones + 1.0)) - F.log((q + 0.5) / (all_ - ones + 1.0))
    base = ones / all_
    against = F.when(q > 0, q * F.log(q / (F.col("n") * (1 - base)))).otherwise(0.0)
    ratio = 2 * (p * F.log(p / (F.col("n") * base)) + against)
    counted = labelled.mapInArrow(spread, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where(p >= least)
    good = counted.withColumn("ratio", ratio).where((odds > 2.0) & (F.col("ratio") > 20.0))
    found: dict[tuple[int, int], list[str]] = {}
    for r in good.orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(4 * most).collect():
        # of terms in the same documents as far as the counts tell, the longest speaks for its beginnings
        same = found.setdefault((r["p"], r["n"]), [])
        if not any(t.startswith(r["term"].rstrip("-")) for t in same):
            same.append(r["term"])
    return [t for same in found.values() for t in same][:most]


def label_model(fired: np.ndarray, label: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior chance of label 1 for each row, by EM over a generative model of the voters.

    fired: rows by voters, 0 or 1. label: 1, 0, or nan where unknown; a known
    label is one more voter with an accuracy of its own. Each round estimates
    how often a voter fires under either label and how voters correlate given
    the label; a voter's evidence is divided by one plus its correlations, so
    that voters saying the same thing do not count twice.
    """
    known = ~np.isnan(label)
    some = fired.any(axis=1)
    post = np.where(known, np.where(label == 1, 0.97, 0.03), np.where(some, 0.5, 0.05))
    accuracy = 0.95
    for _ in range(rounds):
        rate = [(w.astype(np.float32) @ fired + 0.05) / (w.sum() + 1.0) for w in (1 - post, post)]
        rest = fired - np.stack([1 - post, post], axis=1).astype(np.float32) @ np.stack(rate).astype(np.float32)
        both = (rest.T @ rest).astype(np.float64) / len(rest)
        scale = np.sqrt(np.diag(both)) + 1e-6
        corr = both / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        logit = np.log(prior / (1 - prior)) + fired @ (share * (on - off)).astype(np.float32) + (share * off).sum()
        says = np.log(accuracy / (1 - accuracy))
        logit = logit + np.where(known, np.where(label == 1, says, -says), 0)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if known.any():
            agree = np.where(label == 1, new, 1 - new)[known].mean()
            accuracy = float(np.clip(agree, 0.8, 0.99))
        if np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


def features(text: np.ndarray, voter: np.ndarray, times: np.ndarray, words: np.ndarray, m: int) -> np.ndarray:
    """Dense rows: 1 for each voter that fires, then the totals."""
    x = np.zeros((len(words), m + TOTALS), np.float32)
    x[text, voter] = 1
    x[:, m:] = totals(text, voter, times, words, m)
    return x


def totals(text: np.ndarray, voter: np.ndarray, times: np.ndarray, words: np.ndarray, m: int) -> np.ndarray:
    """Logs of the firings of terms, of the terms that fire, and of the firings in a thousand words."""
    own = voter < m - len(PATTERNS)
    fired = np.bincount(text[own], weights=times[own], minlength=len(words))
    return np.log1p(np.stack([fired, np.bincount(text[own], minlength=len(words)), 1000 * fired / np.maximum(words, 20)], axis=1))


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30).astype(np.float64)))
        curve = (x.T * (p * (1 - p) + 1e-6).astype(x.dtype)) @ x
        step = np.linalg.solve(curve + np.diag(penalty), x.T @ (target - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def threshold_shift(x: np.ndarray, target: np.ndarray, label: np.ndarray, threshold: float, folds: int = 4) -> float:
    """What to add to the logits so that `threshold` parts the given labels best, by F1 on folds that the fit has not seen; label is nan where unknown."""
    logit = np.zeros(len(x))
    fold = np.arange(len(x)) % folds
    for k in range(folds):
        w, b = fit_linear(x[fold != k], target[fold != k])
        logit[fold == k] = x[fold == k] @ w + b
    logit, true = logit[~np.isnan(label)], label[~np.isnan(label)] == 1
    if not true.any():
        return 0.0
    order = np.argsort(-logit)
    true = true[order]
    hits = np.cumsum(true)
    f1 = 2 * hits / (np.arange(1, len(true) + 1) + true.sum())
    k = int(np.argmax(f1))
    edge = (logit[order[k]] + logit[order[min(k + 1, len(true) - 1)]]) / 2
    return float(np.log(threshold / (1 - threshold)) - edge)


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 9_000, threshold: float = 0.7) -> Model:
    """A model from the rows that may teach: crc32 of the id as text modulo 3 is not 1.

    At most about `sample` labelled documents, and half as many without a
    label, are taken by a hash of the id; that is the bound of the fit, whatever
    the input. Terms are mined from the labelled ones, the label model runs over
    the votes of both, and the classifier is fitted to its posteriors and shifted so
    that `threshold` parts them best.
    """
    told = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    teach = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    total, n = docs.where(teach).select("doc_id").join(told, "doc_id", "left").agg(F.count("*"), F.count("toxic")).first()
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    share = sample / max(1, n)
    rest = sample / 2 / max(1, total - n)
    rows = docs.where(teach & (place < max(share, rest))).select("doc_id", text_of().alias("text")).join(told, "doc_id", "left")
    rows = cut(rows.where(place < F.when(F.col("toxic").isNull(), rest).otherwise(share)).select("text", "toxic"))
    terms = {t: i for i, t in enumerate(dict.fromkeys([*INSULTS, *mine_terms(rows)]))}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in slices(batches):
            text, voter, times, words = votes(batch.column("text"), voters)
            cut_at = np.searchsorted(text, np.arange(len(words) + 1))
            lists = [[c[a:b].tolist() for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)] for c in (voter, times)]
            yield pa.RecordBatch.from_arrays([pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int64())), pa.array(words), batch.column("toxic").cast(pa.float64())], ["voter", "times", "words", "toxic"])

    got = rows.mapInArrow(vote, "voter array<long>, times array<long>, words long, toxic double").collect()
    m = len(terms) + len(PATTERNS)
    if not got:
        return Model(terms, np.zeros(m + TOTALS), -3.0)
    text = np.repeat(np.arange(len(got)), [len(r["voter"]) for r in got])
    voter = np.array([v for r in got for v in r["voter"]], np.int64)
    times = np.array([t for r in got for t in r["times"]], np.int64)
    words = np.array([r["words"] for r in got], np.int64)
    label = np.array([np.nan if r["toxic"] is None else r["toxic"] for r in got])
    x = features(text, voter, times, words, m)
    target = label_model(x[:, :m], label)
    weights, bias = fit_linear(x, target)
    return Model(terms, weights, bias + threshold_shift(x, target, label, threshold))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, n_votes) for each document, from its whole text.

    score is the classifier's chance of label 1; predicted is 1 from `threshold`
    on. A null or empty text has no votes and gets the low score of such texts.
    Repeated rows each get their own result. Other columns are not read.
    """
    terms, weights, bias, m = model.terms, model.weights, model.bias, model.voters

    key = f"voters-{hash(tuple(terms.items()))}"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = held(key, lambda: Voters(terms))
        for batch in slices(batches, holds=key):
            text, voter, times, words = votes(batch.column("text"), voters)
            n = len(words)
            logit = bias + np.bincount(text, weights=weights[voter], minlength=n) + totals(text, voter, times, words, m) @ weights[m:]
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.bincount(text, minlength=n))], ["doc_id", "score", "predicted", "n_votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, predicted int, n_votes long")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those whose text scores at or above `threshold`; all columns stay. Rows repeated with one id share their fate."""
    bad = score_toxicity(docs, learn_toxicity(docs, labels, threshold=threshold), threshold).where("predicted = 1").select("doc_id").distinct()
    gone = bad.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
