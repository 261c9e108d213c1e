"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration.

Learning. On labelled rows, the log-odds between toxic and clean text of each word, and of words' beginnings of 4 to 6
letters, is estimated with an informative Dirichlet prior (the corpus' own frequencies, ``prior`` pseudo-counts). A feature
is informative if its likelihood-ratio statistic exceeds 2 ln(number of features tested) and it occurs in
``least_documents``. A token scores the log-odds of its longest informative feature, any other a small
negative constant, so clean text drifts downwards.
Search. One linear scan over a document's tokens finds all maximal scoring segments. For clean text the best segment's
score follows an extreme-value law, P(best > x) = 1 - exp(-K n exp(-lambda x)) for n tokens: lambda solves
E[exp(lambda score)] = 1 over clean tokens, K is its maximum-likelihood value on clean documents. A
segment with K n exp(-lambda x) <= ``most_expected`` is a significant toxic passage.
Score. The evidence of a document is the sum of -log of these expectations over its significant
passages and its best one; a logistic curve fitted to labelled rows that took no part in the log-odds turns it into
a probability.

Learning uses a bounded sample: at most ``rows_per_class`` labelled documents of each class, by hash of the id.

Defined results: null and empty texts have no token and get the curve's value for no evidence. Unless the sampled
labelled rows that are found in the documents have both classes, among those to learn from and among those to calibrate with, every score
is their smoothed share of toxic ones, kept below 0.5 if these aren't the majority (so also without any). A document with several labels is toxic if one says so; null labels
and ids are ignored in learning. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, table

TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    rows_per_class: int = 12_000
    prior: float = 500.0
    least_documents: int = 3
    most_of_one: int = 4
    other: float = -0.25
    most_expected: float = 0.05


@dataclass
class Model:
    """``scores``: informative tokens. ``curve``: intercept and slope over log(1 + evidence)."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.25
    lam: float = 1.0
    k: float = 1.0
    most_expected: float = 0.05
    curve: tuple[float, float] = (0.0, 0.0)


STEMS = (6, 5, 4)


def features(word: str) -> list[str]:
    """The word and its beginnings, longest first."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class Memo(dict):
    """Score of each token met so far (None: uninformative); at most ``most`` are kept."""

    def __init__(self, scores: dict[str, float], most: int = 300_000):
        super().__init__()
        self.scores, self.most = scores, most

    def __missing__(self, token: str) -> float | None:
        if len(self) >= self.most:
            self.clear()
        found = self[token] = next((s for f in features(token.lower()) if (s := self.scores.get(f)) is not None), None)
        return found


def segments(at: Iterable[int], gains: Iterable[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token + 1, score). ``at`` holds the rising positions of
    tokens that don't score ``other`` (< 0), ``gains`` their scores; the scan is linear in their number.

    Kept is a list of candidates with the running sum left of each (low) and at its end (high), and a link to the nearest
    earlier candidate of a lower low. A new one follows the links to the nearest candidate of a lower low; if that one's high is
    less than its own, both become one, which goes on from that candidate's link. Candidates that a link leaves out are
    never looked at again, so the scan is linear however the sums fall."""
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for p, g in zip(at, gains, strict=True):
        total += other * (p - last)
        last = p + 1
        low, total = total, total + g
        if g <= 0:
            continue
        first, j = p, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, p + 1, low, total, j))
                break
            first, low, k = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = k
    return [(a, b, high - low) for a, b, low, high, _ in found]


def scan(text: str | None, m: Model, memo: Memo) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens and the document's maximal segments (in tokens)."""
    tokens = TOKEN.findall(text or "")
    got = [(i, s) for i, s in enumerate([memo[t] for t in tokens]) if s is not None]
    return len(tokens), segments([i for i, _ in got], [s for _, s in got], m.other) if got else []


def expected(n: int, score: float, m: Model) -> float:
    """Segments of at least this score that n clean tokens are expected to hold."""
    return m.k * max(1, n) * math.exp(-min(700.0, m.lam * score))


def evidence(n: int, found: list[tuple[int, int, float]], m: Model) -> float:
    each = [-math.log(expected(n, s, m)) for _, _, s in found]
    good = -math.log(m.most_expected)
    return max(0.0, sum(x for x in each if x >= good) or max(each, default=0.0))


def probability(value: float, m: Model) -> float:
    x = m.curve[0] + m.curve[1] * math.log1p(value)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def fitted_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression by Newton steps with a weak ridge."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        g = a.T @ (p - y) + 0.1 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def feature_counts(rows: DataFrame, most_of_one: int) -> DataFrame:
    """feature, toxic, clean (occurrences, at most ``most_of_one`` in a document, so that none dominates) and documents. Each task
    counts before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            held: Counter = Counter()
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own: Counter = Counter()
                for word, n in Counter(map(str.lower, TOKEN.findall(text.as_py() or ""))).items():
                    for f in features(word):
                        own[f] += n
                seen[label].update({f: min(n, most_of_one) for f, n in own.items()})
                held.update(own.keys())
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in (seen[1], seen[0], held)]],
                                             names=["feature", "toxic", "clean", "documents"])

    counts = rows.select("label", "text").mapInArrow(run, "feature string, toxic long, clean long, documents long")
    return counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "documents")])


def labelled(docs: DataFrame, labels: DataFrame, learn, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """label, text, fold (0..9 by hash) of the bounded sample, as far as ``docs`` holds it."""
    one = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & learn)
           .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")))
    one = one.withColumn("toss", F.xxhash64("_id", F.lit("toxicity")))
    ids = [r for c in (1, 0) for r in one.where(F.col("label") == c).orderBy("toss", "_id").limit(s.rows_per_class).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["_id"], r["label"], r["toss"] % 10) for r in ids], "_id long, label int, fold long")
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "_id").select("label", "text", "fold")


def learned(docs: DataFrame, labels: DataFrame, learn, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits a model on the labelled rows for which ``learn`` (a condition on the labels table) holds."""
    s = settings or Settings()
    m = Model(other=s.other, most_expected=s.most_expected)
    rows = labelled(docs, labels, learn, s, id_col, text_col)
    rows = rows.persist()
    held = {(r["label"], r["late"]): r["count"] for r in rows.groupBy("label", (F.col("fold") >= 7).alias("late")).count().collect()}
    if len(held) < 4:   # both classes, to learn from and to calibrate with
        rows.unpersist()
        toxic, n = sum(x for (label, _), x in held.items() if label), sum(held.values())
        share = (toxic + 1) / (n + 2)
        share = share if 2 * toxic > n else min(share, 0.49)
        m.curve = (math.log(share / (1 - share)), 0.0)
        return m
    counts = feature_counts(rows.where("fold < 7"), s.most_of_one).where(F.col("documents") >= s.least_documents).persist()
    all1, all0, size = counts.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    if size:
        a = F.lit(s.prior) * (F.col("toxic") + F.col("clean")) / float(all1 + all0)
        n1, n0 = all1 + s.prior, all0 + s.prior
        y1, y0 = F.col("toxic") + a, F.col("clean") + a
        odds = F.log(y1 / (n1 - y1)) - F.log(y0 / (n0 - y0))
        both, share = F.col("toxic") + F.col("clean"), all1 / float(all1 + all0)
        part = lambda y, e: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / (both * e))).otherwise(0.0)
        ratio = 2 * (part("toxic", share) + part("clean", 1 - share))
        got = counts.select("feature", odds.alias("odds"), (y0 / n0).alias("rate"), ratio.alias("ratio")).where(
            F.col("ratio") > 2 * math.log(size + 1)).collect()
        m.scores = {r["feature"]: r["odds"] for r in sorted(got, key=lambda r: r["feature"])}
        words = [r for r in got if not r["feature"].endswith("*")] or got
        m.lam = decay(np.array([r["odds"] for r in words]), np.array([r["rate"] for r in words]), s.other)
    found = map_batches(rows.where("fold >= 7").select("label", "text"), lambda b: _scanned(b, m), "label int, n long, scores array<double>")
    held = found.collect()
    counts.unpersist()
    rows.unpersist()
    if not held:
        return m
    clean = [(r["n"], max(r["scores"], default=0.0)) for r in held if not r["label"]]
    weight = sum(max(1, n) * math.exp(-m.lam * x) for n, x in clean)
    m.k = len(clean) / weight if weight else 1.0
    x = np.array([math.log1p(evidence(r["n"], [(0, 0, v) for v in r["scores"]], m)) for r in held])
    m.curve = fitted_curve(x, np.array([r["label"] for r in held], float))
    return m


def _scanned(batch: pa.RecordBatch, m: Model) -> dict:
    memo = Memo(m.scores)
    got = [scan(t.as_py(), m, memo) for t in batch.column(1)]
    return {"label": batch.column(0), "n": [n for n, _ in got], "scores": [[x for _, _, x in f] for _, f in got]}


def decay(scores: np.ndarray, rates: np.ndarray, other: float) -> float:
    """The positive lambda with E[exp(lambda score)] = 1 over clean tokens, by bisection; the other tokens have
    the rest of the mass. 1 if no token scores above 0; if clean text doesn't drift down, the least value tried."""
    if not len(scores) or scores.max() <= 0:
        return 1.0
    rest = max(0.0, 1 - float(rates.sum()))
    over = lambda lam: float((rates * np.exp(lam * scores)).sum()) + rest * math.exp(lam * other) > 1
    low, high = 1e-3, 1.0
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def toxicity(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and the significant passages (character offsets, score, expectation) of every row."""
    memo = Memo(m.scores)

    def run(batch: pa.RecordBatch) -> dict:
        score, spans = [], []
        for t in batch.column(1):
            text = t.as_py()
            n, found = scan(text, m, memo)
            score.append(probability(evidence(n, found, m), m))
            good = [(a, b, s, e) for a, b, s in found if (e := expected(n, s, m)) <= m.most_expected]
            place = [x.span() for x in TOKEN.finditer(text)] if good else []
            spans.append([{"start": place[a][0], "stop": place[b - 1][1], "score": s, "expected": e} for a, b, s, e in good])
        return {"doc_id": batch.column(0), "score": score, "predicted": [int(x >= 0.5) for x in score], "passages": spans}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double, predicted int, passages array<struct<start:int,stop:int,score:double,expected:double>>")


def without_toxic(docs: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(m.scores)
        for b in batches:
            keep = []
            for t in b.column(at):
                n, found = scan(t.as_py(), m, memo)
                keep.append(probability(evidence(n, found, m), m) < 0.5)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def corpus_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learned from the labels whose id's crc32 isn't a multiple of 5."""
    return learned(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_mod("doc_id", 5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, corpus_model(spark, docs, sf_dir))
    return found.select("doc_id", (F.coalesce(crc_mod("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
