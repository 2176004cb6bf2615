"""Toxicity by maximum-scoring segments of token log-odds.

Training. Each token's log-odds between toxic and clean labelled documents come from the documents that hold it,
with a Dirichlet prior whose shares are the token's share of all labelled documents (so rare
tokens shrink to no evidence). Three additions of ours to the method: ``ERRORS`` standard errors are taken off and
weights under ``LEAST_WEIGHT`` dropped; a token's n-th use in one document counts 1/n, so a word repeated many times
is no pile of evidence; and tokens are words and the first four to eight characters of longer words, where a word
counts with the highest of their weights, so inflected forms share evidence. A drift taken off every token makes the
expected score of clean text negative, as the extreme-value theory of segment scores needs; lambda solves
E[exp(lambda * s)] = 1 on clean training text. ``ERRORS``, ``PRIOR``, ``DRIFT`` and ``PREFIXES`` were chosen by
threefold cross-validation inside the rows that labels are learnt from.

Scoring. The linear scan of Ruzzo and Tompa finds every maximal-scoring segment of a document.
lambda * S - ln(n) of a segment in n tokens follows an extreme-value law under clean text; its location comes from the
best segments of clean training documents. The segments over that location are the significant
ones. A logistic curve on the best one's excess and the log of all excess, fitted on the training documents, gives the score.

Labels enter from at most ``SAMPLE`` training rows, those of the lowest seeded hash: that many ids are broadcast,
so their documents are found without moving any text. These rows are written once and all of training reads
the written rows, so the documents are scanned twice: to find them, and to score. Scoring covers all documents.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import arrow_map, column, materialize, release, sliced

#: Most labelled rows that are learnt from.
SAMPLE = 50_000
#: Documents that must hold a token before it counts.
LEAST_DOCS = 3
#: Weight of the prior, in documents, and what is taken off every token.
PRIOR, DRIFT = 100.0, 0.75
#: Standard errors taken off a token's log-odds, and the least weight that then counts as evidence.
ERRORS, LEAST_WEIGHT = 0.75, 0.5
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
_MEMO = 100_000


def is_held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def token(raw: str) -> str:
    return raw.strip(string.punctuation)


def prefix_tokens(word: str) -> list[str]:
    return ["^" + word[:k] for k in PREFIXES if len(word) > k]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence of scores, in order, in linear time.

    Only stretches of positive scores can begin or end one, so the scan goes over those.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.append(0.0, np.cumsum(scores))
    breaks = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.append(0, breaks + 1)], positive[np.append(breaks, len(positive) - 1)] + 1
    kept: list[list[float]] = []  # start, end, sum before start, sum at end, index of the last with a smaller left sum
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = float(sums[s]), float(sums[e])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = int(kept[j][4])
            if j < 0 or kept[j][3] >= right:
                kept.append([s, e, left, right, j])
                break
            s, left = int(kept[j][0]), kept[j][2]
            del kept[j:]
    return [(int(k[0]), int(k[1]), k[3] - k[2]) for k in kept]


@dataclass
class Model:
    """Token weights, the extreme-value law of clean text, and the logistic curve on the evidence."""

    weights: dict[str, float]
    lam: float
    location: float
    curve: tuple[float, float, float]

    def scorer(self):
        return Scorer(self)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        z = np.clip(a + b * evidence[:, 0] + c * evidence[:, 1], -30, 30)
        return 1.0 / (1.0 + np.exp(-z))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}

    def token_scores(self, text: str | None) -> np.ndarray:
        raw = text.lower().split() if text else []
        memo = self.memo
        new = set(raw).difference(memo)
        if len(memo) + len(new) > _MEMO:
            memo.clear()
            new = set(raw)
        weights = self.model.weights
        for r in new:
            word = token(r)
            memo[r] = max((weights[t] for t in (word, *prefix_tokens(word)) if t in weights), default=0.0) - DRIFT
        scores = np.fromiter(map(memo.__getitem__, raw), dtype=np.float64, count=len(raw))
        used: dict[str, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():
            n = used[raw[i]] = used.get(raw[i], 0) + 1
            if n > 1:
                scores[i] = (scores[i] + DRIFT) / n - DRIFT
        return scores

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens, and the significant segments with the excess of each over clean text's law."""
        scores = self.token_scores(text)
        base = math.log(len(scores) + 1) + self.model.location
        found = [(s, e, self.model.lam * v - base) for s, e, v in segments(scores)]
        return len(scores), [x for x in found if x[2] > 0]

    def evidence(self, text: str | None) -> tuple[float, float, int]:
        _, found = self.passages(text)
        excess = [x for _, _, x in found]
        return max(excess, default=0.0), math.log1p(sum(excess)), len(found)


def _solve_lambda(scores: np.ndarray) -> float:
    """The positive root of E[exp(lambda * s)] = 1, or 1 where clean text has no positive score."""
    values, counts = np.unique(np.round(scores, 3), return_counts=True)
    if not len(values) or values.max() <= 0:
        return 1.0
    share = counts / counts.sum()
    lo, hi = 1e-6, 1.0
    while (share * np.exp(np.clip(hi * values, -700, 700))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(np.clip(mid * values, -700, 700))).sum() < 1 else (lo, mid)
    return max(lo, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of the labelled documents that are learnt from, at most ``sample`` labels."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    usable = usable.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~is_held_out(F.col("_id")))
    usable = usable.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = usable.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", F.col("_toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model, or the constant score where the labels hold only one class or none."""
    rows = materialize(training_rows(docs, labels, sample), "labelled")
    try:
        return _fit(rows)
    finally:
        release(rows)


def _fit(rows: DataFrame) -> Model | float:
    """``train`` on written rows (text, toxic), which are read for the counts and for the evidence of the curve."""
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            names = list(seen[0].keys() | seen[1].keys())
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[t] for t in part], pa.int64()) for c in seen]], names=["token", "clean", "toxic"])
            for c in seen:
                c.clear()

        for batch in sliced(batches):
            for text, label in zip(column(batch, "text"), column(batch, "toxic"), strict=True):
                words = {token(r) for r in set(text.lower().split())} if text else set()
                words.discard("")
                seen[label].update(words.union(*map(prefix_tokens, words)))
            if len(seen[0]) + len(seen[1]) > 150_000:
                yield from out()
        yield from out()

    counts = arrow_map(rows, count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n = float(clean + toxic)
    # Prior documents of a token in each class, and log-odds with some standard errors taken off.
    strength = min(PRIOR, n / 10)
    prior = F.lit(strength) * (F.col("c") + F.col("t")) / F.lit(n)
    log_odds = lambda k, total: F.log((F.col(k) + prior) / (F.lit(total + strength) - F.col(k) - prior + 1e-6))
    error = F.sqrt(1.0 / (F.col("t") + prior) + 1.0 / (F.col("c") + prior))
    delta = log_odds("t", float(toxic)) - log_odds("c", float(clean))
    weighted = counts.where(F.col("c") + F.col("t") >= LEAST_DOCS).select("token", (F.signum(delta) * F.greatest(F.abs(delta) - ERRORS * error, F.lit(0.0))).alias("w")).where(F.abs("w") >= LEAST_WEIGHT)
    # Tokens of at most ``SAMPLE`` documents, in LEAST_DOCS of them or more and of one-sided use: 82,000 of 68,000 rows.
    weights = {r.token: r.w for r in weighted.toLocalIterator()}
    model = Model(weights, 1.0, 0.0, (0.0, 1.0, 0.0))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            tokens, best, total, hist = [], [], [], []
            for text in column(batch, "text"):
                scores = scorer.token_scores(text)
                tokens.append(len(scores))
                values = [v for _, _, v in segments(scores)]
                best.append(values)
                values, n = np.unique(np.round(scores, 1), return_counts=True)
                hist.append([[float(v), float(k)] for v, k in zip(values, n, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("toxic")), pa.array(tokens, pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array(hist, pa.list_(pa.list_(pa.float64())))],
                names=["toxic", "tokens", "segments", "hist"],
            )

    measured = materialize(arrow_map(rows, measure, "toxic int, tokens long, segments array<double>, hist array<array<double>>"), "measured")
    steps = measured.where("toxic = 0").select(F.explode("hist").alias("h")).groupBy(F.col("h")[0].alias("v")).agg(F.sum(F.col("h")[1]).alias("n")).collect()
    lam = _solve_lambda(np.repeat([r.v for r in steps], [max(1, int(1e6 * r.n / max(1.0, sum(x.n for x in steps)))) for r in steps]))
    base = F.log(F.col("tokens") + 1)
    normal = F.transform("segments", lambda v: v * lam - base)
    top = measured.where("toxic = 0").select(F.coalesce(F.array_max(normal), F.lit(-30.0)).alias("u"))
    # A clean document in a hundred has a significant segment.
    location = top.agg(F.percentile("u", F.lit(0.99))).first()[0]
    location = 0.0 if location is None else max(float(location), -3.0)
    excess = F.filter(F.transform(normal, lambda u: u - location), lambda u: u > 0)
    points = measured.select("toxic", F.coalesce(F.array_max(excess), F.lit(0.0)).alias("m"), F.log1p(F.aggregate(excess, F.lit(0.0), lambda a, v: a + v)).alias("s"))
    got = points.groupBy("toxic", F.round("m", 2).alias("m"), F.round("s", 2).alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "m", "s").collect()
    release(measured)
    x = np.array([[r.m, r.s] for r in got])
    y = np.array([r.toxic for r in got], dtype=float)
    repeat = np.array([r.n for r in got])
    beta = _logistic(np.repeat(x, repeat, axis=0), np.repeat(y, repeat))
    return Model(weights, lam, location, tuple(float(b) for b in beta))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages.

    Only doc_id and text are read; the score depends on the text alone. A null or empty text has no segment and gets the
    curve's lowest value; a null id is not held out; repeated rows are scored alike; labels of both kinds for one
    id count as toxic; of passages of equal evidence the first counts. A very long text is scanned in time proportional to
    its length. Without labels of both classes every score is 0; an empty table gives no rows.
    """
    model = train(docs, labels, sample)
    slim = docs.select("doc_id", "text")
    if isinstance(model, float):
        return slim.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.lit(model).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_passages"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            got = [scorer.evidence(t) for t in column(batch, "text")]
            scores = sent.value.score(np.array([g[:2] for g in got], dtype=float).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(scores), pa.array([g[2] for g in got], pa.int64())], names=["doc_id", "score", "n_passages"])

    out = arrow_map(slim, run, "doc_id long, score double, n_passages long")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all its columns, whose text scores under ``THRESHOLD``.

    A row is decided by its own text, so no join is needed: the whole row passes through the scorer's batch. A null or empty text has
    the lowest score and stays, rows of a null id and repeated rows are decided by their text too; an empty table gives no rows. A very long text is
    scanned in time proportional to its length. Without labels of both classes every row stays.
    """
    model = train(docs, labels, sample)
    if isinstance(model, float):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            evidence = np.array([scorer.evidence(t)[:2] for t in column(batch, "text")], dtype=float).reshape(-1, 2)
            yield batch.filter(pa.array(sent.value.score(evidence) < THRESHOLD))

    return arrow_map(docs, run, docs.schema)
