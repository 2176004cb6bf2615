import math
import random
import string
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probity.llm import toxicity
from probity.llm.toxicity import drop_toxic, score_documents, segments


def plain_segments(scores, lo=0, hi=None):
    """By definition: the best segment (of equal ones the shortest), then the same left and right of it."""
    hi = len(scores) if hi is None else hi
    best = None
    for i in range(lo, hi):
        total = 0
        for j in range(i, hi):
            total += scores[j]
            if total > 0 and (best is None or (total, best[1] - best[0]) > (best[2], j + 1 - i)):
                best = (i, j + 1, total)
    if best is None:
        return []
    return plain_segments(scores, lo, best[0]) + [best] + plain_segments(scores, best[1], hi)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=25))
def test_segments_are_the_maximal_ones(scores):
    got = segments(np.array(scores, dtype=float))
    assert sorted(round(x[2], 9) for x in got) == sorted(x[2] for x in plain_segments(scores))
    assert all(round(sum(scores[s:e]), 9) == round(v, 9) for s, e, v in got)


def corpus(words, n=900):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        w, toxic = words(60, i), int(i % 8 == 0)
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["vile", "scum!", "Moron", "fool,"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, make, words):
    rows, labels = corpus(words)
    extra = [(5000, None), (5001, ""), (5002, "vile scum moron " * 3), (5003, "vile " + " ".join(words(30_000, 3))), (None, "vile scum moron fool"), (5004, "plain"), (5004, "plain")]
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_documents(make(rows + extra), truth).collect()
    assert len(got) == len(rows) + len(extra)
    tox = {d: t for d, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in tox]
    hit = sum(r.predicted == tox[r.doc_id] for r in held) / len(held)
    assert hit > 0.97 and sum(r.predicted for r in held) > 20
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.3 and by[5002].predicted == 1
    left = drop_toxic(make(rows + extra), truth)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_have_no_effect(spark, make, words):
    rows, labels = corpus(words, 300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    docs = make(rows)
    a, b = ({r.doc_id: round(r.score, 9) for r in score_documents(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_one_class_or_no_labels(spark, make):
    docs = make([(1, "a"), (2, None)])
    for labels in ([], [(1, 1, 0)], [(None, 1, 1), (2, 1, None)]):
        truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert {(r.score, r.predicted) for r in score_documents(docs, truth).collect()} == {(0.0, 0)}
        assert drop_toxic(docs, truth).count() == 2
    assert score_documents(docs.where(F.lit(False)), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_model_from_its_definition(spark, make, words):
    """Weights, lambda, location and scores of the registered way against plain loops over the training texts."""
    rows, labels = corpus(words, 300)
    truth = {d: t for d, _, t in labels}
    learnt = [(t, truth[d]) for d, t in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    seen = {0: {}, 1: {}}
    for text, label in learnt:
        held = {w.strip(string.punctuation) for w in text.lower().split()} - {""}
        for tok in held | {"^" + w[:k] for w in held for k in toxicity.PREFIXES if len(w) > k}:
            seen[label][tok] = seen[label].get(tok, 0) + 1
    size = {y: sum(t == y for _, t in learnt) for y in (0, 1)}
    strength = min(toxicity.PRIOR, len(learnt) / 10)
    want = {}
    for tok in seen[0].keys() | seen[1].keys():
        n = {y: seen[y].get(tok, 0) for y in (0, 1)}
        if sum(n.values()) >= toxicity.LEAST_DOCS:
            share = strength * sum(n.values()) / len(learnt)
            odds = {y: math.log((n[y] + share) / (size[y] + strength - n[y] - share + 1e-6)) for y in (0, 1)}
            error = math.sqrt(1 / (n[0] + share) + 1 / (n[1] + share))
            weight = math.copysign(max(abs(odds[1] - odds[0]) - toxicity.ERRORS * error, 0), odds[1] - odds[0])
            if abs(weight) >= toxicity.LEAST_WEIGHT:
                want[tok] = weight
    model = toxicity.train(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.weights.keys() == want.keys() and all(abs(model.weights[t] - want[t]) < 1e-9 for t in want)

    def plain_scores(text):
        used, out = {}, []
        for raw in text.lower().split():
            word = raw.strip(string.punctuation)
            best = max([want[t] for t in [word, *["^" + word[:k] for k in toxicity.PREFIXES if len(word) > k]] if t in want], default=0.0)
            s = best - toxicity.DRIFT
            if s > 0:
                used[raw] = used.get(raw, 0) + 1
                s = (s + toxicity.DRIFT) / used[raw] - toxicity.DRIFT
            out.append(s)
        return out

    clean = [plain_scores(t) for t, y in learnt if y == 0]
    every = np.round(np.concatenate(clean), 1)
    assert abs(np.exp(model.lam * every).mean() - 1) < 1e-3 or model.lam in (1.0, 0.05)
    top = [max([model.lam * s[2] - math.log(len(x) + 1) for s in plain_segments(x)], default=-30.0) for x in clean]
    assert abs(model.location - max(float(np.quantile(top, 0.99)), -3.0)) < 1e-6
    a, b, c = model.curve
    got = {r.doc_id: r.score for r in score_documents(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for d, text in rows[:60]:
        x = plain_scores(text)
        over = [e for e in (model.lam * s[2] - math.log(len(x) + 1) - model.location for s in plain_segments(x)) if e > 0]
        z = min(max(a + b * max(over, default=0.0) + c * math.log1p(sum(over)), -30), 30)
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 1e-6
