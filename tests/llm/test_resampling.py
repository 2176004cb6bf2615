import hashlib
import math
import re
import zlib

import pytest

from probity.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, grams=1, buckets=10_000, least=20, percent=10, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, grams)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, grams)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        w, f = features(text, grams)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    open_ = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(open_[: percent * len(open_) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def run(docs, target, **kw):
    return sorted((tuple(r) for r in resample(docs, target, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(words):
    docs = [(i, " ".join(words(5 + i % 60, i))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "--- \x00 ---"), (203, "Übergröße NAÏVE ÀB " * 30), (204, " ".join(words(60_000, 9))), (-5, "A1b2 " * 25), (None, "the word " * 15)]
    return docs, [" ".join(words(40, 1000 + i)) for i in range(10)] + [None, ""]


@pytest.mark.parametrize("setting", [{}, {"grams": 3, "buckets": 97, "percent": 50, "least": 3, "seed": 7}])
def test_equals_brute_force(setting, corpus, make, spark):
    docs, target = corpus
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    named = {"least": "least_words"}
    assert run(make(docs), table, **{named.get(k, k): v for k, v in setting.items()}) == brute(docs, target, **setting)


def test_ties_and_repeated_rows(make, spark, words):
    """Rows of one id and text tie; each is drawn, and ranks have no gaps whatever the partitions."""
    text = " ".join(words(30, 5))
    docs = [(7, text)] * 400 + [(i, " ".join(words(25, i))) for i in range(200)]
    table = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = run(make(docs, 9), table, percent=80)
    assert got == brute(docs, [text], percent=80)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 481))


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = [(1, "some words " * 20), (2, None)]
    assert run(make(docs), none, percent=100) == brute(docs, [], percent=100)
    assert run(make(docs).where("false"), none) == []


def test_column_names(make, spark):
    """Columns of inner names are not read, and the id and text may have other names."""
    df = make([(1, "a b c " * 10)]).withColumnsRenamed({"doc_id": "_bucket", "text": "_row"})
    got = resample(df, df, "_bucket", "_row", "_row", percent=100)
    assert got.columns == ["_bucket", "n_features", "weight", "score", "rank"] and got.count() == 1
