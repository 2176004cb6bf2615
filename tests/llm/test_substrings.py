import hashlib
import random
import re

import numpy as np

from probity.llm import substrings
from probity.llm.substrings import LENGTH, repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    out = []
    held = {}
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        for i in range(len(w) - LENGTH + 1) if doc_id is not None else ():
            k = tuple(w[i : i + LENGTH])
            held[k] = min(held.get(k, doc_id), doc_id)
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - LENGTH + 1) if doc_id is not None else ():
            if held[tuple(w[i : i + LENGTH])] < doc_id:
                gone[i : i + LENGTH] = [True] * LENGTH
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeated_passages(df).collect()), key=repr)


def test_equals_brute_force(make, words):
    shared, other = words(40, 1), words(13, 2)
    docs = [
        (1, " ".join(words(30, 10) + shared + words(30, 11))),
        (2, " ".join(words(5, 12) + shared + other + words(5, 13))),
        (3, "\n".join(shared)),
        (4, " ".join(words(20, 14) + other)),
        (5, " ".join(words(20, 14) + other)),
        (6, " ".join(shared[:12])),
        (7, " ".join(shared[:13])),
        (8, None), (9, ""), (10, " \t\n"),
        (None, " ".join(shared)), (None, " ".join(words(50, 15))),
        (11, " ".join(shared + shared)), (11, " ".join(words(50, 15))),
        (12, " ".join(words(20_000, 16))), (13, " ".join(words(20_000, 16)[100:300])),
        (14, "naïve café " * 10), (15, "naïve café " * 10), (15, "naïve café " * 10),
    ]
    assert run(make(docs)) == brute(docs)


def test_empty_table(make):
    assert run(make([(1, "a")]).where("false")) == []


def test_repeats_that_part_ways(make, words, monkeypatch):
    """Passages that share a seed but go on differently, chains of partial copies, periodic texts, hot keys."""
    monkeypatch.setattr(substrings, "HOT", 3)
    rng = random.Random(4)
    base = words(60, 20)
    docs = []
    for i in range(40):
        a, n = rng.randrange(40), rng.randrange(8, 30)
        piece = base[a : a + n]
        docs.append((i, " ".join(words(rng.randrange(15), 100 + i) + piece + words(rng.randrange(15), 200 + i) + base[: rng.randrange(20)])))
    few = ["x", "y"]
    docs += [(50 + i, " ".join(rng.choice(few) for _ in range(60))) for i in range(8)] + [(70 + i, "a b c d e " * (3 + i)) for i in range(4)]
    docs += [(80, " ".join(base)), (80, " ".join(base[::-1])), (81, " ".join(base[::-1][5:30]))]
    assert run(make(docs)) == brute(docs)
    monkeypatch.setattr(substrings, "SENT", 0)
    assert run(make(docs[:25])) == brute(docs[:25])


def test_extension_by_words():
    """Each occurrence's match is as long as the words agree, and only stretches it doesn't reach are looked up."""
    words_a = [b"w%d" % i for i in range(40)]
    words_b = [b"v%d" % i for i in range(10)] + words_a[5:30] + [b"u%d" % i for i in range(10)]
    from probity.llm.common import BASE, Rolling, word_bounds

    data, starts, ends = word_bounds(words_a)
    shared = np.unique(substrings.anchors_of(Rolling(data, BASE), starts, ends))
    a, b = substrings.occurrences(words_a, shared), substrings.occurrences(words_b, shared)
    for k in range(len(b[0])):
        j = int(np.flatnonzero(a[0] == b[0][k])[0])
        one = [x[k : k + 1] for x in (b[0].view(np.int64), b[2], b[3])]
        left, right, rest = substrings.extend(*one, np.array([False]), np.array([False]), b[4][k : k + 1], a[4][j : j + 1])
        at = int(b[1][k])
        assert left[0] == min(8, at - 10) and right[0] == min(8, 35 - at - 5)
        for i, rows, _, _ in rest:
            assert len(rows) == 1 and (at - i < 10 or at - i + 13 > 35)


def test_copies_that_agree_are_not_looked_up(make, words, monkeypatch):
    """The first document of a family differs from all others everywhere; these agree with the one before them, so no row of theirs is joined by its digest."""
    text, met = words(200, 1), []
    docs = [(1, " ".join(w if i % 10 else w + "x" for i, w in enumerate(text)))]
    docs += [(k, " ".join(text + words(20, 100 + k))) for k in range(2, 42)]
    plain = substrings._paired

    def counted(rows, one, keys):
        out = plain(rows, one, keys)
        if keys == ["w1", "w2"]:
            met.append(out.where("doc > lo").count())
        return out

    monkeypatch.setattr(substrings, "_paired", counted)
    assert run(make(docs)) == brute(docs)
    assert len(met) == 1 and met[0] <= 40
