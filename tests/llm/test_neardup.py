import random
import re

import pytest

from probity.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs):
    ids = sorted({d for d, _ in docs if d is not None})
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = [(d, sets(t)) for d, t in docs if d is not None]
    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if x and y and a != b and 100 * len(x & y) >= 75 * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return sorted(((d, len(sets(t)), root(d) if d is not None else None, d is None or root(d) == d) for d, t in docs), key=repr)


def run(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)


def edit(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "x" + str(rng.randrange(10**6))
    return out


def group(words, rng, base, ids, most):
    return [(i, " ".join(edit(base, rng, rng.randrange(most + 1)))) for i in ids]


def test_equals_brute_force(make, words):
    rng = random.Random(5)
    docs = [(i, " ".join(words(rng.randrange(5, 80), 100 + i))) for i in range(20)]
    docs += group(words, rng, words(120, 1), range(100, 160), 9)
    docs += group(words, rng, words(60, 2), range(200, 215), 2)
    docs += [(300, "One two Three"), (301, "one TWO three"), (302, "a"), (303, None), (304, ""), (305, " \n"), (None, "one two three"), (None, None)]
    docs += [(306, "É a b c d e"), (307, "é a b c d e"), (308, "a b c d e f"), (309, "A B C D E F"), (309, "A B C D E F")]
    docs += [(400, " ".join(words(8000, 7))), (401, " ".join(edit(words(8000, 7), rng, 50)))]
    assert run(make(docs)) == brute(docs)


def test_hot_lists_and_blocks_bounded_by_shingles(make, words, monkeypatch):
    """The same result where every list of over 5 texts counts as hot, and blocks hold few shingles."""
    monkeypatch.setattr(neardup, "HOT", 5)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    docs = group(words, random.Random(9), words(120, 3), range(70), 10)
    assert run(make(docs)) == brute(docs)


def test_sizes_far_apart(make, words, monkeypatch):
    """A family whose texts differ in length, cut from one text, so links join neighbouring size classes."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = words(260, 12)
    docs = [(i, " ".join(base[: 100 + 7 * (i % 23)])) for i in range(60)] + group(words, random.Random(13), base, range(100, 130), 8)
    assert run(make(docs)) == brute(docs)


def test_small_blocks(make, words, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    docs = group(words, random.Random(11), words(120, 4), range(60), 12)
    assert run(make(docs)) == brute(docs)


@pytest.mark.parametrize("rows", [[(1, "a b c")], [(1, None)]])
def test_empty_and_single(make, rows):
    assert run(make(rows).where("false")) == []
    assert [r[3] for r in run(make(rows))] == [True]


def test_keep_one_leaves_one_of_each(make, words):
    rng = random.Random(2)
    docs = group(words, rng, words(80, 5), range(12), 2) + [(50, " ".join(words(80, 6)))]
    df = make(docs)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c, k in brute(docs) if k}


def test_keep_one_of_repeated_rows(make, words):
    """One row of each id and word sequence stays; rows of one id and other words, and rows without words or id, stay as they are."""
    t, u = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = [(1, t), (1, t), (1, t.upper() + " "), (2, t), (3, u), (3, t + " " + u), (4, None), (4, None), (4, ""), (None, t), (None, t), (5, "short"), (5, "short")]
    kept = neardup.keep_one(make(rows, 5))
    assert kept.columns == make(rows).columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    want = [(1, min(t, t.upper() + " ")), (3, u), (3, t + " " + u), (4, ""), (4, ""), (4, ""), (5, "short")]
    assert got == sorted([(False, i, x) for i, x in want] + [(True, 0, t)] * 2)
    assert neardup.keep_one(make(rows).where("false")).collect() == []
