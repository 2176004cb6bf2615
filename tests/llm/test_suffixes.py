import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from probity.llm import suffixes
from probity.llm.suffixes import LENGTH, keep, merge_sort, repeated_bytes, suffix_order


def brute(docs):
    texts = [(t or "").encode() for _, t in docs]
    held = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    rows = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if held[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(rows, key=repr)


def run(df):
    return sorted((tuple(r) for r in repeated_bytes(df).collect()), key=repr)


def text(n, seed, letters="abcdefgh "):
    return "".join(random.Random(seed).choices(letters, k=n))


EDGES = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 300), (None, text(500, 1)), (None, text(500, 1)), (7, text(100, 2) + text(199, 3)), (8, text(199, 3)), (9, text(200, 4)), (10, text(90, 5) + text(200, 4) + text(90, 6)), (11, "é" * 150 + text(50, 7)), (12, text(50, 8) + "é" * 150)]


def test_equals_brute_force(make):
    shared = text(330, 20)
    docs = EDGES + [(20 + i, text(50 + 7 * i, 30 + i) + shared[3 * i :] + text(80, 60 + i)) for i in range(20)]
    docs += [(50, text(400, 90) + text(300, 91) + text(100, 92) + text(300, 91)), (51, text(30_000, 93)), (52, text(30_000, 93)[700:1_100]), (53, text(600, 94)), (53, text(600, 94)), (53, text(700, 95))]
    assert run(make(docs)) == brute(docs)


@pytest.mark.parametrize("seed", range(3))
def test_dealt_anchors_and_parts(make, monkeypatch, seed):
    """Frequent strings in small groups, hot keys sent around, texts in parts, strings of few letters."""
    import probity.llm.common as common

    monkeypatch.setattr(suffixes, "GROUP", 4)
    monkeypatch.setattr(suffixes, "PART", 700)
    monkeypatch.setattr(common.paired, "__defaults__", (2, 50_000))
    rng = random.Random(seed)
    base = text(900, 100 + seed)
    docs = list(EDGES)
    for i in range(60):
        a, n = rng.randrange(600), rng.randrange(150, 400)
        docs.append((100 + i, text(rng.randrange(120), 200 + i) + base[a : a + n] + text(rng.randrange(120), 300 + i) + base[: rng.randrange(260)]))
    docs += [(200 + i, "".join(rng.choice("xy") for _ in range(30)) * (8 + i)) for i in range(6)] + [(300 + i, text(2_500, 400)) for i in range(9)]
    assert run(make(docs)) == brute(docs)


def test_hot_passage_is_spread(make):
    """A passage that all texts hold and that goes on differently everywhere."""
    passage = text(260, 1)
    docs = [(i, text(60, 1000 + i) + passage + text(60, 5000 + i)) for i in range(300)]
    assert run(make(docs, 7)) == brute(docs)


def test_empty_table(make):
    assert run(make([(1, "a")]).where("false")) == []


def test_merge_sort_and_common_extensions():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 9, n)
        order = merge_sort(n, lambda a, b, v=values: np.sign(v[a] - v[b]))
        assert order.tolist() == sorted(range(n), key=lambda i: values[i])  # stable
        letters, group = rng.integers(1, 3, (n, 12)).astype(np.int16), np.sort(rng.integers(0, 3, n))
        for row in range(n):
            letters[row, rng.integers(3, 13) :] = 0
        order, shared = suffix_order(group, letters)
        rows = [(group[i], bytes(letters[i].tolist())) for i in order]
        assert rows == sorted(rows)
        for k in range(1, n):
            (g, a), (h, b) = rows[k - 1], rows[k]
            a, b = a.rstrip(b"\0"), b.rstrip(b"\0")
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == (same if g == h else 0)


def test_collisions_are_seen(monkeypatch):
    """Hashes under which all bytes are alike: the check by bytes turns to another base, or refuses."""
    letters, group = np.array([[1, 2, 3], [1, 3, 2], [1, 2, 2]], dtype=np.int16), np.zeros(3, dtype=np.int64)
    right, real = suffix_order(group, letters), suffixes.prefix_hashes
    first = suffixes._BASES[0]
    monkeypatch.setattr(suffixes, "prefix_hashes", lambda x, base: real(np.ones_like(x), base) if base == first else real(x, base))
    got = suffix_order(group, letters)
    assert got[0].tolist() == right[0].tolist() and got[1].tolist() == right[1].tolist() == [0, 2, 1]
    monkeypatch.setattr(suffixes, "prefix_hashes", lambda x, base: real(np.ones_like(x), base))
    with pytest.raises(RuntimeError):
        suffix_order(group, letters)


def test_keep():
    assert keep(b"0123456789", np.array([5, 1, 2]), np.array([7, 3, 5])) == (b"0789", 6, 1)
    assert keep(b"0123456789", np.array([0, 8]), np.array([2, 10])) == (b"234567", 4, 2)
