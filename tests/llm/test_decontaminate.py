import random

import numpy as np
import pytest

from probity.llm.decontaminate import Index, align, drop_leaks, edit_budget, find_leaks, gram_size, normal_form
from probity.llm.queries import QUERIES


def plain_best(item, text):
    """Least edits of the whole item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def edit(data, n, rng):
    out = bytearray(data)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(b"abcdefgh")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice(b"xyz"))
    return bytes(out)


def test_no_passage_within_the_budget_is_missed(words):
    rng = random.Random(4)
    items = [(i, normal_form(" ".join(words(20 + i, i)))) for i in range(12)]
    index = Index(items)
    for trial in range(150):
        k, item = rng.choice(items)
        n = rng.randrange(2 * edit_budget(len(item)) + 1)
        text = normal_form(" ".join(words(40, 50 + trial)))
        at = rng.choice([0, len(text), rng.randrange(len(text))])
        whole = text[:at] + edit(item, n, rng) + text[at:]
        found = {h[0]: h[3] for h in index.hits(whole)}
        for j, other in items:
            best = plain_best(other, whole)
            assert (j in found) == (best <= edit_budget(len(other)))
            if j in found:
                assert found[j] == best


def test_alignment_bounds():
    assert align(b"abcdefghij" * 3, b"xx" + b"abcdefghij" * 3 + b"yy", 2, 3) == (2, 32, 0)
    assert align(b"abcdefghij", b"zzzz", 1, 1) is None
    assert align(b"abcdefghij" * 3, b"zz", 1, -9) is None


@pytest.mark.parametrize("block_bytes", [10**6, 200])
def test_rows_and_filter(spark, make, words, block_bytes):
    item = " ".join(words(25, 1))
    bench = spark.createDataFrame([(1, item), (2, " ".join(words(30, 2))), (3, "short"), (4, None), (None, " ".join(words(22, 3)))], "item_id long, text string")
    docs = make([
        (1, " ".join(words(30, 9)) + " " + item.upper().replace(" ", ",\n") + " end"), (2, " ".join(words(60, 8))), (3, None), (4, ""), (5, "short"),
        (None, item), (6, " ".join(words(22, 3))), (7, " ".join(words(10_000, 7)) + " " + item),
    ])
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in find_leaks(docs, bench, block_bytes=block_bytes).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (None, 1, 0), (5, 3, 0), (6, None, 0), (7, 1, 0)], key=repr)
    clean = drop_leaks(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {2, 3, 4}
    assert {r.doc_id for r in drop_leaks(docs, bench, min_bytes=10, block_bytes=block_bytes).collect()} == {2, 3, 4, 5}


def test_empty(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make([(1, "text")])
    assert find_leaks(docs, none).count() == 0 and drop_leaks(docs, none).count() == 1
    assert find_leaks(docs.where("false"), none).count() == 0


def test_short_items_are_found_verbatim(spark, make):
    bench = spark.createDataFrame([(1, "ten bytes."), (2, "abcdefghij"), (3, "a bc"), (4, "word"), (5, "twenty three bytes in all")], "item_id long, text string")
    docs = make([(1, "so TEN  bytes it is"), (2, "xabcdefghij abcdefghijk"), (3, "x, abcdefghij"), (4, "a bcd xa bc"), (5, "(a) BC!"), (6, "word"), (7, "twenty-three bytes in all; twenty three bites in all")])
    got = sorted((r.doc_id, r.item_id, r.start, r.edits) for r in find_leaks(docs, bench).collect())
    assert got == [(1, 1, 3, 0), (3, 2, 2, 0), (5, 3, 0, 0), (6, 4, 0, 0), (7, 5, 0, 0), (7, 5, 26, 1)]
    assert {r.doc_id for r in drop_leaks(docs, bench).collect()} == {2, 4}


def test_every_region_and_any_part_size(words):
    item, other = (normal_form(" ".join(words(30, i))) for i in (1, 2))
    rng = random.Random(6)
    gap = normal_form(" ".join(words(50, 3)))
    text = b" ".join([gap, item, gap, edit(item, 3, rng), item, gap, other, item])
    index = Index([(1, item), (2, other)])
    hits = index.hits(text)
    exact = [i for i in range(len(text)) if text.startswith(item, i)]
    assert [h[1] for h in hits if h[0] == 1 and not h[3]] == exact and len(exact) == 3
    assert len([h for h in hits if h[0] == 1]) == 4 and len([h for h in hits if h[0] == 2]) == 1
    for most in (1, 7, 1000):
        assert set(index.candidates(text, most)) == set(index.candidates(text))


def test_registered_query_against_all_alignments(spark, sf_dir):
    """Every document and item of the smallest tables: linked if and only if the least edits are within the budget."""
    docs, items = ([(r[0], normal_form(r[1])) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(i, "text").collect()] for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = set()
    for d, text in docs:
        chars, ramp = np.frombuffer(text, dtype=np.uint8), np.arange(len(text) + 1)
        for k, item in items:
            e, row = edit_budget(len(item)), np.zeros(len(text) + 1, dtype=np.int64)
            # By the lemma's own premise a document without a shared gram of an (e + 1)th of the item can't hold it.
            piece = len(item) // (e + 1)
            if not any(item[i : i + piece] in text for i in range(0, len(item) - piece + 1, piece)):
                continue
            for i, c in enumerate(item, 1):
                new = np.minimum(row + 1, np.append(i, row[:-1] + (chars != c)))
                row = np.minimum.accumulate(new - ramp) + ramp
            if row.min() <= e:
                want.add((d, k, int(row.min())))
    best = {}
    for r in QUERIES["op2_decontamination"](spark, sf_dir).where("whole").collect():
        best[r.doc_id, r.item_id] = min(best.get((r.doc_id, r.item_id), 10**6), r.edits)
    assert {(*k, v) for k, v in best.items()} == want and want


def test_one_law_for_all_lengths():
    """The lemma holds at every length, and the budget never falls as an item grows."""
    budgets = [edit_budget(m) for m in range(1, 400)]
    assert budgets == sorted(budgets) and budgets[11] == 0 and budgets[12] == 1
    for m in range(1, 400):
        q, e = gram_size(m), edit_budget(m)
        assert 1 <= q <= 10 and m - q + 1 - q * e >= 1


@pytest.mark.parametrize("m", [1, 5, 9, 12, 13, 20, 23, 24, 25, 37, 49, 50])
def test_short_items_within_their_budget(m):
    rng = random.Random(m)
    item = bytes(rng.choice(b"abcdefgh") for _ in range(m))
    index, e = Index([(1, item)]), edit_budget(m)
    for n in range(2 * e + 2):
        for _ in range(20):
            text = b"zzz " + edit(item, n, rng) + b" zzz"
            found = index.hits(text)
            best = plain_best(item, text)
            if e:
                assert bool(found) == (best <= e) and all(h[3] == best for h in found)
            else:
                assert bool(found) == (b" " + item + b" " in text)


def test_single_words(spark, make):
    bench = spark.createDataFrame([(1, "qwertyuio"), (2, "a")], "item_id long, text string")
    docs = make([(1, "see qwertyuio here"), (2, "xqwertyuio"), (3, "ab a"), (4, "ab")])
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()) == [(1, 1), (3, 2)]
    assert sorted(r.doc_id for r in find_leaks(docs, bench, min_bytes=5).collect()) == [1]


def test_parts_of_items(spark, make, words):
    """A quote of 150 bytes of a long item holds a window of it, wherever it begins; one of 90 bytes none."""
    long = normal_form(" ".join(words(120, 1))).decode()
    other = " ".join(words(40, 2))
    bench = spark.createDataFrame([(1, long), (2, " ".join(words(12, 3)))], "item_id long, text string")
    docs = make([(i, f"{other} {long[a : a + 150]} {other}") for i, a in enumerate(range(0, len(long) - 150, 37))] + [(100, f"{other} {long}"), (101, f"{other} {long[200:285]} {other}")])
    got = find_leaks(docs, bench).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} - {101}
    assert [(r.doc_id, r.edits) for r in got if r.whole] == [(100, 0)] and all(r.item_id == 1 for r in got)
    assert {r.doc_id for r in find_leaks(docs, bench, part=0).collect()} == {100}
    assert {r.doc_id for r in drop_leaks(docs, bench).collect()} == {101}


def test_alignment_makes_no_arrays_for_each_character_beyond_the_row(monkeypatch):
    """What a row needs of the text is laid out once: rows are stretches of it, and none is put together anew."""
    from probity.llm import decontaminate

    made, append = [], decontaminate.np.append
    monkeypatch.setattr(decontaminate.np, "append", lambda *a: (made.append(1), append(*a))[1])
    item = b"the quick brown fox jumps over the lazy dog"
    assert decontaminate.align(item, b"so " + item.replace(b"brown", b"bown") + b" and", 3, 9) == (3, 3 + len(item) - 1, 1)
    assert not made
