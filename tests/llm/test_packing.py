import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from probity.llm.packing import pack, pack_documents, step_groups
from probity.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(lengths, pieces, windows):
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.doc, p.start)):
        assert p.start == whole.get(p.doc, 0) and p.length > 0
        whole[p.doc] = p.start + p.length
    assert whole == {i: n for i, n in enumerate(lengths) if n}
    for s, window in enumerate(windows):
        mine = sorted((p for p in pieces if p.sequence == s), key=lambda p: p.offset)
        assert mine and [p.offset for p in mine] == [sum(q.length for q in mine[:i]) for i in range(len(mine))]
        assert sum(p.length for p in mine) <= window <= 1024


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_each_token_lies_in_one_piece_without_padding(lengths):
    pieces, windows = pack(lengths)
    check(lengths, pieces, windows)
    assert sum(windows) == sum(lengths) and all(w & (w - 1) == 0 for w in windows)
    groups = step_groups(pieces, windows, 4)
    if windows:
        sizes = [groups.count(g) for g in range(max(groups) + 1)]
        assert max(sizes) - min(sizes) <= 1


def test_documents(make, words):
    from tokenizers import Tokenizer

    docs = [(i, " ".join(words(3 + 40 * i, i))) for i in range(40)] + [(100, None), (101, ""), (102, "é  🙂\n\n x"), (None, "null"), (7, "again"), (7, "again"), (103, " ".join(words(20_000, 9)))]
    df = make(docs, 2)
    got = pack_documents(df, PATH, unit_tokens=20_000).collect()
    coder = Tokenizer.from_file(PATH)
    want = sorted(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    firsts = sorted(r.doc_tokens for r in got if r.start == 0)
    assert firsts == want
    expected = {}
    for d, t in docs:
        expected.setdefault(d, coder.encode(t or "", add_special_tokens=False).ids + [0])
    for r in got:
        part = expected[r.doc_id][r.start : r.start + r.length] if r.doc_id != 7 or r.doc_tokens == len(expected[7]) else None
        if part is not None:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and len(part) == r.length
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_registered_query_against_the_library(spark, sf_dir):
    """Every piece of the smallest tables: ids, cover and places."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(PATH)
    ids = {r.doc_id: coder.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op6_packing"](spark, sf_dir).collect()
    cover, places = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids[r.doc_id]))
        assert r.start == cover.get(r.doc_id, 0)
        cover[r.doc_id] = r.start + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert cover == {d: len(x) for d, x in ids.items()}
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    sizes = [sum(n for _, n in parts) for parts in places.values()]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes)


def test_empty(make):
    assert pack_documents(make([(1, "a")]).where("false"), PATH).count() == 0
