import zlib
from collections import Counter

from probity.llm.sharding import shard_documents


def test_law_slots_and_mixture(make):
    docs = [(i, "t" * (i % 7), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(700)]
    docs += [(None, None, "en", None), (None, "é", None, None), (5, "again"), (5, "again")]
    got = shard_documents(make(docs)).collect()
    assert len(got) == len(docs)
    shards = Counter(r.shard for r in got)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(shards[k]))
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    by = {(r.doc_id, r.source): r for r in got}
    assert by[5, "src"].text_crc32 == zlib.crc32(b"again") and by[5, "src"].size == 6
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0), (3, zlib.crc32("é".encode()))}
    assert {r.grown_shard for r in got} == {None} and {r.law for r in got} == {"rows"}


def test_order_of_input_does_not_matter(make):
    docs = [(i, "x", "en", f"s{i % 4}") for i in range(100)]
    a, b = ({(r.doc_id, r.shard, r.slot) for r in shard_documents(make(d, p)).collect()} for d, p in ((docs, 1), (docs[::-1], 5)))
    assert a == b


def test_empty_and_few(make):
    assert shard_documents(make([(1, "a")]).where("false")).count() == 0
    assert [(r.shard, r.slot) for r in shard_documents(make([(1, "a")])).collect()] == [(0, 0)]
