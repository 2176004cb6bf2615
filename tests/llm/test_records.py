import random
import struct
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from probity.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_in_id_order(make, words, tmp_path):
    from tokenizers import Tokenizer

    docs = [(i * 5, " ".join(words(3 + 30 * i, i))) for i in range(40)] + [(1000, None), (1001, ""), (1002, "É x  y\n"), (None, "null"), (1003, "same"), (1003, "same"), (1004, " ".join(words(20_000, 5)))]
    manifest = records.write_records(make(docs), PATH, 2, f"file://{tmp_path}/r")
    got = records.read_records(manifest).collect()
    coder = Tokenizer.from_file(PATH)
    start, want = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d or 0, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == want


def test_reads_in_any_order_and_finds_damage(make, words, tmp_path):
    docs = [(i, " ".join(words(20, i))) for i in range(20)]
    row = records.write_records(make(docs, 1).coalesce(1), PATH, 2, f"file://{tmp_path}/r").first()
    index = records.read_index(f"{row.folder}/{row.index_file}")
    ends = [*index["offset"][1:].tolist(), row.n_bytes]
    order = list(range(len(index)))
    random.Random(1).shuffle(order)
    for i in order:
        doc_id, ids = records.ids_of(records.read_at(f"{row.folder}/{row.record_file}", int(index["offset"][i]), int(ends[i] - index["offset"][i])))
        assert doc_id == index["doc_id"][i] and len(ids) == 4 * index["tokens"][i]
    path = tmp_path / "r" / row.record_file
    data = bytearray(path.read_bytes())
    for at in (0, 20):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(records.CorruptRecord):
            records.unframe(bytes(broken[: ends[0]]))
    with pytest.raises(records.CorruptRecord):
        records.unframe(bytes(data[: ends[0] - 1]))


def test_empty(make, tmp_path):
    manifest = records.write_records(make([(1, "a")]).where("false"), PATH, 2, f"file://{tmp_path}/r")
    assert records.read_records(manifest).count() == 0


def test_wide_ids():
    ids = struct.pack("<3I", 1, 70_000, 5)
    assert records.ids_of(records.payload_of(9, ids, 4)) == (9, ids)
