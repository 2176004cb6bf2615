"""Registered queries against their SQL on the smallest tables, and the shape of all of them."""

from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

from probity.llm.queries import ORACLES, QUERIES

CONTRACT = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_token_records": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in CONTRACT:
        assert [f"{c} {t}" for c, t in df.dtypes][: len(CONTRACT[name].split(", "))] == CONTRACT[name].split(", ")
    rows = df.collect()
    assert rows
    if name in ORACLES:
        c = duckdb.connect()
        for path in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        rel = c.sql(ORACLES[name])
        at = [list(rel.columns).index(x) for x in df.columns]
        assert sorted(map(tuple, rows), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
