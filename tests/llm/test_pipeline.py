"""Every stage on its own input, against plain code or the operator's own tested result."""

from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from probity.llm.neardup import near_duplicates
from probity.llm.toxicity import score_documents
from probity.llm.lines import drop_boilerplate


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = kept["toxicity"]
    bad = {r.doc_id for r in score_documents(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = kept["line_dedup"]
    want = {r.doc_id: r.text for r in drop_boilerplate(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_duplicates(before).where("kept").collect()}
    before, after = kept["decontamination"]
    plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before.collect() if any(i in plain(r.text) for i in items if len(i) >= 24)}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert dirty <= gone and len(gone - dirty) <= 1
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    for r in after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect():
        assert r["sum(length)"] == r["max(doc_tokens)"]


def test_stages_against_plain_code(spark, sf_dir, tmp_path):
    """Line dedup, near-dedup and packing on their own inputs, by loops over all rows."""
    from tests.llm.test_neardup import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = [r.asDict() for r in docs.collect()]

    cut = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"](spark, docs, sf_dir).collect()}
    trim = lambda line: line.strip(" \t\r")
    held, pages = {}, {}
    for r in before:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for line in {trim(x) for x in r["text"].split("\n")} - {""}:
            held[r["source"], line] = held.get((r["source"], line), 0) + 1
    for r in before:
        left = [x for x in r["text"].split("\n") if (n := held.get((r["source"], trim(x)), 0)) < 3 or n <= 0.05 * pages[r["source"]]]
        assert cut[r["doc_id"]] == ("\n".join(left), len("\n".join(left)))

    kept = {r.doc_id for r in stages["near_dedup"](spark, docs, sf_dir).collect()}
    assert kept == {d for d, _, c, _ in brute([(r["doc_id"], r["text"]) for r in before]) if c == d}

    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = {}
    for r in stages["packing"](spark, docs, sf_dir).collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for r in before:
        n, at = len(coder.encode(r["text"], add_special_tokens=False).ids) + 1, 0
        for start, length, whole in sorted(packed[r["doc_id"]]):
            assert (start, whole) == (at, n)
            at += length
        assert at == n


def test_run_is_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and out.count() > 0
    assert Path(sf_dir).exists()


def test_edges_pass_every_stage(spark, make, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows and an empty table go through all stages."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "same text of a few words here", "en", None), (3, "same text of a few words here", "en", None), (None, "without an id", None, "a"), (4, "word " * 30_000, "en", "a"), (5, " \n\t", "en", "a")]
    for docs, least in ((make(rows), 5), (make(rows).where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "packing":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert docs.select("doc_id").distinct().count() >= least
