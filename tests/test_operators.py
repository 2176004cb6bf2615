import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import scalars, stats
from probity.operators import components, evidence, records, samples, shift, vectors
from probity.plans import catalogue
from probity.sources import datasets, storage


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_binomial_tail_is_exact(spark):
    df = spark.createDataFrame([(0, 10, 0.1), (3, 10, 0.5), (10, 10, 0.5), (30, 50, 0.01)], "k long, n long, p double")
    got = [r[0] for r in df.select(stats.binomial_tail("k", "n", "p")).collect()]
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert got[0] == 1.0
    assert got[1:] == pytest.approx([exact(3, 10, 0.5), exact(10, 10, 0.5), exact(30, 50, 0.01)], rel=1e-9)


def test_ks_of_equal_windows_is_one(spark):
    df = spark.range(100).select((F.col("id") % 50).cast("double").alias("v"), F.col("id") >= 50)
    got = stats.ks_two_sample(df.toDF("v", "cur"), "v", F.col("cur")).first()
    assert (got.ks, got.p_value) == (0.0, 1.0)


def test_running_totals_match_a_plain_sum(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("v"), F.lit(1).alias("n"))
    assert all(r.cum_n == r.v + 1 for r in stats.running_totals(df, "v", ["n"]).collect())


def test_mmd_reads_the_whole_reference(spark, tmp_path, monkeypatch):
    """1,000 vectors have 250 of the reference; blocks and the median's passes change nothing."""
    x = np.random.default_rng(1).normal(size=(1000, 8)).round(3)
    x[::50] = x[0]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    i = np.arange(1000)
    ref, cur = x[i % 4 == 0], x[i % 4 != 0][-60:]
    z = np.vstack([ref, cur])
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    k = np.exp(-d / np.median(d[~np.eye(len(z), dtype=bool)]))
    n, want = {0: slice(0, 250), 1: slice(250, 310)}, stats.mmd_test(ref, cur)
    for rows, most in ((20_000, 10**6), (100, 50)):
        monkeypatch.setattr(shift, "SORTED", most)
        monkeypatch.setattr(shift.Pairs.__init__, "__defaults__", (rows,))
        got = {(r.x, r.y): (r.n, r.kernel_mean) for r in catalogue.mmd_kernel_mean(spark, str(tmp_path)).collect()}
        assert got == {(a, b): (k[n[a], n[b]].size, pytest.approx(k[n[a], n[b]].mean(), abs=1e-6)) for a in n for b in n}
        assert tuple(catalogue.mmd_permutation_p(spark, str(tmp_path)).first()) == pytest.approx(want, abs=1e-9)


def test_mmd_tells_a_shift():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    assert stats.mmd_test(x, rng.normal(size=(40, 4)))[1] > 0.05
    assert stats.mmd_test(x, rng.normal(size=(40, 4)) + 2)[1] < 0.01


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.components(links).collect()} == {0}


def test_components_without_links(spark):
    assert components.components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_label_vote_flags_a_flipped_label(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(3)
    ref = [(i, [float(x) for x in centres[i % 3] + rng.normal(0, 0.01, 3)], i % 3) for i in range(60)]
    new = [(1000 + i, [float(x) for x in centres[i % 3]], (i % 3) if i else 2) for i in range(6)]
    reference, queries = (spark.createDataFrame(r, "vec_id long, embedding array<double>, label int") for r in (ref, new))
    votes = vectors.label_vote(vectors.knn(queries, reference, 11), reference, queries)
    assert [(r.query_id, r.majority) for r in votes.where("flagged").collect()] == [(1000, 0)]


def test_exact_copies_stand_out_and_null_texts_do_not(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "")], "id long, text string")
    assert rows(samples.duplicate_groups(df.where("text is not null"), "id", F.col("text")), "n", "first_id") == [(2, 1)]
    assert rows(samples.duplicate_links(df, "id", F.col("text")), "a", "b") == [(1, 2)]


def _chain(spark, change=lambda r: r):
    out, prev = [], scalars.GENESIS
    for i in range(1, 6):
        out.append({"record_id": i, "stream": 1, "seq": i, "nonce": i, "record_hash": f"h{i}", "prev_record_hash": prev})
        prev = f"h{i}"
    return spark.createDataFrame(change(out), "record_id long, stream long, seq long, nonce long, record_hash string, prev_record_hash string")


def _failed(df):
    checked = records.chain_checks(df)
    return {c: {r.record_id for r in checked.where(~F.col(c)).collect()} for c in ("link_ok", "seq_ok", "nonce_ok")}


def test_whole_chain_passes(spark):
    assert _failed(_chain(spark)) == {"link_ok": set(), "seq_ok": set(), "nonce_ok": set()}


def test_deleted_record_leaves_gap_and_broken_link(spark):
    assert _failed(_chain(spark, lambda r: r[:2] + r[3:])) == {"link_ok": {4}, "seq_ok": {4}, "nonce_ok": set()}


def test_forged_record_breaks_its_successor(spark):
    def forge(r):
        r[2]["record_hash"] = "forged"
        return r

    assert _failed(_chain(spark, forge))["link_ok"] == {4}


def test_replay_cites_the_first_use(spark):
    def replay(r):
        r[4]["nonce"] = 2
        return r

    checked = records.chain_checks(_chain(spark, replay))
    assert rows(checked.where(~F.col("nonce_ok")), "record_id", "nonce_owner") == [(5, 2)]


def test_audit_edits_show(spark):
    log = [(1, scalars.GENESIS, "a", "a"), (2, "a", "b", "b"), (3, "b", "x", "c"), (5, "c", "e", "e")]
    df = spark.createDataFrame(log, "seq long, prev_hash string, hash string, body string")
    assert rows(records.audit_problems(df, F.col("body")), "seq", "problem") == [(3, "content_modified"), (5, "broken_link"), (5, "sequence_gap")]


def test_audit_sink_links_its_events(spark, tmp_path):
    head = storage.append_chained(spark, [{"event_type": "a"}, {"event_type": "b"}], str(tmp_path / "log"), (0, scalars.GENESIS))
    head = storage.append_chained(spark, [{"event_type": "c"}], str(tmp_path / "log"), head)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert head[0] == 3
    assert records.audit_problems(log, F.col("hash")).count() == 0


def _finding(i, pillar, category, severity="HIGH", **more):
    base = {"id": f"F-{i:03d}", "ord": i, "pillar": pillar, "category": category, "severity": severity, "confidence": 0.8, "method_status": "HEURISTIC", "recommendation": f"step {i}"}
    return base | more


def test_rules_link_findings_to_one_case(spark):
    findings = spark.createDataFrame([
        _finding(1, "dataset", "dataset.trigger_pattern", primary_source="c/b1", sources=["c/b1"], trigger={"x": 40, "y": 40}),
        _finding(2, "dataset", "dataset.label_inconsistency", primary_source="c/b1", sources=["c/b1"]),
        _finding(3, "model", "model.backdoor_behaviour", trigger={"x": 41, "y": 39}, candidate_source="c/b1", model_digest="m", lineage_sources=["b1"]),
        _finding(4, "inference", "inference.unregistered_model", record_model_digests=["m"]),
        _finding(5, "governance", "governance.audit_tampering", severity="MEDIUM"),
        _finding(6, "dataset", "dataset.isolated_label_review", severity="INFO"),
    ], evidence.FINDING)
    links = evidence.correlate(findings)
    got = {(frozenset((r.a, r.b)), r.rule) for r in links.collect()}
    f = lambda *i: frozenset(f"F-{x:03d}" for x in i)
    assert got == {(f(1, 2), "R1-same-source"), (f(1, 3), "R2-same-trigger"), (f(2, 3), "R3-data-to-model"), (f(3, 4), "R5-model-binding"), (f(5, 1), "R0-same-pipeline")}
    chains = evidence.chains(findings, links)
    assert rows(chains, "size", "n_pillars", "strong") == [(1, 1, False), (4, 3, True)]
    case = evidence.case_of(findings, chains).first()
    assert (case.severity, case.escalated, case.disposition) == ("CRITICAL", True, "QUARANTINE")
    assert case.next_steps[0] == "step 1"


def test_risk_formula(spark):
    df = spark.createDataFrame([("HIGH", 1.0), ("MEDIUM", 0.5), ("INFO", 1.0)], "s string, c double")
    assert df.agg(evidence.risk(F.col("s"), F.col("c"))).first()[0] == round(1 - 0.25 * (1 - 0.225), 3)


def test_set_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "k long, d string")
    one = records.set_digest(df, F.col("d"), F.col("k").cast("string")).first()
    two = records.set_digest(df.orderBy(F.col("k").desc()).repartition(3), F.col("d"), F.col("k").cast("string")).first()
    assert (one.n, one.digest) == (two.n, two.digest)


def test_yolo_and_coco_agree(spark, tmp_path):
    import json

    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("0 0.5 0.5 0.5 0.5\n1 0.1 0.1 0.1 0.1\nshort line\n")
    images = spark.createDataFrame([("a.png", 100, 100), ("b.png", 100, 100)], "file string, width int, height int")
    coco = {
        "images": [{"id": 1, "file_name": "a.png"}, {"id": 2, "file_name": "b.png"}],
        "annotations": [{"image_id": 1, "category_id": 0, "bbox": [25, 25, 50, 50]}, {"image_id": 1, "category_id": 1, "bbox": [5, 5, 10, 10]}],
        "categories": [{"id": 0, "name": "vehicle"}, {"id": 1, "name": "person"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(coco))
    (tmp_path / "sources.csv").write_text("file,contributor,batch\na.png,c1,\n")
    sources = datasets.read_sources_csv(spark, str(tmp_path / "sources.csv"))
    yolo = datasets.read_yolo(spark, str(tmp_path / "labels"), images, ["vehicle", "person"], sources)
    want = [("a.png", "vehicle", "c1", None), ("b.png", None, None, None)]
    assert rows(yolo, "file", "label", "contributor", "batch") == want
    assert rows(datasets.read_coco(spark, str(tmp_path / "c.json"), sources), "file", "label", "contributor", "batch") == want
    assert {b.x for b in yolo.where("file = 'a.png'").first().boxes} == {25.0, 5.0}


def test_append_continues_the_ids(spark):
    old, new = spark.createDataFrame([(3, "a")], "id long, t string"), spark.createDataFrame([("c",), ("b",)], "t string")
    assert rows(storage.append_with_ids(old, new, "id", ["t"]), "id", "t") == [(3, "a"), (4, "b"), (5, "c")]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",), (None,)], "d string")
    assert [r[0] for r in df.select(scalars.canonical_json("d")).collect()] == ['{"a":"é","b":1}', None, None]


def test_digests_are_packed_one_for_one(spark):
    """Records carry their hashes as bytes, and get back what they were, whatever it was."""
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest[:63], digest + "0", digest + "\n", "", "x", "é" * 16, "y" * 32, "\0" * 33, bytes.fromhex("61" * 32).decode(), "61" * 32, scalars.GENESIS, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", records.packed_digest(F.col("t")))
    got = df.withColumns({"back": records.unpacked_digest(F.col("p")), "size": F.length("p")}).collect()
    assert [r.back for r in got] == texts
    assert len({bytes(r.p) for r in got if r.p is not None}) == len(texts) - 1
    assert got[0].size == 32


def test_record_tables_are_written_narrow(spark, sf_dir, monkeypatch):
    """What the run keeps of a record is its verdict; hashes are written as bytes, and none after the links are decided."""
    from probity.functions import ordered

    written, plain = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, tag, *by: written.append(dict(df.dtypes)) or plain(df, tag, *by))
    from probity.plans import detectors

    got = records.failures_of(detectors._verified(spark, sf_dir), "model_sha256", "nonce_ok")
    assert got.columns == ["record_id", "stream", "seq", "failure_categories", "primary_category", "verdict", "model_sha256", "nonce_ok"]
    assert [w["record_hash"] for w in written] == ["binary"] and got.count() == got.select("record_id").distinct().count()
