"""Detectors, correlation, admission and self-test against plain code."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import ed25519, scalars, stats
from probity.operators import cases, evidence, findings, graph, records, samples, shift, vectors
from probity.plans import catalogue, detectors, selftest
from probity.plans.scenarios import COMBINED, SCENARIOS
from probity.streaming import ingest

BY = {s.name: s for s in SCENARIOS}


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# Admission ---------------------------------------------------------------------------------------------------------


def walk(incoming, log, trusted):
    """Records one by one: only an accepted one uses its nonce up and raises its stream's number."""
    last, used, out = {}, {n for _, _, n in log}, {}
    for s, q, _ in log:
        last[s] = max(last.get(s, q), q)
    for i, s, q, n, signer, ok in sorted(incoming, key=lambda r: r[0]):
        why = [] if ok else ["record hash mismatch"]
        why += [] if signer in trusted else ["untrusted signer"]
        bad_nonce, bad_seq = n is not None and n in used, s in last and q <= last[s]
        why += ["nonce already used"] * bad_nonce + ["sequence not increasing"] * bad_seq
        if not why:
            used.add(n)
            last[s] = q
        out[i] = ("; ".join(why), bad_nonce or bad_seq)
    return out


SCHEMA = "record_id long, stream long, seq long, nonce long, signer string, hash_ok boolean"


def admitted(spark, incoming, log, trusted=("k",)):
    got = records.ingest_admission(
        spark.createDataFrame(incoming, SCHEMA), spark.createDataFrame(log, "stream long, seq long, nonce long"), spark.createDataFrame([(t,) for t in trusted], "signer string")
    )
    return {r.record_id: (r.reasons, r.replay) for r in got.collect()}


def test_admission_inside_a_batch(spark):
    incoming = [
        (1, 1, 5, 10, "k", True), (2, 1, 5, 11, "k", True), (3, 1, 4, 12, "k", True),  # equal and lower number
        (4, 2, 1, 20, "x", True), (5, 3, 1, 20, "k", True), (6, 3, 2, 20, "k", True),  # an outsider's nonce blocks nobody
        (7, 4, 9, 30, "k", False), (8, 4, 3, 31, "k", True), (9, 4, 8, 30, "k", True),  # a broken record raises no number
        (10, 5, 0, None, "k", True), (11, 5, 1, None, "k", True), (12, 6, 1, 1, "k", True),
    ]
    log = [(6, 3, 1)]
    got = admitted(spark, incoming, log)
    assert got == walk(incoming, log, {"k"})
    assert [i for i in got if not got[i][0]] == [1, 5, 8, 9, 10, 11]


def test_admission_of_entangled_records(spark):
    """Nonces and numbers that hold each other back over several streams."""
    rng = random.Random(3)
    incoming = [(i, rng.randrange(4), rng.randrange(30), rng.randrange(40), rng.choice("kkkx"), rng.random() > 0.1) for i in range(150)]
    log = [(0, 3, 5), (1, 2, 6)]
    assert admitted(spark, incoming, log) == walk(incoming, log, {"k"})
    assert admitted(spark, [], log) == {}


def test_admission_over_batches_of_a_stream(spark, tmp_path):
    rng = random.Random(5)
    incoming = [(i, rng.randrange(3), rng.randrange(60), rng.randrange(50), rng.choice("kkkx"), True) for i in range(90)]
    for b in range(3):
        spark.createDataFrame(incoming[30 * b : 30 * b + 30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
    sink = ingest.admit(str(tmp_path / "ok"), str(tmp_path / "bad"), spark.createDataFrame([("k",)], "signer string"))
    for b in (0, 1, 1, 2):  # the second batch runs again
        sink(spark.read.parquet(str(tmp_path / f"in{b}")), b)
    log = {r.record_id: r.reasons or "" for r in ingest.ingest_log(spark, str(tmp_path / "ok"), str(tmp_path / "bad")).collect()}
    assert log == {i: why for i, (why, _) in walk(incoming, [], {"k"}).items()}
    counted = ingest.ingest_log(spark, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert findings.rejected_finding(counted).first().members == sum(1 for w in log.values() if w)


def test_records_are_chained_over_batches(spark, tmp_path):
    sink = ingest.produce(str(tmp_path / "made"), "record_id")
    for b in (0, 1, 1):
        part = spark.createDataFrame([(10 * b + i, i % 2, f"body {b} {i}") for i in range(6)], "record_id long, stream long, body string")
        sink(part, b)
    made = spark.read.parquet(str(tmp_path / "made") + "/*").withColumn("nonce", F.col("record_id"))
    checked = records.chain_checks(made)
    assert made.count() == 12 and checked.where("not link_ok or not seq_ok").count() == 0


def test_latest_window_as_state(spark, tmp_path):
    for b in range(2):
        spark.createDataFrame([(b * 15 + i, 1) for i in range(15)], "seq long, stream long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq long, stream long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ingest.latest_in_stream(source, size=25, least=20)
    out.writeStream.format("memory").queryName("latest_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.n, r.ready) for r in spark.table("latest_out").collect()}
    assert got == {(15, False), (25, True)}


def test_null_nonces_are_no_replay(spark):
    df = spark.createDataFrame([(1, 1, 1, None, "a", scalars.GENESIS), (2, 1, 2, None, "b", "a")], "record_id long, stream long, seq long, nonce long, record_hash string, prev_record_hash string")
    assert records.chain_checks(df).where("nonce_ok").count() == 2


# Statuses, correlation, graph --------------------------------------------------------------------------------------


def _finding(i, pillar, category="other", severity="HIGH", run=1, method="HEURISTIC"):
    return {"id": f"F-{run}-{i:03d}", "run_id": run, "ord": i, "pillar": pillar, "category": category, "severity": severity, "confidence": 0.8, "method_status": method, "recommendation": f"step {i}"}


FINDING = "run_id long, " + evidence.FINDING


def test_a_clean_run_is_trusted(spark):
    none = spark.createDataFrame([], FINDING)
    one = evidence.pillar_status(none)
    assert rows(one, "pillar", "findings", "status") == sorted((p, 0, "PASS") for p in evidence.PILLARS)
    assert evidence.overall(one).first().overall == "TRUSTED"
    some = spark.createDataFrame([_finding(1, "dataset", severity="LOW"), _finding(2, "dataset", severity="INFO"), _finding(3, "governance", run=2)], FINDING)
    runs = spark.createDataFrame([(1, 60), (2, 60), (3, 60), (4, 5)], "run_id long, window_size long")
    status = evidence.pillar_status(some, ["run_id"], runs)
    assert status.count() == 20
    assert rows(evidence.overall(status, ["run_id"]), "run_id", "overall") == [(1, "TRUSTED"), (2, "UNTRUSTED"), (3, "TRUSTED"), (4, "REVIEW REQUIRED")]
    assert rows(status.where("run_id = 4 and pillar = 'distribution'"), "status") == [("INSUFFICIENT_DATA",)]


def test_lone_findings_hang_on_the_run(spark):
    made = spark.createDataFrame([_finding(1, "dataset"), _finding(2, "model"), _finding(3, "inference"), _finding(1, "dataset", run=2), _finding(1, "model", severity="INFO", run=3)], FINDING)
    got = rows(evidence.correlate(made, ["run_id"]), "run_id", "a", "b", "rule")
    assert got == [(1, "F-1-001", "F-1-002", "R0-same-pipeline"), (1, "F-1-003", "F-1-001", "R0-same-pipeline")]


def test_graph_is_tied_together(spark):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    nodes, edges = graph.build(
        frame([("s1", "b1", "c1"), ("s2", None, None)], "sample string, batch string, contributor string"), frame([("v1", "d1", None, []), ("v2", "d2", "v1", ["b1"])], "model_id string, sha256 string, previous_version string, new_sources array<string>"),
        frame([("d2",)], "sha256 string"), frame([("r1", "d1"), ("r2", "?")], "record_id string, model_sha256 string"), frame([("F1", ["sample:s1", "inference:r1", "moon:x"], "C1")], "id string, affected array<string>, case_id string"),
        frame([("E1", "F1", ["sample:s1"])], "id string, finding_id string, assets array<string>"), frame([("F1", "F1")], "a string, b string"), frame([("sc", ["batch:b1"])], "id string, touched array<string>"),
    )
    got = {(r.src, r.dst, r.rel) for r in edges.collect()}
    path = [("finding:F1", "case:C1"), ("finding:F1", "evidence:E1"), ("evidence:E1", "sample:s1"), ("sample:s1", "batch:b1"), ("batch:b1", "contributor:c1")]
    assert all(any(e[:2] == p for e in got) for p in path)
    assert ("model:v2", "model:v1", "derived_from") in got and ("model:v2", "batch:b1", "derived_from") in got and ("inference:r1", "model:v1", "produced_by") in got
    assert not any("moon" in e[1] or e[0] == e[1] for e in got) and not any(e[0] == "inference:r2" and e[2] == "produced_by" for e in got)
    kinds = {r.id: r.type for r in nodes.collect()}
    assert kinds["stream:cam-01"] == "Stream" and kinds["scenario:sc"] == "AttackScenario" and None not in kinds.values()
    kept = graph.without_kind(nodes, edges)
    assert not any("sample:" in r.src or "sample:" in r.dst for r in kept.collect())


def test_evidence_is_tied_to_all_its_assets(spark, sf_dir):
    """Twelve samples a piece of evidence, in the query as in the library; a drawing shows the first of them."""
    from probity.plans import runs

    got = runs.evidence_graph_edges(spark, sf_dir).where("src LIKE 'evidence:%' AND rel = 'derived_from'").groupBy("src").count().collect()
    assert got and all(r["count"] == 12 for r in got)
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    given = (
        frame([(f"s{i}", "b1", "c1") for i in range(20)], "sample string, batch string, contributor string"), frame([], "model_id string, sha256 string, previous_version string, new_sources array<string>"), frame([("d",)], "sha256 string"),
        frame([], "record_id string, model_sha256 string"), frame([("F1", ["dataset:contributed-dataset"], None)], "id string, affected array<string>, case_id string"), frame([("E1", "F1", [f"sample:s{i}" for i in range(20)])], "id string, finding_id string, assets array<string>"),
        frame([], "a string, b string"), frame([], "id string, touched array<string>"),
    )
    for drawn, n in ((None, 20), (graph.DRAWN, 8)):
        nodes, edges = graph.build(*given, drawn=drawn)
        assert nodes.where("type = 'Sample'").count() == n and edges.where("src = 'evidence:E1'").count() == n and edges.where("src LIKE 'sample:%' AND dst = 'batch:b1'").count() == n


# Statistics --------------------------------------------------------------------------------------------------------


def test_percentiles_are_exact_in_every_group(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 997)) for v in rng.integers(0, 50, n)] + [("d", None)]
    got = {r.g: list(r.p) for r in stats.exact_percentiles(spark.createDataFrame(data, "g string, v double"), "v", [0.01, 0.5, 0.995], ["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        assert got[g] == pytest.approx(np.percentile([v for h, v in data if h == g], [1, 50, 99.5]))
    assert stats.exact_percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_binomial_tail_of_large_sources():
    assert 0 < stats.beta_tail(0.1, 100_100_000, 900_000_000) < 1e-20
    assert stats.beta_tail(0.5, 500_000_000, 500_000_001) == pytest.approx(0.5, abs=1e-3)


def test_knn_in_blocks_equals_knn_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = lambda n, at: spark.createDataFrame([(at + i, [float(v) for v in rng.normal(size=4)], 0) for i in range(n)], "vec_id long, embedding array<double>, label int")
    q, r = frame(23, 0), frame(70, 1000)
    want = rows(vectors.knn(q, r, 5), "query_id", "ref_id", "sim", "rank")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 9)
    assert rows(vectors.knn(q, r, 5), "query_id", "ref_id", "sim", "rank") == want
    own = vectors.knn(r, r, 3, exclude_self=True)
    assert own.where("query_id = ref_id").count() == 0 and own.count() == 210


def test_passages_count_each_id_once(spark):
    text = " ".join(f"w{i}" for i in range(16))
    df = spark.createDataFrame([(i, text, "s") for i in range(8)] + [(0, text, "s"), (0, text + " more", "s")], "id long, text string, source string")
    assert rows(samples.recurring_passages(df, "id", "text", "source"), "position", "members") == [(0, 8), (1, 8)]


def test_manifest_digest_is_of_canonical_json(spark):
    import hashlib
    import json

    files = {'a "b".png': "1", "é.png": "2", "c.png": "3"}
    df = spark.createDataFrame(list(files.items()), "name string, sha256 string")
    assert records.manifest_of(df).first().digest == hashlib.sha256(json.dumps(files, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_signatures():
    key, public = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb"), "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    signature = "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"
    assert ed25519.public_key(key).hex() == public and ed25519.sign(key, b"\x72").hex() == signature and ed25519.verify_hex(public, "72", signature)
    for bad in ((public, "73", signature), (public, "72", signature[:-2] + "01"), ("00" * 32, "72", signature), (public, None, signature), (public, "72", "zz"), (public, "72", "")):
        assert not ed25519.verify_hex(*bad)


# Self-test and scenarios -------------------------------------------------------------------------------------------


def test_selftest_detects_everything(spark):
    got = {r.test: (r.status, r.failed_checks) for r in selftest.provenance_selftest(spark).collect()}
    assert len(got) == 11 and all(s in ("OK", "DETECTED") for s, _ in got.values())
    assert got["baseline"] == ("OK", "")
    assert got["output_modified"][1] == "output_binding,record_hash", "an edited output leaves the signature alone"
    assert "signature" in got["resigned_untrusted"][1] and "chain_link" in got["resigned_untrusted"][1]
    assert got["input_modified"][1] == "input_binding" and "sequence" in got["deleted"][1]


def test_ood_scenario(spark):
    measured = spark.range(400).select("id", F.concat(F.lit("s"), F.col("id") % 8).alias("source"), (F.col("id") % 20 / 100).alias("distance"), F.lit(1.0).alias("spread"))
    limits = findings.calibration(measured, spark.createDataFrame([(0.01,)], "baseline double"))
    find = lambda d: findings.ood_finding(findings.out_of_distribution(d, limits))
    assert find(measured).count() == 0
    got = find(BY["ood_insertion"].change(measured)).first()
    assert (got.category, got.severity, got.primary_source, got.members) == (BY["ood_insertion"].expected[0], "MEDIUM", "s7", 10)


def test_pattern_scenario(spark):
    about = spark.range(200).select("id", F.lit("c/b").alias("source"), (F.col("id") % 3).alias("label"), (F.col("id") % 10 == 3).alias("flagged"), F.col("id").alias("cluster"))
    about = about.withColumn("label", F.when(F.col("flagged"), 0).otherwise(F.col("label")))
    spots = spark.range(200).select("id", (F.col("id") % 37).cast("int").alias("x"), (F.col("id") % 41).cast("int").alias("y"), F.col("id").alias("key"))
    assert findings.recurring_pattern(spots, about).count() == 0
    got = findings.recurring_pattern(BY["backdoor_poison"].change(spots), about).first()
    assert (got.category, got.severity, got.x, got.members, got.target) == ("dataset.trigger_pattern", "HIGH", 40, 20, "0")
    one_cluster = about.withColumn("cluster", F.lit(1))
    assert findings.recurring_pattern(BY["backdoor_poison"].change(spots), one_cluster).count() == 0, "copies count once"


def test_model_scenario(spark):
    registry = spark.createDataFrame([("a", "da", True), ("b", "db", True), ("c", "dc", False)], "model string, sha256 string, signature_ok boolean")
    deployed = registry.select("model", "sha256").where("model <> 'c'")
    assert findings.registry_findings(deployed, registry).count() == 0
    assert rows(findings.registry_findings(BY["model_substitution"].change(deployed), registry), "model", "category", "severity") == [("a", "model.substitution", "CRITICAL")]
    other = deployed.withColumn("sha256", F.lit("db"))
    assert rows(findings.registry_findings(other, registry), "model", "severity") == [("a", "HIGH")]
    assert rows(findings.registry_findings(registry.select("model", "sha256"), registry), "model", "category") == [("c", "model.manifest_tampered")]


def test_audit_scenario(spark):
    chain, prev = [], scalars.GENESIS
    for i in range(1, 6):
        chain.append((i, prev, f"h{i}", f"h{i}"))
        prev = f"h{i}"
    log = spark.createDataFrame(chain, "seq long, prev_hash string, hash string, body string")
    head = lambda h, ok=True: spark.createDataFrame([(5, h, ok)], "seq long, hash string, signature_ok boolean")
    report = lambda l, h: records.audit_report(l, F.col("body"), h).first()
    assert report(log, head("h5")).valid and findings.audit_finding(records.audit_report(log, F.col("body"), head("h5"))).count() == 0
    assert (report(BY["audit_tampering"].change(log), head("h5")).first_break_seq, report(log.where("seq < 5"), head("h5")).first_break_seq) == (3, 4)
    assert not report(log, head("h5", False)).valid and report(log, head("h5").where("false")).head_ok is None
    assert findings.audit_finding(records.audit_report(BY["audit_tampering"].change(log), F.col("body"), head("h5"))).first().category == BY["audit_tampering"].expected[0]


def test_replay_scenario(spark):
    sent = spark.createDataFrame([(i, 1, i, i, "k", True) for i in range(1, 6)], SCHEMA)
    trusted, none = spark.createDataFrame([("k",)], "signer string"), spark.createDataFrame([], "stream long, seq long, nonce long")
    find = lambda d: findings.rejected_finding(records.ingest_admission(d, none, trusted))
    assert find(sent).count() == 0
    got = find(BY["replay_at_ingest"].change(sent)).first()
    assert (got.category, got.members) == (BY["replay_at_ingest"].expected[0], 2)


def test_shift_findings_by_status(spark):
    windows = spark.createDataFrame([("w1", "PASS", 0.0, False, 60), ("w2", "DRIFT", 0.9, False, 60), ("w3", "SUSPICIOUS", 0.0, True, 9), ("w4", "INCONCLUSIVE", 0.2, False, 60), ("w5", "INSUFFICIENT_DATA", 0.0, False, 3)], "win string, status string, driver_fraction double, matched boolean, members long")
    assert rows(findings.shift_findings(windows), "win", "category", "severity", "confidence") == [
        ("w2", "distribution.environmental_drift", "MEDIUM", 0.86), ("w3", "distribution.localized_manipulation", "HIGH", 0.8), ("w4", "distribution.unattributed_shift", "MEDIUM", 0.5),
    ]


def test_the_combined_scenario_becomes_one_case(spark):
    """Poisoned source, backdoored model, triggered inputs, tampered records: one chain over four pillars, quarantine."""
    made = [
        _finding(1, "dataset", "dataset.trigger_pattern") | {"primary_source": "c/b1", "sources": ["c/b1"], "trigger": {"x": 40, "y": 40}},
        _finding(2, "dataset", "dataset.systematic_mislabelling") | {"primary_source": "c/b1", "sources": ["c/b1"]},
        _finding(3, "model", evidence.BACKDOOR) | {"trigger": {"x": 40, "y": 41}, "candidate_source": "c/b1", "model_digest": "m", "lineage_sources": ["b1"]},
        _finding(4, "distribution", "distribution.localized_manipulation") | {"trigger": {"x": 39, "y": 40}},
        _finding(5, "inference", "inference.tampering", method="REAL") | {"record_model_digests": ["m"]},
    ]
    found = spark.createDataFrame(made, FINDING)
    links = evidence.correlate(found, ["run_id"])
    chain = evidence.chains(found, links, ["run_id"])
    assert rows(chain, "chain_id", "place", "size", "n_pillars") == [("CH-1", 1, 5, 4)]
    case = evidence.case_of(found, chain, ["run_id"]).first()
    assert (case.severity, case.escalated, case.disposition, case.n_findings) == ("CRITICAL", True, "QUARANTINE", 5)
    assert evidence.overall(evidence.pillar_status(found, ["run_id"]), ["run_id"]).first().overall == "UNTRUSTED"
    assert set(COMBINED) <= set(BY)


def test_local_patterns_make_a_window_suspicious(spark):
    window = spark.createDataFrame([(60, 1, 0, False, 0.0)], "n int, patches int, top_region_count int, shifted boolean, driver_fraction double")
    assert shift.attribution(window).first().status == "SUSPICIOUS"


def test_ring_goes_on_at_the_start(spark):
    items = spark.createDataFrame([(c,) for c in "abc"], "name string")
    assert [r.name for r in cases.ring_page(items, "name", 2, 5).orderBy("i").collect()] == list(itertools.islice(itertools.cycle("cab"), 5))


def test_merged_maps_and_now(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "l map<string,int>, r map<string,int>")
    got = df.select(scalars.merged(F.col("l"), F.col("r")).alias("m"), scalars.iso_now().alias("t")).first()
    assert got.m == {"a": 1, "b": 3} and got.t.endswith("+00:00") and len(got.t) == 29


def test_manifest_signatures_of_every_supplier(spark, sf_dir):
    got = {int(r.model.removeprefix("model-")): r.ok for r in selftest.manifest_signatures(spark, sf_dir).collect()}
    assert got == {i: i % 7 != 3 and i % 11 != 5 for i in got} and len(got) == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def test_record_checks_leave_texts_behind(spark, monkeypatch):
    """Texts and digests that a record tells by itself are neither dealt by ranges nor written for the chain's checks."""
    seen, placed = [], records.ordered.placed
    monkeypatch.setattr(records.ordered, "placed", lambda df, order: (seen.append(set(df.columns)), placed(df, order))[1])
    detectors._verified(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and not seen[0] & {"body", "props", "output", "output_sha256", "preprocess", "inference_config", "input_sha256"}
    catalogue._verdicts(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not seen[1] & {"true_hash", "event_type", "props"}


def test_passages_are_digested_before_rows_are_multiplied(spark):
    """No row of a position carries all words of its text, which is quadratic in the text's length."""
    df = spark.createDataFrame([(1, "a", " ".join(map(str, range(40)))), (2, "a", None), (3, "b", "few words"), (4, "b", "A b c d e f g h i")], "id long, source string, text string")
    got = samples.passages(df)
    assert sorted((r.id, r.position) for r in got.collect()) == [(1, i) for i in range(5)] + [(4, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line]
    below = plan[plan.index("Generate") :]
    assert len(made) == 1 and "explode" not in plan and "md5" in below


def test_a_run_looks_for_neighbours_once(spark, sf_dir, monkeypatch):
    """Labels, isolated labels and outliers share the neighbours of contributed and of reference vectors."""
    asked, knn = [], vectors.knn
    monkeypatch.setattr(vectors, "knn", lambda *a, **k: (asked.append(k), knn(*a, **k))[1])
    detectors._run(spark, sf_dir)
    assert len(asked) == 2
