"""Runs: evidence rows beside findings, the case document, reports."""

import hashlib

import pytest
from pyspark.sql import functions as F

from probity.operators import assurance, evidence, findings, report

SHAPE = "pillar string, category string, severity string, confidence double, method_status string, primary_source string, members long"


@pytest.fixture(scope="module")
def run(spark):
    """A poisoned batch, a backdoor that its pattern opens, replaced records, an unlinked edit of files and a remark."""
    one = lambda *rows: spark.createDataFrame(list(rows), SHAPE)
    text = lambda s: F.lit(s)
    place = F.struct(F.lit(3).alias("x"), F.lit(4).alias("y"))
    near = F.struct(F.lit(5).alias("x"), F.lit(2).alias("y"))
    empty = spark.range(1)
    parts = {
        "manifest": assurance.Detector(assurance.part(one(("dataset", "dataset.silent_modification", "HIGH", 1.0, "REAL", None, 2))), []),
        "pattern": assurance.Detector(assurance.part(one(("dataset", "dataset.trigger_pattern", "HIGH", 0.85, "HEURISTIC", "c1/b3", 30)), "p", place), [assurance.rows(empty, "source", text("c1/b3"), "p"), assurance.rows(empty, "source", text("c2/b9"), "p")]),
        "isolated": assurance.Detector(assurance.part(one(("dataset", "dataset.isolated_label_review", "INFO", 0.3, "HEURISTIC", None, 1))), []),
        "trigger": assurance.Detector(assurance.part(one(("model", "model.backdoor_behaviour", "HIGH", 0.8, "HEURISTIC", "c1/b3", 90)), "", near, F.lit("c1/b3"), F.lit("m7")), [assurance.rows(empty, "lineage", text("b9"))]),
        "records": assurance.Detector(
            assurance.part(one(("inference", "inference.record_replacement", "CRITICAL", 1.0, "REAL", None, 5), ("inference", "inference.chain_broken", "HIGH", 1.0, "REAL", None, 1)), F.col("category")),
            [assurance.rows(spark.range(5), "seq", text("s1"), "inference.record_replacement", F.col("id") * 10), assurance.rows(empty, "seq", text("s1"), "inference.chain_broken", F.lit(21)), assurance.rows(spark.range(5), "affected", F.concat(F.lit("inference:r"), "id"), "inference.record_replacement")],
        ),
    }
    found, rows = assurance.collect(F.lit(4).cast("long"), parts, F.lit("modelver:m7"))
    return assurance.assess(found, rows, spark.createDataFrame([(4, 60)], "run_id long, window_size long"))


def test_links_from_evidence_rows(run):
    """Numbers: F-001 files, F-002 pattern, F-003 remark, F-004 backdoor, F-005 broken, F-006 replaced."""
    got = {(r.a, r.b): (r.rule, r.strength) for r in run.links.collect()}
    assert got == {("F-002", "F-004"): ("R2-same-trigger", "strong"), ("F-006", "F-005"): ("R6-chain-successor", "strong"), ("F-001", "F-002"): ("R0-same-pipeline", "context")}
    chains = {r.chain_id: r for r in run.chains.collect()}
    assert sorted(tuple(r.findings) for r in chains.values()) == [("F-001",), ("F-002", "F-004"), ("F-005", "F-006")]
    assert run.overall.first().overall == "UNTRUSTED"


def test_a_stream_tells_equal_numbers_apart(run, spark):
    """Record 20 of one stream and 21 of another are not neighbours."""
    rows = run.rows.withColumn("value", F.when((F.col("kind") == "seq") & (F.col("num") == 21), "s2").otherwise(F.col("value")))
    rules = {r.rule for r in evidence.correlate(run.findings, ["run_id"], rows).collect()}
    assert "R6-chain-successor" not in rules and "R2-same-trigger" in rules


def test_case_document(run):
    case = run.case.first()
    assert case.title == "data poisoning with an effect on the model" and case.severity == "CRITICAL" and case.disposition == "QUARANTINE"
    assert case.findings == ["F-001", "F-002", "F-004", "F-005", "F-006"] and case.informational == ["F-003"]
    assert case["where"] == ["batch:b3", "contributor:c1", "dataset:contributed-dataset", "modelver:m7", "stream:cam-01", "inference:r0", "inference:r1", "inference:r2", "and 2 more records"]
    assert case.unknowns == ["F-002 is a score, not a proof", "F-004 is a score, not a proof", "no evidence joins F-001 to the main chain", "who did it and why is not determined"]
    assert case.what_happened[0] == "2 findings in dataset, model share evidence (R2-same-trigger): F-002 -> F-004" and len(case.next_steps) == 5 - 1


def test_report_of_a_run(run, spark):
    mark = lambda text: hashlib.sha256(("key" + text).encode()).hexdigest()
    audit = spark.range(1, 101).select(F.col("id").alias("seq"), F.lit("e").alias("event_type"))
    coverage = spark.createDataFrame([("label flips", "ran"), ("side channels", "not_implemented")], "capability string, status string")
    made = report.of_run(run, "RPT-0001", "2024-01-01T00:00:00", audit, {"dataset.manifest": spark.range(2)}, findings.checks({"ks": ("distribution", "ran", "REAL")}, spark), coverage, sign=mark)
    assert len(made) >= 23 and len(made["audit"]) == 80 and made["dataset"]["manifest"] == [{"id": 0}, {"id": 1}] and made["model"]["trigger_tests"] is None
    assert [f["id"] for f in made["findings"]] == [f"F-{i:03d}" for i in range(1, 7)] and made["supported_attack_classes"] == ["label flips"]
    check = lambda text, given: mark(text) == given
    assert report.verified(made, check)
    assert not report.verified({**made, "recommended_disposition": "ACCEPT"}, check) and not report.verified(made, lambda *_: False)
    with pytest.raises(ValueError):
        report.of_run(run, "R", "t", audit, {"dataset.weather": spark.range(1)})


def test_a_run_without_findings(spark):
    parts = {"manifest": assurance.Detector(assurance.part(spark.createDataFrame([], SHAPE)), [assurance.rows(spark.range(0), "source", F.lit("x"))])}
    found, rows = assurance.collect(F.lit(1).cast("long"), parts, F.lit("model:m"))
    got = assurance.assess(found, rows, spark.createDataFrame([(1, 60)], "run_id long, window_size long"))
    assert got.case.count() == 0 and got.links.count() == 0 and got.overall.first().overall == "TRUSTED"
