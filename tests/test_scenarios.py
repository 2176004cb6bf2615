"""Each scenario raises what it must, and the unchanged tables raise nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import scalars
from probity.operators import evidence, images, models, records, report, samples, shift
from probity.plans.scenarios import SCENARIOS

BY = {s.name: s for s in SCENARIOS}


def _records(spark):
    out, prev = [], scalars.GENESIS
    for i in range(1, 7):
        out.append((i, 1, i, i, f"h{i}", prev, f"h{i}", True))
        prev = f"h{i}"
    return spark.createDataFrame(out, "record_id long, stream long, seq long, nonce long, record_hash string, prev_record_hash string, true_hash string, trusted boolean")


def _failures(df):
    checked = records.chain_checks(df)
    verdict = records.verdicts(checked, {"TAMPERED_RECORD": F.col("record_hash") != F.col("true_hash"), "FORGED_RECORD": ~F.col("trusted"), "REPLAY": ~F.col("nonce_ok"), "CHAIN_BROKEN": ~F.col("link_ok") | ~F.col("seq_ok")})
    return {c for r in verdict.collect() for c in r.failure_categories}


@pytest.mark.parametrize("name", [s.name for s in SCENARIOS if s.table == "records"])
def test_records(spark, name):
    clean = _records(spark)
    assert _failures(clean) == set()
    assert _failures(BY[name].change(clean)) == set(BY[name].expected)


def test_label_flip(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), (F.col("id") % 10).cast("string")).alias("source"), (F.col("id") % 97 == 0).cast("int").alias("toxic"))
    found = lambda d: {r.source: r.severity for r in samples.source_significance(d, "source", F.col("toxic") == 1).where("concentrated").collect()}
    assert found(df) == {}
    assert found(BY["label_flip"].change(df)) == {"src0": "HIGH"}


def test_duplicate_flood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    most = lambda d: samples.duplicate_groups(d, "doc_id", F.col("text")).agg(F.max("n")).first()[0]
    assert most(BY["duplicate_flood"].change(docs)) >= 21 > most(docs)


def test_distribution_shift(spark):
    df = spark.range(400).select(F.lit("value").alias("feature"), F.randn(3).alias("v"), (F.col("id") % 2 == 0).alias("cur"))
    shifted = lambda d: shift.feature_tests(d, "feature", "v", F.col("cur")).first().shifted
    assert not shifted(df) and shifted(BY["distribution_shift"].change(df))


def test_attribution_ladder(spark):
    rows = [(10, 0, 0, True, 1.0), (60, 1, 0, False, 0.0), (60, 0, 5, False, 0.0), (60, 0, 4, True, 0.6), (60, 0, 0, True, 0.1), (60, 0, 0, False, 0.9)]
    df = spark.createDataFrame(rows, "n int, patches int, top_region_count int, shifted boolean, driver_fraction double").coalesce(1)
    assert [r.status for r in shift.attribution(df).collect()] == ["INSUFFICIENT_DATA", "SUSPICIOUS", "SUSPICIOUS", "DRIFT", "INCONCLUSIVE", "PASS"]


def test_local_frames(spark):
    z = [(1, r, 9.0 if r == 5 else 0.5) for r in range(16)] + [(2, r, 6.0) for r in range(16)]
    regions = spark.createDataFrame(z, "frame int, region int, z double")
    whole = spark.createDataFrame([(1, 1.0), (2, 1.0)], "frame int, z double")
    assert [(r.frame, r.region) for r in shift.local_frames(regions, whole).collect()] == [(1, 5)]


def test_near_copies_and_stamped_patch(spark):
    made = images.generated_images(spark, 140).cache()
    links = {(r.a, r.b) for r in images.near_duplicate_images(made.where("id % 7 <> 3"), 48, 48).collect()}
    want = {(i - 1, i) for i in range(140) if i % 10 == 9 and i % 7 != 3 and (i - 1) % 7 != 3}
    assert len(want - links) <= len(want) // 10 and len(links - want) <= 3
    patches = images.recurring_patches(made, 48, 48, 8).collect()
    assert max(patches, key=lambda r: r.members).x in range(38, 43)
    assert images.recurring_patches(made.where("id % 7 <> 3"), 48, 48, 8).count() == 0


def _battery(spark, shift_by=0.0):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.4, (60, 6)) + np.eye(6)[c] * 3 for c in range(3)])
    y = np.repeat(np.arange(3), 60)
    model = models.train_network(x, y, ("a", "b", "c"))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    return x, y, model, df


def test_model_fingerprint_and_substitution(spark):
    x, y, model, df = _battery(spark)
    registered = models.predictions(df, model, "vec_id", "v")
    assert (model.predict(x).argmax(axis=1) == y).mean() > 0.95
    same = models.behaviour(models.predictions(df, model, "vec_id", "v"), registered).first()
    assert (same.agreement, same.changed, same.severity) == (1.0, False, "INFO")
    other = models.train_network(x, (y + 1) % 3, ("a", "b", "c"), seed=1)
    swapped = models.behaviour(models.predictions(df, other, "vec_id", "v"), registered).first()
    assert swapped.changed and swapped.severity == "HIGH" and other.digest() != model.digest()
    assert models.fingerprint_digest(registered).first() != models.fingerprint_digest(models.predictions(df, other, "vec_id", "v")).first()
    rows = [spark.createDataFrame(models.parameter_rows(m), models.PARAMETERS) for m in (model, other)]
    assert models.parameter_drift(rows[0], rows[0]).where("changed").count() == 0
    assert models.parameter_drift(rows[0], rows[1]).where("changed").count() == 4
    registry = spark.createDataFrame([("m", model.digest()), ("n", other.digest())], "model string, sha256 string")
    deployed = spark.createDataFrame([("m", other.digest()), ("n", other.digest()), ("x", "?")], "model string, sha256 string")
    assert {r.model: (r.status, r.severity) for r in models.digest_check(deployed, registry).collect()} == {"m": ("other_version", "HIGH"), "n": ("match", "INFO"), "x": ("unknown", "CRITICAL")}


def test_trigger_flips(spark):
    x, _, model, df = _battery(spark)
    stamped = df.withColumn("v", F.transform("v", lambda e, i: F.when(i == 1, e + 20).otherwise(e)))
    tag = lambda d, m: models.predictions(d, m, "vec_id", "v").withColumn("pattern", F.lit("p"))
    clean = models.predictions(df, model, "vec_id", "v")
    flips = models.flip_rates(clean, tag(stamped, model), ["pattern"])
    control = models.flip_rates(clean, tag(df, model), ["pattern"])
    hit = models.trigger_hits(flips, control, ["pattern"]).first()
    assert hit.hit and hit.target == 1 and hit.severity == "HIGH"


def test_report_holds_until_it_is_edited(spark, tmp_path):
    findings = spark.createDataFrame([("F-001", 1, "dataset", "dataset.ood_samples", "MEDIUM", 0.5, "HEURISTIC")], "id string, ord int, pillar string, category string, severity string, confidence double, method_status string").withColumn("recommendation", F.lit("look"))
    chains = evidence.chains(findings, spark.createDataFrame([], "a string, b string, strength string"))
    audit = spark.createDataFrame([(i, "e") for i in range(1, 200)], "seq long, event_type string")
    made = report.build(evidence.case_of(findings, chains), findings, chains, audit)
    assert report.holds(made) and len(made["audit"]) == 80 and made["case"]["disposition"] == "REVIEW"
    made["case"]["severity"] = "LOW"
    assert not report.holds(made)
    report.save(spark, made, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 1
