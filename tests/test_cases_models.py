import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import cases, models
from probity.plans import catalogue


def test_onnx_gives_what_the_network_gives(spark):
    pytest.importorskip("onnxruntime")
    from probity.operators import onnx_models

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 4)), rng.integers(0, 3, 50)
    network = models.train_network(x, y, ("a", "b", "c"), steps=50)
    model = onnx_models.load("m.ONNX", onnx_models.export(network), network.classes)
    assert np.allclose(model.predict(x), network.predict(x), atol=1e-5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    assert [r.predicted for r in models.predictions(df, model, "vec_id", "v").orderBy("id").collect()] == network.predict(x).argmax(axis=1).tolist()
    with pytest.raises(ValueError):
        onnx_models.load("m.pt", b"", ())


def test_networks_learn_from_every_reference_row(spark, tmp_path, monkeypatch):
    spark.range(8_400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    fit, seen = models.train_network, []
    monkeypatch.setattr(models, "train_network", lambda x, y, *a, **k: seen.append(len(x)) or fit(x, y, *a, steps=2, **k))
    assert catalogue.model_behaviour(spark, str(tmp_path)).first().n == 8_400 and seen == [2_100, 2_100]


def test_gradient_parts_sum_to_the_whole(monkeypatch):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 4)), rng.integers(0, 3, 50)
    whole = models.train_network(x, y, ("a", "b", "c"), steps=20)
    monkeypatch.setattr(models, "FIT_ROWS", 7)
    assert np.allclose(models.train_network(x, y, ("a", "b", "c"), steps=20).predict(x), whole.predict(x))


def test_graph_runs_are_replaced_apart(spark, tmp_path):
    make = lambda run, n: spark.range(n).select(F.concat(F.lit("n:"), "id").alias("id"), F.lit(run).alias("run_id"))
    for run, n in (("r1", 3), ("r2", 2), ("r1", 1)):
        cases.save_graph(make(run, n), make(run, n), str(tmp_path))
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(f"{tmp_path}/nodes").groupBy("run_id").count().collect()} == {("r1", 1), ("r2", 2)}


def test_case_path_by_edges(spark):
    rows = [("s1", "b1", "c1"), ("s2", "b1", "c1"), ("s3", None, "c1")]
    edges = cases.provenance_edges(spark.createDataFrame(rows, "sample string, batch string, contributor string"))
    seeds = spark.createDataFrame([("sample:s1",)], "node string")
    got = {(r.src, r.dst) for r in cases.case_graph(edges, seeds, 2).collect()}
    assert got == {("sample:s1", "batch:b1"), ("sample:s2", "batch:b1"), ("batch:b1", "contributor:c1")}


def test_unknown_disposition_changes_nothing(spark):
    opened = spark.createDataFrame([(1, None, "OPEN", [])], "case_id long, disposition string, status string, history array<string>")
    bad = spark.createDataFrame([(1, 5, "delete", "x")], "case_id long, seq long, disposition string, by string")
    assert tuple(cases.set_dispositions(opened, bad).first()) == (1, None, "OPEN", [])
