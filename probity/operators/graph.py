"""The evidence graph of a run: nodes (id, type, label) and edges (src, dst, rel), all made by joins and unions of tables.

Node ids are ``kind:name``. An edge stays only if both its ends exist and differ, one of each (src, dst, rel).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.operators.components import by_end, insert_edges
from probity.sources.storage import materialize

#: The kinds of nodes by the prefix of their id, and the relations.
KINDS = {
    "assurance": "AssuranceCore", "dataset": "Dataset", "contributor": "Contributor", "batch": "Batch", "sample": "Sample", "model": "Model", "modelver": "ModelVersion",
    "stream": "Stream", "window": "ObservationWindow", "inference": "InferenceRecord", "finding": "Finding", "evidence": "Evidence", "case": "Case", "scenario": "AttackScenario",
}
RELATIONS = ("verified_by", "contributed_by", "belongs_to", "derived_from", "produced_by", "affects", "violates", "correlates_with")
#: Kinds that an asset may have without a table of its own, and the assets of a piece of evidence that a drawing for people shows.
ASSETS = ("dataset", "contributor", "batch", "sample", "model", "modelver", "inference", "stream", "window")
DRAWN = 8
CORE = "assurance:core"


def _id(kind: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(name) if isinstance(name, str) else name).cast("string"))


def _edge(df: DataFrame, src: Column, dst: Column, rel: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))


def kind_of(node: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.substring_index(node, ":", 1))


def build(
    samples: DataFrame, models: DataFrame, deployed: DataFrame, invalid: DataFrame, findings: DataFrame, evidence: DataFrame, links: DataFrame, scenarios: DataFrame,
    dataset: str = "contributed-dataset", stream: str = "cam-01", drawn: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (src, dst, rel).

    samples has sample, batch, contributor; models (the registry) model_id, sha256, previous_version, new_sources; deployed one
    row sha256; invalid (records) record_id, model_sha256; findings id, affected (asset ids), case_id (null without a case);
    evidence id, finding_id, assets; links a, b; scenarios id, touched. A record whose digest isn't registered hangs on
    the deployed version if it is that one's. Assets without a table get a node of the kind their prefix names; unknown kinds none.
    A piece of evidence is tied to all its assets, or to the first ``drawn`` of them for a drawing.
    """
    spark = samples.sparkSession
    data, line, window = F.lit(f"dataset:{dataset}"), F.lit(f"stream:{stream}"), F.lit("window:current")
    sourced = samples.where(F.col("contributor").isNotNull())
    active = deployed.join(models.select("sha256", "model_id"), "sha256", "left").select(
        F.coalesce(_id("model", "model_id"), _id("modelver", F.substring("sha256", 1, 12))).alias("node"), "sha256"
    )
    affects = findings.select("id", F.explode("affected").alias("asset"))
    shown = evidence.select("id", F.explode("assets" if drawn is None else F.slice("assets", 1, drawn)).alias("asset"))
    touched = scenarios.select("id", F.explode("touched").alias("asset"))
    of_batch = sourced.select(_id("sample", "sample").alias("asset"), _id("batch", "batch").alias("batch")).distinct()

    named = [spark.range(1).select(F.explode(F.array(F.lit(CORE), data, line, window)).alias("id"))]
    named += [sourced.select(_id("contributor", "contributor").alias("id")), sourced.select(_id("batch", "batch"))]
    named += [models.select(_id("model", "model_id")), active.select("node"), models.select(F.explode("new_sources").alias("b")).select(_id("batch", "b"))]
    named += [invalid.select(_id("inference", "record_id")), findings.select(_id("finding", "id")), evidence.select(_id("evidence", "id"))]
    named += [findings.where(F.col("case_id").isNotNull()).select(_id("case", "case_id")), scenarios.select(_id("scenario", "id"))]
    named += [x.select("asset").where(F.substring_index("asset", ":", 1).isin(*ASSETS)) for x in (affects, shown, touched)]
    ids = reduce(DataFrame.union, named).distinct().where(F.col("id").isNotNull())
    nodes = materialize(ids.select("id", kind_of(F.col("id")).alias("type"), F.substring(F.col("id"), F.length(F.substring_index("id", ":", 1)) + 2, 1 << 20).alias("label")), "nodes")

    core = F.lit(CORE)
    one = spark.range(1)
    failed = invalid.join(models.select(F.col("sha256").alias("model_sha256"), "model_id"), "model_sha256", "left").join(F.broadcast(active.select(F.col("sha256").alias("_d"), "node")), F.col("model_sha256") == F.col("_d"), "left")
    edges = [
        _edge(one, data, core, "verified_by"), _edge(one, line, core, "verified_by"), _edge(one, window, line, "belongs_to"),
        _edge(sourced, _id("batch", "batch"), _id("contributor", "contributor"), "contributed_by"), _edge(sourced, _id("batch", "batch"), data, "belongs_to"),
        _edge(models, _id("model", "model_id"), core, "verified_by"), _edge(models, _id("model", "model_id"), _id("model", "previous_version"), "derived_from"), _edge(models, _id("model", "model_id"), data, "derived_from"),
        _edge(models.select("model_id", F.explode("new_sources").alias("b")), _id("model", "model_id"), _id("batch", "b"), "derived_from"),
        _edge(active, F.col("node"), core, "verified_by"), _edge(active, line, F.col("node"), "produced_by"),
        _edge(invalid, _id("inference", "record_id"), line, "belongs_to"), _edge(failed, _id("inference", "record_id"), F.coalesce(_id("model", "model_id"), F.col("node")), "produced_by"),
        _edge(affects, _id("finding", "id"), F.col("asset"), "affects"), _edge(affects.where("asset like 'inference:%'"), F.col("asset"), line, "belongs_to"),
        _edge(affects.where("asset like 'inference:%'"), F.col("asset"), _id("finding", "id"), "violates"),
        _edge(affects.select("asset").union(shown.select("asset")).distinct().join(of_batch, "asset"), F.col("asset"), F.col("batch"), "belongs_to"),
        _edge(evidence, _id("finding", "finding_id"), _id("evidence", "id"), "verified_by"), _edge(shown, _id("evidence", "id"), F.col("asset"), "derived_from"),
        _edge(links, _id("finding", "a"), _id("finding", "b"), "correlates_with"), _edge(touched, _id("scenario", "id"), F.col("asset"), "affects"),
        _edge(findings, _id("finding", "id"), _id("case", "case_id"), "belongs_to"),
    ]
    every = reduce(DataFrame.union, edges).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return nodes, insert_edges(nodes.select(F.col("id").alias("node")), every)


def without_kind(nodes: DataFrame, edges: DataFrame, kind: str = "Sample") -> DataFrame:
    """Edges that don't touch nodes of a kind: samples are left out before a case's surroundings are taken."""
    hidden = nodes.where(F.col("type") == kind).select(F.col("id").alias("node"))
    left = materialize(by_end(materialize(edges, "ends"), hidden, "src", "left_anti"), "starts")
    return by_end(left, hidden, "dst", "left_anti")


def load(spark, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one run that ``cases.save_graph`` wrote; the run's partitions alone are read."""
    return tuple(spark.read.parquet(f"{path}/{n}").where(F.col("run_id") == run_id) for n in ("nodes", "edges"))
