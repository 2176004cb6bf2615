"""One assurance run: the findings of all detectors with their evidence, through correlation and chains to case, graph and statuses.

A finding is one typed row. What it rests on (sources, lineage, digests, record numbers, affected assets) is a table of evidence
rows beside it, as a finding may rest on any number of records. Every phase is written once and read by the next.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.ordered import numbered
from probity.functions.scalars import zero_pad
from probity.operators import cases, evidence, graph
from probity.operators.findings import COLUMNS
from probity.sources.storage import materialize

#: What to do about a finding of each category.
STEPS = {
    "dataset.silent_modification": "restore the changed files from the registered manifest", "dataset.duplicate_flooding": "take out the copies and ask their source about them", "dataset.duplicates": "take out the copies",
    "dataset.systematic_mislabelling": "relabel the source by hand before training", "dataset.label_inconsistency": "relabel the source by hand before training", "dataset.isolated_label_review": "look at some of the labels",
    "dataset.ood_samples": "leave the outliers out of training", "dataset.trigger_pattern": "hold the source back and test the model with the pattern", "model.manifest_tampered": "restore the registry",
    "model.substitution": "serve the registered model again", "model.behaviour_change": "assess the model anew", "model.backdoor_behaviour": "hold the model back and train without the source",
    "inference.record_replacement": "restore the records from a replica", "inference.tampering": "restore the records from a replica", "inference.replay": "restore the records from a replica", "inference.replay_blocked": "find the client and change its keys",
    "inference.unregistered_model": "register the model or discard its outputs", "inference.input_mismatch": "discard the outputs on these inputs", "inference.reexecution_mismatch": "discard the outputs that don't come again",
    "inference.chain_broken": "restore the records from a replica", "distribution.localized_manipulation": "look at the frames for stickers", "distribution.environmental_drift": "check the model under the new conditions",
    "distribution.unattributed_shift": "collect more inputs", "governance.audit_tampering": "keep the log as it is and restore it from a copy",
}
#: Assets and numbers of a finding that are shown with it.
SHOWN = 10
ROWS = ("kind", "value", "num")


def part(found: DataFrame, key: Column | str = "", trigger: Column | None = None, candidate: Column | None = None, model: Column | None = None) -> DataFrame:
    """A detector's findings with what correlation needs: key (which tells them apart), trigger, candidate_source, model_digest."""
    none = F.lit(None)
    place = F.struct(F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y")) if trigger is None else trigger
    return found.select(
        *COLUMNS, (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key"), place.alias("trigger"),
        (none if candidate is None else candidate).cast("string").alias("candidate_source"), (none if model is None else model).cast("string").alias("model_digest"),
    )


def rows(df: DataFrame, kind: str, value: Column, key: Column | str = "", num: Column | None = None, once: bool = False) -> DataFrame:
    """Evidence rows of a detector: key, kind, value, num; each once. ``once``: df gives each once already, so their texts needn't be dealt."""
    number = F.lit(None) if num is None else num
    out = df.select((F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), number.cast("long").alias("num"))
    return out if once else out.distinct()


@dataclass
class Detector:
    findings: DataFrame
    rows: list[DataFrame]


@dataclass
class Run:
    """What a run makes, each a written table or derived from one: all have run_id."""

    findings: DataFrame
    rows: DataFrame
    links: DataFrame
    chains: DataFrame
    case: DataFrame
    statuses: DataFrame
    overall: DataFrame


def source_assets(source: Column) -> Column:
    """contributor:a and batch:b of a source a/b; of a name without a slash batch:name."""
    both = F.array(F.concat(F.lit("contributor:"), F.substring_index(source, "/", 1)), F.concat(F.lit("batch:"), F.substring_index(source, "/", -1)))
    return F.when(F.contains(source, F.lit("/")), both).otherwise(F.array(F.concat(F.lit("batch:"), source)))


def collect(run_id: Column, detectors: dict[str, Detector], model_node: Column, stream: str = "cam-01") -> tuple[DataFrame, DataFrame]:
    """findings and evidence rows of a run with ids F-001 on, in the order of the detectors and inside one by severity name, category, source and size.

    Every finding affects something: the assets of its source, or what its pillar is about, and what its detector names.
    """
    typed = [d.findings.withColumns({"detector": F.lit(n), "_at": F.lit(i)}) for i, (n, d) in enumerate(detectors.items())]
    every = reduce(DataFrame.unionByName, typed)
    order = ["_at", F.desc("severity"), "category", "primary_source", F.desc("members"), "key"]
    step = F.element_at(F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair]), F.col("category"))
    ranked = numbered(every, order, "_ord").withColumns({"ord": F.col("_ord").cast("int"), "run_id": run_id, "recommendation": step})
    found = materialize(ranked.select("run_id", zero_pad("F-", F.col("ord"), 3).alias("id"), "ord", "detector", *[c for c in typed[0].columns if c not in ("detector", "_at")], "recommendation"), "findings")
    ids = found.select("run_id", "id", "detector", "key")
    given = [r.withColumn("detector", F.lit(n)) for n, d in detectors.items() for r in d.rows]
    about = F.when(F.col("pillar") == "dataset", "dataset:contributed-dataset").when(F.col("pillar") == "model", model_node).when(F.col("pillar") == "inference", f"stream:{stream}").when(F.col("pillar") == "distribution", "window:current").otherwise(graph.CORE)
    assets = F.when((F.col("pillar") == "dataset") & F.col("primary_source").isNotNull(), source_assets(F.col("primary_source"))).otherwise(F.array(about))
    own = found.select("run_id", "id", F.lit("affected").alias("kind"), F.explode(assets).alias("value"), F.lit(None).cast("long").alias("num"))
    shown = reduce(DataFrame.unionByName, given).join(ids, ["detector", "key"]).select("run_id", "id", *ROWS)
    return found, materialize(own.unionByName(shown), "evidence")


def first_values(rows_: DataFrame, kind: str, n: int = SHOWN) -> DataFrame:
    """run_id, id, values: the first ``n`` values of a kind; Spark keeps no more of each before the shuffle."""
    from pyspark.sql import Window

    by = Window.partitionBy("run_id", "id").orderBy("value")
    some = rows_.where(F.col("kind") == kind).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n)
    return some.groupBy("run_id", "id").agg(F.array_sort(F.collect_list("value")).alias("values"))


def assess(found: DataFrame, rows_: DataFrame, runs: DataFrame) -> Run:
    """Links, chains with their narratives, case, statuses and verdict of findings and their evidence; ``runs`` has run_id and window_size."""
    keys = ["run_id"]
    links = materialize(evidence.correlate(found, keys, rows_), "links")
    parts = evidence.chain_components(links)
    texts = materialize(evidence.chain_texts(found, links, evidence.chains(found, links, keys, parts), keys, parts), "chains")
    opened = evidence.case_of(found, texts, keys)
    case = materialize(opened.join(evidence.case_document(found, rows_, links, texts, keys), keys), "case")
    statuses = materialize(evidence.pillar_status(found, keys, runs), "statuses")
    return Run(found, rows_, links, texts, case, statuses, evidence.overall(statuses, keys))


def run_graph(run: Run, samples: DataFrame, models: DataFrame, deployed: DataFrame, invalid: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a run's evidence graph, with its case; a finding's first assets are drawn."""
    affected = first_values(run.rows, "affected").withColumnRenamed("values", "affected")
    opened = run.case.select("run_id", zero_pad("CASE-", F.col("run_id"), 4).alias("case_id"))
    named = run.findings.select("run_id", "id", "severity").join(affected, ["run_id", "id"], "left").join(opened, "run_id", "left")
    named = materialize(named, "affected")
    found = named.select("id", "affected", F.when(F.col("severity") != "INFO", F.col("case_id")).alias("case_id"))
    pieces = named.select(F.regexp_replace("id", "^F-", "E-").alias("id"), F.col("id").alias("finding_id"), F.col("affected").alias("assets"))
    return graph.build(samples, models, deployed, invalid, found, pieces, run.links.select("a", "b"), scenarios, drawn=graph.DRAWN)


def case_surroundings(edges: DataFrame, run: Run, hops: int = 1) -> DataFrame:
    """The edges around a run's case and its findings."""
    case = run.case.select(F.concat(F.lit("case:"), zero_pad("CASE-", F.col("run_id"), 4)).alias("node"), "findings")
    seeds = case.select("node").union(case.select(F.explode("findings").alias("f")).select(F.concat(F.lit("finding:"), F.col("f"))))
    return cases.case_graph(edges, seeds, hops)
