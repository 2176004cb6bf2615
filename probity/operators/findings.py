"""Detectors: measures to findings. Each returns rows of one shape, so that runs are unions of them.

A finding says what was seen (pillar, category), how serious and how sure it is, by which kind of method (REAL: a proof,
HEURISTIC: a score without calibration), the source that most of it comes from, and how many members it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import ordered, stats
from probity.functions.scalars import FAILURE_PRIORITY, severity_rank, zero_pad
from probity.operators.samples import P_CONCENTRATED, SHARE_CONCENTRATED, mode_first
from probity.sources.storage import materialize

COLUMNS = ("pillar", "category", "severity", "confidence", "method_status", "primary_source", "members")
#: Sizes and shares from which copies are flooding, patterns systematic and outliers concentrated.
LARGE_CLUSTER, FLOOD_SHARE = 5, 0.05
SYSTEMATIC, STRONG_P = 0.6, 1e-6
OOD_CONCENTRATED, OOD_MANY = 0.2, 10
DIRTY_LABEL, DIRTY_DISAGREE = 0.9, 0.3
LEAST_CLUSTERS = 8
#: The finding that a group of invalid records raises.
RECORD_FINDINGS = {
    "FORGED_RECORD": ("inference.record_replacement", "CRITICAL"), "TAMPERED_OUTPUT": ("inference.tampering", "HIGH"), "TAMPERED_RECORD": ("inference.tampering", "HIGH"),
    "TAMPERED_CONFIG": ("inference.tampering", "HIGH"), "REPLAY": ("inference.replay", "HIGH"), "MODEL_MISMATCH": ("inference.unregistered_model", "HIGH"),
    "INPUT_MISMATCH": ("inference.input_mismatch", "HIGH"), "REEXEC_MISMATCH": ("inference.reexecution_mismatch", "MEDIUM"), "CHAIN_BROKEN": ("inference.chain_broken", "HIGH"),
}


def _score(c: Column) -> Column:
    """Two places; first to nine, so that halves fall the same way on any engine."""
    return F.round(F.round(c, 9), 2)


def _finding(df: DataFrame, pillar: str, category: Column | str, severity: Column | str, confidence: Column | float, method: str, source: Column, members: Column, *more: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        F.lit(pillar).alias("pillar"), lit(category).alias("category"), lit(severity).alias("severity"), _score(lit(confidence).cast("double")).alias("confidence"),
        F.lit(method).alias("method_status"), source.cast("string").alias("primary_source"), members.cast("long").alias("members"), *more,
    )


def _top_source(members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, source, n of the most frequent source of members (id, source); on a tie the one met first."""
    keys = keys or []
    per = members.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("f"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("source", "n"), F.struct("n", (-F.col("f")).alias("f"))).alias("b"))
    return best.select(*keys, F.col("b.source").alias("source"), F.col("b.n").alias("n"))


def duplicates(samples: DataFrame, clusters: DataFrame, exact: DataFrame) -> DataFrame:
    """One finding on copies, with the number of clusters and the largest; none without a cluster.

    samples has id, source; clusters has node, component of everything that has a copy; exact has a row for each content
    that is there more than once.
    """
    member = samples.join(clusters.withColumnsRenamed({"node": "id", "component": "cluster"}), "id")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))
    total = samples.agg(F.count(F.lit(1)).alias("n_all"))
    proof = exact.agg((F.count(F.lit(1)) > 0).alias("exact"))
    one = whole.where("clusters > 0")
    for side in (total, proof, _top_source(member).select(F.col("source").alias("top"))):
        one = one.join(F.broadcast(side))
    share = F.col("members") / F.col("n_all")
    flood = (F.col("largest") >= LARGE_CLUSTER) | (share > FLOOD_SHARE)
    severity = F.when(share > FLOOD_SHARE, "HIGH").when(flood, "MEDIUM").otherwise("LOW")
    category = F.when(flood, "dataset.duplicate_flooding").otherwise("dataset.duplicates")
    return _finding(one, "dataset", category, severity, F.when(F.col("exact"), 0.95).otherwise(0.85), "HEURISTIC", F.col("top"), F.col("members"), F.col("clusters"), F.col("largest"))


def source_labels(votes: DataFrame, sources: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per source with a flag: n, k, p_value, concentrated, given, suspected (the most frequent pair), pair_share, systematic, mean_share.

    votes has query_id, given, majority, share, flagged; sources has query_id, source; baseline one row (baseline).
    """
    named = votes.join(sources, "query_id")
    per = named.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("long")).alias("k"), F.avg(F.when(F.col("flagged"), F.col("share"))).alias("mean_share")).where("k > 0")
    pairs = named.where("flagged").groupBy("source", "given", "majority").agg(F.count(F.lit(1)).alias("c"), F.min("query_id").alias("f"))
    best = pairs.groupBy("source").agg(F.max_by(F.struct("given", "majority", "c"), F.struct("c", (-F.col("f")).alias("f"))).alias("b"))
    tested = per.join(F.broadcast(baseline)).withColumn("p_value", stats.binomial_tail("k", "n", "baseline")).join(best, "source")
    concentrated = (F.col("p_value") < P_CONCENTRATED) & (F.col("k") / F.col("n") >= SHARE_CONCENTRATED)
    share = F.col("b.c") / F.col("k")
    return tested.select("source", "n", "k", "p_value", concentrated.alias("concentrated"), F.col("b.given").alias("given"), F.col("b.majority").alias("suspected"), share.alias("pair_share"), (share >= SYSTEMATIC).alias("systematic"), "mean_share")


def label_consistency(per: DataFrame) -> DataFrame:
    """A finding for each concentrated source of ``source_labels``, the least probable first (place)."""
    sure = F.col("p_value") < STRONG_P
    severity = F.when((F.col("k") / F.col("n") >= 0.3) & sure, "HIGH").otherwise("MEDIUM")
    category = F.when(F.col("systematic"), "dataset.systematic_mislabelling").otherwise("dataset.label_inconsistency")
    confidence = F.least(F.lit(0.95), F.col("mean_share") * F.when(sure, 1.0).otherwise(0.8))
    found = ordered.numbered(per.where("concentrated"), ["p_value", "source"], "place")
    return _finding(found, "dataset", category, severity, confidence, "HEURISTIC", F.col("source"), F.col("k"), F.col("place").cast("int").alias("place"))


def isolated_labels(per: DataFrame) -> DataFrame:
    """One finding for review on the flags that are in no concentrated source; none without any."""
    rest = per.agg(F.sum(F.when(~F.col("concentrated"), F.col("k")).otherwise(0)).alias("k")).where("k > 0")
    return _finding(rest, "dataset", "dataset.isolated_label_review", "INFO", 0.3, "HEURISTIC", F.lit(None), F.col("k"))


def calibration(reference: DataFrame, labels: DataFrame, share: float = 0.995, near: float = 1.1, spread: float = 1.5) -> DataFrame:
    """One row: baseline, near_limit, spread_limit of a trusted reference, by leaving each vector out.

    reference has distance (mean distance to the nearest) and spread (distance from the mean); labels has baseline.
    The limits are the interpolated percentile ``share`` of each, with a margin.
    """
    one = stats.exact_percentiles(reference, "distance", [share]).select((F.col("p")[0] * near).alias("near_limit"))
    two = stats.exact_percentiles(reference, "spread", [share]).select((F.col("p")[0] * spread).alias("spread_limit"))
    return labels.select("baseline").join(F.broadcast(one)).join(F.broadcast(two))


def out_of_distribution(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` (id, source, distance, spread) with ood: over either limit of ``calibration``."""
    joined = measured.join(F.broadcast(limits.select("near_limit", "spread_limit")))
    return joined.withColumn("ood", (F.col("distance") > F.col("near_limit")) | (F.col("spread") > F.col("spread_limit"))).drop("near_limit", "spread_limit")


def ood_finding(marked: DataFrame) -> DataFrame:
    """One finding on outliers (id, source, ood); none without any."""
    sizes = marked.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    top = _top_source(marked.where("ood")).join(sizes, "source").select("source", "n", "all")
    whole = marked.agg(F.sum(F.col("ood").cast("long")).alias("members")).join(F.broadcast(top)).where("members > 0")
    share = F.col("n") / F.col("all")
    severity = F.when((share >= OOD_CONCENTRATED) | (F.col("members") >= OOD_MANY), "MEDIUM").otherwise("LOW")
    return _finding(whole, "dataset", "dataset.ood_samples", severity, F.least(F.lit(0.9), 0.5 + 0.4 * share), "HEURISTIC", F.col("source"), F.col("members"), F.round(share, 9).alias("share"))


def pattern_members(spots: DataFrame, samples: DataFrame) -> DataFrame:
    """The samples (all their columns) of each pattern (columns of ``spots`` but id) that enough clusters hold at the same place, with clusters; written.

    samples has id, source, label, flagged (its label disagrees) and cluster (of copies, which share patterns trivially and
    count once). A pattern needs max(8, n // 100) clusters of the n samples. Spots are counted by partial sums of a hash of their pattern
    first, and only those whose hash has so many rows meet their samples; two patterns of one hash are told apart by their clusters.
    """
    keys = [c for c in spots.columns if c != "id"]
    least = max(LEAST_CLUSTERS, samples.count() // 100)
    hashed = spots.withColumn("_hash", F.xxhash64(*keys))
    often = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_hash")
    held = materialize(hashed.join(materialize(often, "often"), "_hash").drop("_hash").distinct().join(samples, "id"), "held")
    counted = held.groupBy(*keys, "cluster").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"))
    return materialize(held.join(counted.where(F.col("clusters") >= least), keys), "members")


def recurring_pattern(spots: DataFrame, samples: DataFrame) -> DataFrame:
    """A finding for each pattern of ``pattern_members``."""
    return pattern_findings(pattern_members(spots, samples), [c for c in spots.columns if c != "id"])


def pattern_findings(kept: DataFrame, keys: list[str]) -> DataFrame:
    """A finding for each pattern (``keys``) of its members; the label most of them have and the share that disagree tell a poisoned label from a watermark."""
    whole = kept.groupBy(*keys, "clusters").agg(F.count(F.lit(1)).alias("members"), F.sum(F.coalesce(F.col("flagged"), F.lit(False)).cast("long")).alias("disagree"))
    label = mode_first(kept, keys, "label", "id").withColumnsRenamed({"mode": "target", "votes": "target_n"})
    top = _top_source(kept, keys).select(*keys, F.col("source").alias("top"))
    out = whole.join(label, keys).join(top, keys)
    dirty = (F.col("target_n") / F.col("members") >= DIRTY_LABEL) & (F.col("disagree") / F.col("members") >= DIRTY_DISAGREE)
    return _finding(out, "dataset", "dataset.trigger_pattern", F.when(dirty, "HIGH").otherwise("MEDIUM"), F.when(dirty, 0.85).otherwise(0.55), "HEURISTIC", F.col("top"), F.col("members"), *keys, F.col("clusters"), F.col("target").cast("string").alias("target"), F.col("disagree"))


def manifest_finding(change: DataFrame) -> DataFrame:
    """One finding if files (key, change) were modified or removed; added ones alone raise none."""
    n = lambda kind: F.sum((F.col("change") == kind).cast("long"))
    one = change.agg(n("modified").alias("modified"), n("removed").alias("removed"), n("added").alias("added")).where("modified + removed > 0")
    return _finding(one, "dataset", "dataset.silent_modification", "HIGH", 1.0, "REAL", F.lit(None), F.col("modified") + F.col("removed"), F.col("modified"), F.col("removed"), F.col("added"))


def registry_findings(deployed: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings (and the model they are on) of deployed models (model, sha256) against a registry (model, sha256, signature_ok).

    A manifest whose signature fails is tampered with; a digest that isn't the registered one is a substitution, less
    grave if it is another registered version. A model that isn't registered has no entry to compare with and raises none.
    """
    own = deployed.join(registry.select("model", F.col("sha256").alias("registered"), F.coalesce("signature_ok", F.lit(False)).alias("ok")), "model")
    known = registry.select(F.col("sha256"), F.lit(True).alias("known")).distinct()
    signed = _finding(own.where(~F.col("ok")), "model", "model.manifest_tampered", "CRITICAL", 1.0, "REAL", F.lit(None), F.lit(1), F.col("model"))
    other = own.where(~F.col("sha256").eqNullSafe(F.col("registered"))).join(known, "sha256", "left")
    return signed.unionByName(_finding(other, "model", "model.substitution", F.when(F.col("known"), "HIGH").otherwise("CRITICAL"), 1.0, "REAL", F.lit(None), F.lit(1), F.col("model")))


def behaviour_finding(compared: DataFrame) -> DataFrame:
    """A finding for each row (agreement, mean_change, changed) whose behaviour changed."""
    severity = F.when(F.col("agreement") < 0.9, "HIGH").otherwise("MEDIUM")
    return _finding(compared.where("changed"), "model", "model.behaviour_change", severity, F.least(F.lit(1.0), (1 - F.col("agreement")) * 5 + 0.5), "REAL", F.lit(None), F.col("n"))


def trigger_finding(best: DataFrame) -> DataFrame:
    """A finding on the best trigger test (flip, control, hit) if it is a hit."""
    severity = F.when(F.col("flip") >= 0.75, "HIGH").otherwise("MEDIUM")
    return _finding(best.where("hit"), "model", "model.backdoor_behaviour", severity, F.least(F.lit(0.9), F.col("flip") - F.col("control")), "HEURISTIC", F.col("candidate_source"), F.col("n"))


def record_findings(verdicts: DataFrame) -> DataFrame:
    """A finding for each primary category of invalid records, in order of priority, with the first number; ``record_numbers`` has all of them."""
    per = verdicts.where("verdict = 'INVALID'").groupBy("primary_category").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.countDistinct("stream").alias("streams"))
    named = F.create_map(*[x for c, (category, severity) in RECORD_FINDINGS.items() for x in (F.lit(c), F.struct(F.lit(category).alias("c"), F.lit(severity).alias("s")))])
    got = per.withColumn("_f", F.element_at(named, F.col("primary_category")))
    place = F.array_position(F.array(*map(F.lit, FAILURE_PRIORITY)), F.col("primary_category")).cast("long")
    return _finding(got, "inference", F.col("_f.c"), F.col("_f.s"), 1.0, "REAL", F.lit(None), F.col("n"), F.col("primary_category"), place.alias("place"), F.col("first_seq"), F.col("streams"))


def record_numbers(verdicts: DataFrame) -> DataFrame:
    """primary_category, stream, seq of every invalid record: what tells a replaced record s from the broken link of s + 1."""
    return verdicts.where("verdict = 'INVALID'").select("primary_category", "stream", "seq").distinct()


def rejected_finding(log: DataFrame) -> DataFrame:
    """One finding if submissions (record_id, accepted) were refused at ingest."""
    one = log.agg(F.sum((~F.col("accepted")).cast("long")).alias("n")).where("n > 0")
    return _finding(one, "inference", "inference.replay_blocked", "MEDIUM", 1.0, "REAL", F.lit(None), F.col("n"))


def shift_findings(windows: DataFrame) -> DataFrame:
    """A finding for each window (status, driver_fraction, matched, members) that isn't at rest.

    A local pattern weighs more if it lies where a pattern of the training data does (``matched``).
    """
    local, drift = F.col("status") == "SUSPICIOUS", F.col("status") == "DRIFT"
    matched = F.coalesce(F.col("matched"), F.lit(False))
    category = F.when(local, "distribution.localized_manipulation").when(drift, "distribution.environmental_drift").otherwise("distribution.unattributed_shift")
    confidence = F.when(local, F.when(matched, 0.8).otherwise(0.5)).when(drift, F.least(F.lit(0.9), 0.5 + 0.4 * F.col("driver_fraction"))).otherwise(0.5)
    kept = windows.where(F.col("status").isin("SUSPICIOUS", "DRIFT", "INCONCLUSIVE"))
    return _finding(kept, "distribution", category, F.when(local & matched, "HIGH").otherwise("MEDIUM"), confidence, "HEURISTIC", F.lit(None), F.col("members"), *[F.col(c) for c in windows.columns if c not in ("status", "driver_fraction", "matched", "members")])


def audit_finding(report: DataFrame) -> DataFrame:
    """A finding if the log (``records.audit_report``) isn't whole."""
    return _finding(report.where(~F.col("valid")), "governance", "governance.audit_tampering", "CRITICAL", 1.0, "REAL", F.lit(None), F.col("n_problems"))


def collect_run(parts: list[DataFrame], order: list[str] | None = None) -> DataFrame:
    """All findings of a run with ids F-001 on, in the order of the parts and, inside one, of ``order``.

    ``order`` must part the rows of a part.
    """
    every = reduce(DataFrame.unionByName, [p.select(*COLUMNS, F.lit(i).alias("_detector")) for i, p in enumerate(parts)])
    by = ["_detector", *(order or [F.desc("severity"), "category", "primary_source", F.desc("members")])]
    ranked = ordered.numbered(every, by, "_ord").withColumn("ord", F.col("_ord").cast("int"))
    return ranked.select(zero_pad("F-", F.col("ord"), 3).alias("id"), "ord", *COLUMNS)


def by_severity(findings: DataFrame, *columns: str) -> DataFrame:
    """Findings with their place by severity, the highest first, then by id."""
    w = Window.orderBy(severity_rank(F.col("severity")).desc(), "id")
    return findings.select("id", *columns, F.row_number().over(w).alias("place"))


def checks(rows: dict[str, tuple[str, str, str]], spark) -> DataFrame:
    """pillar, check, status (ran, unavailable, not_implemented, skipped), method_status of what a run did."""
    return spark.createDataFrame([(p, c, s, m) for c, (p, s, m) in rows.items()], "pillar string, check string, status string, method_status string")
