"""Reading and updating cases, graphs and logs: projections, follow-up events, dispositions, the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import ordered
from probity.functions.scalars import zero_pad
from probity.operators.components import induced, neighbourhood
from probity.sources.storage import few

#: Dispositions, and the event types that a timeline shows.
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")
TIMELINE = ("dataset.", "model.", "attacklab.", "assurance.", "finding.", "evidence.", "inference.", "case.", "ingest.")
SUMMARY = ("id", "pillar", "category", "title", "severity", "confidence", "method_status")


def starts_with_any(column: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | column.startswith(p)
    return out


def timeline(audit: DataFrame, since: int = 0) -> DataFrame:
    """Rows of the log after ``since`` of a type that timelines show; the range reaches the scan."""
    return audit.where((F.col("seq") > since) & starts_with_any(F.col("event_type"), TIMELINE))


def summaries(findings: DataFrame) -> DataFrame:
    return findings.select(*[c for c in SUMMARY if c in findings.columns])


def evidence_of(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding, place, evidence_id, sha256: a row for each piece of evidence that a finding names, in its order; missing ones have a null digest."""
    named = findings.select(F.col("id").alias("finding"), F.posexplode("evidence").alias("place", "evidence_id"))
    return named.join(evidence.select(F.col("id").alias("evidence_id"), "sha256"), "evidence_id", "left").select("finding", "place", "evidence_id", "sha256")


def follow_ups(audit: DataFrame, cases: DataFrame, affected: DataFrame) -> DataFrame:
    """case_id, seq, event_type: events after a case was opened that name it, or verify what it affects.

    cases has case_id, opened (seq); affected has case_id, asset. An event is given once for each case.
    """
    later = audit.select("seq", "event_type", "asset")
    own = later.join(cases.select("case_id", "opened"), F.col("asset") == F.col("case_id"))
    touched = affected.join(cases, "case_id").select("case_id", "opened", F.col("asset").alias("_asset"))
    checks = later.where("event_type = 'inference.verified'").join(touched, F.col("asset") == F.col("_asset"))
    both = own.select("case_id", "opened", "seq", "event_type").union(checks.select("case_id", "opened", "seq", "event_type"))
    return both.where(F.col("seq") > F.col("opened")).select("case_id", "seq", "event_type").distinct()


def case_graph(edges: DataFrame, seeds: DataFrame, hops: int = 2, hubs: tuple[str, ...] = ("dataset:", "model:")) -> DataFrame:
    """Edges among the nodes around a case; hubs are shown but not walked through."""
    return induced(edges, neighbourhood(edges, seeds, hops, hubs).select("node"))


def set_dispositions(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """cases (case_id, disposition, status, history) after decisions (case_id, seq, disposition, by), the last of each case in force.

    All decisions go to the history in their order; one that isn't in the vocabulary, in any case of letters, changes nothing.
    """
    known = decisions.withColumn("disposition", F.upper(F.trim("disposition"))).where(F.col("disposition").isin(*DISPOSITIONS))
    per = known.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "disposition", "by"))).alias("_new"))
    last = F.element_at("_new", -1)["disposition"]
    status = F.when(last == "ACCEPT", "CLOSED").when(last == "QUARANTINE", "QUARANTINED").otherwise("UNDER REVIEW")
    out = cases.join(per, "case_id", "left")
    return out.select(
        "case_id", F.when(F.col("_new").isNotNull(), last).otherwise(F.col("disposition")).alias("disposition"),
        F.when(F.col("_new").isNotNull(), status).otherwise(F.col("status")).alias("status"),
        F.concat("history", F.coalesce(F.transform("_new", lambda x: F.concat_ws(":", x["seq"], x["disposition"], x["by"])), F.array().cast("array<string>"))).alias("history"),
    )


def disposition_events(decisions: DataFrame) -> DataFrame:
    """seq, event_type, actor, asset, details of the log's rows that record decisions (case_id, seq, disposition, by) which took effect."""
    known = decisions.withColumn("disposition", F.upper(F.trim("disposition"))).where(F.col("disposition").isin(*DISPOSITIONS))
    return known.select("seq", F.lit("case.disposition_set").alias("event_type"), F.col("by").alias("actor"), F.concat(F.lit("case:"), "case_id").alias("asset"), F.to_json(F.struct("disposition")).alias("details"))


def provenance_edges(samples: DataFrame) -> DataFrame:
    """src, dst, rel from samples (sample, batch, contributor): sample to batch to contributor, each edge once."""
    ok = samples.where(F.col("batch").isNotNull())
    up = ok.select(F.concat(F.lit("sample:"), "sample").alias("src"), F.concat(F.lit("batch:"), "batch").alias("dst"), F.lit("PART_OF").alias("rel"))
    by = ok.where(F.col("contributor").isNotNull()).select(F.concat(F.lit("batch:"), "batch").alias("src"), F.concat(F.lit("contributor:"), "contributor").alias("dst"), F.lit("CONTRIBUTED_BY").alias("rel")).distinct()
    return up.unionByName(by)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the partitions of the runs (run_id) that are saved, leaving other runs."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def reexecution(records: DataFrame, outputs: DataFrame, registered: DataFrame) -> DataFrame:
    """record_id, check: pass or fail of a record's label against a new run of its registered model, else skipped.

    records has record_id, input_ok, model_sha256, label; outputs has record_id, label; registered has sha256.
    Only records whose input was verified are compared.
    """
    models = registered.select(F.col("sha256").alias("model_sha256"), F.lit(True).alias("_has")).distinct()
    joined = records.join(few(models), "model_sha256", "left").join(outputs.select("record_id", F.col("label").alias("_again")), "record_id", "left")
    can = F.coalesce("input_ok", F.lit(False)) & F.col("_has").isNotNull() & F.col("_again").isNotNull()
    return joined.select("record_id", F.when(~can, "skipped").when(F.col("label") == F.col("_again"), "pass").otherwise("fail").alias("check"))


def run_bounds(runs: DataFrame, stream: str, started: str) -> DataFrame:
    """``runs`` with run_id, and since_seq: where the log of the run before ended (audit_seq_end), 0 for the first."""
    by = Window.partitionBy(stream).orderBy(started)
    return runs.withColumns({"run_id": zero_pad("RUN-", F.row_number().over(by), 4), "since_seq": F.coalesce(F.lag("audit_seq_end").over(by), F.lit(0)).cast("long")})


def ring_page(items: DataFrame, order: str, cursor: int, count: int) -> DataFrame:
    """i, idx and the columns of ``count`` items from place ``cursor`` on, counted from 0 in ``order``, going on at the start after the end.

    Items are numbered over all partitions, and only the wanted numbers are kept.
    """
    rows = ordered.numbered(items, [order], "idx", first=0)
    n = rows.count()
    if not n:
        return rows.select(F.col("idx").alias("i"), "*")
    wanted = items.sparkSession.range(count).select(F.col("id").alias("i"), ((F.lit(cursor) + F.col("id")) % n).alias("idx"))
    return F.broadcast(wanted).join(rows, "idx")


def coverage(checks: DataFrame, key: str) -> DataFrame:
    """key, status, n, n_real of what was checked and how."""
    return checks.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("method_status") == "REAL").cast("long")).alias("n_real"))


def assessment(findings: DataFrame, limits: DataFrame) -> DataFrame:
    """case_id, known (proofs), suspected (scores), not_proven: what a case's findings (case_id, category, method_status) do not show.

    limits has category, does_not_prove.
    """
    joined = findings.join(F.broadcast(limits), "category", "left")
    real = F.col("method_status") == "REAL"
    return joined.groupBy("case_id").agg(F.count(F.when(real, 1)).alias("known"), F.count(F.when(~real, 1)).alias("suspected"), F.array_sort(F.collect_set("does_not_prove")).alias("not_proven"))
