"""Case reports and registry manifests as canonical JSON with an integrity block; signing is done where the keys are."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators.records import set_digest

#: The log's last rows that a report shows, and the most rows of a list that it holds itself; longer ones go to a table beside it.
AUDIT_ROWS, INLINE = 80, 10_000


def canonical(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def with_integrity(body: dict) -> dict:
    """``body`` with the digest of its canonical form, which doesn't cover the digest itself."""
    rest = {k: v for k, v in body.items() if k != "integrity"}
    return rest | {"integrity": {"algorithm": "sha256", "digest": hashlib.sha256(canonical(rest)).hexdigest()}}


def holds(report: dict) -> bool:
    return with_integrity(report)["integrity"] == report.get("integrity")


def _rows(name: str, df: DataFrame, beside: str | None) -> list | dict:
    """The rows of a table, or where they were written and their digest."""
    n = df.count()
    if n <= INLINE:
        return [r.asDict(recursive=True) for r in df.collect()]
    if beside is None:
        raise ValueError(f"{n} {name} don't fit into a report; name a folder for them")
    df.write.mode("overwrite").parquet(f"{beside}/{name}")
    whole = set_digest(df.select(F.to_json(F.struct("*")).alias("j")), F.col("j"), F.lit("")).first()
    return {"rows": n, "folder": f"{beside}/{name}", "digest": whole.digest}


def build(case: DataFrame, findings: DataFrame, chains: DataFrame, audit: DataFrame, beside: str | None = None) -> dict:
    """A report of one case: all findings and chains, the last audit rows.

    A list of more than ``INLINE`` rows is written whole to the folder ``beside`` and named in the report with its rows and
    an order-independent digest; without such a folder it is an error, never a cut list.
    """

    def rows(name: str, df: DataFrame) -> list | dict:
        return _rows(name, df, beside)

    row = case.first()
    last = audit.orderBy(F.col("seq").desc()).limit(AUDIT_ROWS).collect()
    body = {
        "schema": "probity.report/1",
        "case": row.asDict(recursive=True) if row else None,
        "findings": rows("findings", findings.orderBy("ord")),
        "chains": rows("chains", chains.orderBy("place")),
        "audit": sorted((r.asDict(recursive=True) for r in last), key=lambda r: r["seq"]),
        "not_claimed": ["identity or intent of a contributor", "a calibrated probability of compromise"],
    }
    return with_integrity(body)


#: Parts of a run's report that are tables a caller may give, by the part they belong to.
TABLES = {
    "dataset": ("summary", "manifest", "source_table", "calibration"), "model": ("deployed", "fingerprint", "version_diff", "trigger_tests", "parameter_deltas", "activation_stats"),
    "distribution": ("tests", "window", "local_frames"), "inference": ("categories", "invalid", "rejected"),
}
#: Texts that belong to every report.
ASSUMPTIONS = ("the trusted reference is clean", "keys of trusted signers are not compromised", "the registry was filled before the first contribution")
LIMITATIONS = ("scores are not calibrated probabilities", "patterns are searched at fixed places", "who changed a record is not determined")


def of_run(run, report_id: str, generated_at: str, audit: DataFrame, tables: dict[str, DataFrame] | None = None, checks: DataFrame | None = None, coverage: DataFrame | None = None, scenarios: DataFrame | None = None, sign: Callable[[str], str] | None = None, beside: str | None = None) -> dict:
    """A report of a whole run (``assurance.Run``), signed over its digest if ``sign`` is given.

    It has the case, the assessment, what was found and on which evidence, correlations, the log's last rows, checks, capabilities, attack classes,
    assumptions and limitations, and the parts of ``TABLES`` that are given (part.name to table), the others as null. Lists of more than ``INLINE`` rows go to ``beside``, as in ``build``.
    """
    tables = dict(tables or {})
    known = {f"{part}.{name}" for part, names in TABLES.items() for name in names}
    if strange := set(tables) - known:
        raise ValueError(f"no part of a report: {sorted(strange)}")
    listed_ = lambda name, df: None if df is None else _rows(name, df, beside)
    first = lambda df: None if df is None or not (r := df.first()) else r.asDict(recursive=True)
    case, overall = first(run.case), first(run.overall)
    last = audit.orderBy(F.col("seq").desc()).limit(AUDIT_ROWS).collect()
    classes = coverage.select("capability", (F.col("status") == "ran").alias("supported")) if coverage is not None else None
    body = {
        "schema": "probity.run-report/1", "report_id": report_id, "generated_at": generated_at, "generator": {"name": "probity", "mode": "offline"},
        "case": case, "assessment": {"run_id": overall and overall["run_id"], "overall": overall and overall["overall"], "pillars": listed_("pillars", run.statuses.orderBy("pillar"))},
        **{part: {name: listed_(f"{part}-{name}", tables.get(f"{part}.{name}")) for name in names} for part, names in TABLES.items()},
        "findings": listed_("findings", run.findings.orderBy("ord")), "evidence": listed_("evidence", run.rows.orderBy("id", "kind", "value", "num")),
        "correlations": listed_("correlations", run.links.orderBy("a", "b")), "chains": listed_("chains", run.chains.orderBy("place")),
        "audit": sorted((r.asDict(recursive=True) for r in last), key=lambda r: r["seq"]), "checks": listed_("checks", checks), "capabilities": listed_("capabilities", coverage),
        "supported_attack_classes": classes and sorted(r.capability for r in classes.where("supported").distinct().collect()), "unsupported_attack_classes": classes and sorted(r.capability for r in classes.where("not supported").distinct().collect()),
        "assumptions": list(ASSUMPTIONS), "limitations": list(LIMITATIONS), "recommended_disposition": case["disposition"] if case else ("ACCEPT" if overall and overall["overall"] == "TRUSTED" else "REVIEW"),
        "scenarios": {"label": "simulated, not used by any detector", "list": listed_("scenarios", scenarios)}, "provenance_note": "findings are computed from the given tables only",
    }
    made = with_integrity(body)
    if sign is not None:
        made["integrity"]["signature"] = sign(made["integrity"]["digest"])
    return made


def verified(report: dict, verify: Callable[[str, str], bool]) -> bool:
    """Whether a report's digest and its signature hold."""
    held = dict(report.get("integrity") or {})
    signature = held.pop("signature", None)
    return signature is not None and holds({**report, "integrity": held}) and verify(held["digest"], signature)


def save(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(canonical(report).decode(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(model_id: str, version: str, digest: str, access: str, fingerprint: str, lineage: dict) -> dict:
    return with_integrity({"model_id": model_id, "version": version, "sha256": digest, "access": access, "fingerprint": fingerprint, "lineage": lineage})


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """report of each report in a folder, the newest name first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -2).alias("report"))
    return files.distinct().orderBy(F.col("report").desc())
