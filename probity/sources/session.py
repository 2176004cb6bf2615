"""Session settings and shipping of the package to executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def session(app: str = "probity", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries are written for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, unless their path holds it already."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_probity_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="probity-code-")) / "probity.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((_ROOT / "probity").rglob("*.py")):
            z.write(path, path.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._probity_shipped = True


def small_batches(spark: SparkSession, rows: int) -> None:
    """Let Python workers of this session get at most ``rows`` rows at a time, unless it asks for fewer: for rows of several thousand bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
