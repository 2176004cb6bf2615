"""Attack scenarios as changes of tables, with the finding category that each must raise: fixtures of the end-to-end tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scenario:
    name: str
    table: str
    change: Change
    expected: tuple[str, ...]


def _where(condition: str, **values: str) -> Change:
    return lambda df: df.withColumns({c: F.when(F.expr(condition), F.expr(v)).otherwise(F.col(c)) for c, v in values.items()})


def _copies(df: DataFrame) -> DataFrame:
    top = df.agg(F.max("doc_id").alias("_top"))
    extra = df.where("doc_id < 3").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(20)))).join(F.broadcast(top))
    return df.unionByName(extra.withColumn("doc_id", F.col("_top") + F.col("doc_id") * 20 + F.col("_i")).drop("_i", "_top"))


def _stamped(df: DataFrame) -> DataFrame:
    """One pattern at one place in every tenth sample."""
    extra = df.select("id").distinct().where("id % 10 = 3")
    return df.unionByName(extra.select("id", F.lit(40).alias("x"), F.lit(40).alias("y"), F.lit(1).cast("long").alias("key")))


def _again(df: DataFrame) -> DataFrame:
    """An accepted record submitted twice more: as it was, and with a higher number."""
    old = df.where("record_id = 2")
    top = df.agg(F.max("seq").alias("_top"), F.max("record_id").alias("_id"))
    new = old.join(F.broadcast(top))
    one = new.withColumn("record_id", F.col("_id") + 1)
    two = new.withColumns({"record_id": F.col("_id") + 2, "seq": F.col("_top") + 1})
    return df.unionByName(one.drop("_top", "_id")).unionByName(two.drop("_top", "_id"))


#: Records are (record_id, stream, seq, nonce, record_hash, prev_record_hash, true_hash, trusted).
SCENARIOS = (
    Scenario("label_flip", "labels", _where("source = 'src0' AND doc_id % 2 = 0", toxic="1"), ("dataset.label_inconsistency",)),
    Scenario("duplicate_flood", "documents", _copies, ("dataset.duplicate_flooding",)),
    Scenario("output_tampering", "records", _where("record_id = 3", true_hash="'other'"), ("TAMPERED_RECORD",)),
    Scenario("record_replacement", "records", _where("record_id = 3", record_hash="'forged'", true_hash="'forged'", trusted="false"), ("FORGED_RECORD", "CHAIN_BROKEN")),
    Scenario("record_deletion", "records", lambda df: df.where("record_id <> 3"), ("CHAIN_BROKEN",)),
    Scenario("replay", "records", _where("record_id = 5", nonce="2L"), ("REPLAY",)),
    Scenario("distribution_shift", "window", _where("cur", v="v + 3"), ("distribution.environmental_drift",)),
    Scenario("ood_insertion", "measured", _where("id % 40 = 7", distance="0.99D"), ("dataset.ood_samples",)),
    Scenario("backdoor_poison", "spots", _stamped, ("dataset.trigger_pattern",)),
    Scenario("model_substitution", "deployed", _where("model = 'a'", sha256="'unknown'"), ("model.substitution",)),
    Scenario("input_tampering", "inputs", _where("input_ref = 'in-3'", sha256="'edited'"), ("inference.input_mismatch",)),
    Scenario("replay_at_ingest", "submissions", _again, ("inference.replay_blocked",)),
    Scenario("audit_tampering", "audit", _where("seq = 3", body="'edited'"), ("governance.audit_tampering",)),
)
#: What several of them together must raise.
COMBINED = ("backdoor_poison", "label_flip", "output_tampering", "model_substitution")
