"""Self-test of record and log verification: changes on signed records of their own, with what verification must say."""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import ed25519
from probity.functions.scalars import GENESIS
from probity.operators import records, report
from probity.plans.catalogue import query

#: Keys of the self-test alone: they sign nothing else.
_TRUSTED, _ROGUE = hashlib.sha256(b"self-test").digest(), hashlib.sha256(b"rogue").digest()
_N = 5
_FIELDS = (
    "test string, record_id string, stream string, seq long, nonce string, body string, record_hash string, prev_record_hash string, output string, output_sha256 string, preprocess string, "
    "preprocess_sha256 string, inference_config string, inference_config_sha256 string, input_ref string, input_sha256 string, model_sha256 string, key_id string, public_key string, signature string, label string"
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _key_id(key: bytes) -> str:
    return hashlib.sha256(ed25519.public_key(key)).hexdigest()[:16]


def _body(r: dict) -> str:
    kept = ("record_id", "stream", "seq", "nonce", "output", "output_sha256", "preprocess", "inference_config", "input_ref", "input_sha256", "model_sha256", "prev_record_hash", "key_id")
    return report.canonical({k: r[k] for k in kept}).decode()


def _sign(r: dict, key: bytes) -> None:
    r["key_id"], r["public_key"] = _key_id(key), ed25519.public_key(key).hex()
    r["body"] = _body(r)
    r["record_hash"] = _sha(r["body"])
    r["signature"] = ed25519.sign(key, bytes.fromhex(r["record_hash"])).hex()


def _baseline(test: str) -> list[dict]:
    out, prev = [], GENESIS
    for i in range(1, _N + 1):
        output, config = f'{{"label":"c{i % 3}"}}', '{"batch":1}'
        r = {
            "test": test, "record_id": f"{test}-{i}", "stream": test, "seq": i, "nonce": f"{test}-n{i}", "prev_record_hash": prev, "output": output, "output_sha256": _sha(output), "preprocess": config,
            "preprocess_sha256": _sha(config), "inference_config": config, "inference_config_sha256": _sha(config), "input_ref": f"{test}-in{i}", "input_sha256": _sha(f"{test}-in{i}"), "model_sha256": "m", "label": f"c{i % 3}",
        }
        _sign(r, _TRUSTED)
        prev = r["record_hash"]
        out.append(r)
    return out


def _edit(field: str, value: str) -> Callable[[list[dict]], list[dict]]:
    """A stored field changed after signing; the body that is hashed again changes with it."""

    def change(rows: list[dict]) -> list[dict]:
        rows[2][field] = value
        rows[2]["body"] = _body(rows[2])
        return rows

    return change


def _swap(rows: list[dict]) -> list[dict]:
    a, b = rows[1], rows[2]
    a["seq"], b["seq"] = b["seq"], a["seq"]
    return rows


def _resign(rows: list[dict]) -> list[dict]:
    rows[2]["output"] = '{"label":"forged"}'
    rows[2]["output_sha256"] = _sha(rows[2]["output"])
    _sign(rows[2], _ROGUE)
    return rows


#: Tests of records in their order: the change and whether verification must fail.
RECORD_TESTS: dict[str, tuple[Callable[[list[dict]], list[dict]], str]] = {
    "baseline": (lambda rows: rows, "PASS"), "input_modified": (lambda rows: rows, "FAIL"), "output_modified": (_edit("output", '{"label":"other"}'), "FAIL"),
    "model_digest_modified": (_edit("model_sha256", "x"), "FAIL"), "config_modified": (_edit("inference_config", '{"batch":9}'), "FAIL"), "reordered": (_swap, "FAIL"),
    "deleted": (lambda rows: rows[:2] + rows[3:], "FAIL"), "resigned_untrusted": (_resign, "FAIL"),
}


def provenance_selftest(spark: SparkSession) -> DataFrame:
    """test, expected, actual, status, failed_checks of eleven tests; all of them on rows made here, verified by the usual operators."""
    rows = [r for test, (change, _) in RECORD_TESTS.items() for r in change(copy.deepcopy(_baseline(test)))]
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    made = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _FIELDS)
    made = made.withColumn("signature_ok", ed25519.signature_ok("public_key", "record_hash", "signature"))
    inputs = made.select("input_ref", F.when(F.col("input_ref") == "input_modified-in3", "edited").otherwise(F.sha2("input_ref", 256)).alias("sha256"))
    trusted = spark.createDataFrame([(_key_id(_TRUSTED),)], "key_id string")
    again = made.select("record_id", F.concat(F.lit("c"), F.regexp_extract("record_id", r"(\d+)$", 1).cast("int") % 3).alias("label"))
    checked = records.verify_records(made, trusted, spark.createDataFrame([("m",)], "sha256 string"), inputs, again)
    failed = records.check_rows(checked).where("status = 'fail'").withColumn("test", F.regexp_extract("record_id", r"^(.*)-\d+$", 1)).groupBy("test").agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("failed_checks"))
    expected = spark.createDataFrame([(t, e) for t, (_, e) in RECORD_TESTS.items()], "test string, expected string")
    out = expected.join(failed, "test", "left").select("test", "expected", F.when(F.col("failed_checks").isNull(), "PASS").otherwise("FAIL").alias("actual"), F.coalesce("failed_checks", F.lit("")).alias("failed_checks"))

    log = spark.createDataFrame([("s", i, f"n{i}") for i in range(1, 4)], "stream string, seq long, nonce string")
    submitted = spark.createDataFrame([(2, "s", 2, "n2", "k", True)], "record_id long, stream string, seq long, nonce string, signer string, hash_ok boolean")
    verdict = records.ingest_admission(submitted, log, spark.createDataFrame([("k",)], "signer string"))
    out = out.unionByName(verdict.select(F.lit("replayed").alias("test"), F.lit("FAIL").alias("expected"), F.when(F.col("accepted"), "PASS").otherwise("FAIL").alias("actual"), F.col("reasons").alias("failed_checks")))

    chain, prev = [], GENESIS
    for i in range(1, 7):
        chain.append((i, prev, _sha(f"{prev}{i}"), f"{prev}{i}"))
        prev = chain[-1][2]
    head = spark.createDataFrame([(6, prev, ed25519.verify(ed25519.public_key(_TRUSTED), bytes.fromhex(prev), ed25519.sign(_TRUSTED, bytes.fromhex(prev))))], "seq long, hash string, signature_ok boolean")
    edits = {"audit_modified": [(*r[:3], "edited" if r[0] == 3 else r[3]) for r in chain], "audit_deleted": [r for r in chain if r[0] != 3]}
    for test, rows in edits.items():
        found = records.audit_report(spark.createDataFrame(rows, "seq long, prev_hash string, hash string, body string"), F.sha2("body", 256), head)
        out = out.unionByName(found.select(F.lit(test).alias("test"), F.lit("FAIL").alias("expected"), F.when(F.col("valid"), "PASS").otherwise("FAIL").alias("actual"), F.concat(F.lit("first break at "), F.col("first_break_seq").cast("string")).alias("failed_checks")))
    same = F.col("expected") == F.col("actual")
    status = F.when(same, F.when(F.col("expected") == "FAIL", "DETECTED").otherwise("OK")).otherwise(F.when(F.col("expected") == "FAIL", "MISSED").otherwise("FALSE ALARM"))
    return out.select("test", "expected", "actual", status.alias("status"), "failed_checks")


@query()
def record_selftest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance_selftest(spark)


#: Manifests that one task signs and checks at most, about: some seconds' work.
SIGNED_ROWS = 2000


@query()
def manifest_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, key_id, ok of signed manifests of the suppliers' models, some of them edited or signed by another key."""
    from probity.sources.storage import table

    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("model-"), "s_suppkey").alias("model"), F.col("s_suppkey").alias("i"))
    # A number, as rows so small would all be put into one task.
    s = s.repartition(max(spark.sparkContext.defaultParallelism, -(-s.count() // SIGNED_ROWS)), "model")
    digest = F.sha2(F.concat("model", F.when(F.col("i") % 7 == 3, F.lit("edited")).otherwise(F.lit(""))), 256)
    key = F.when(F.col("i") % 11 == 5, F.lit(_ROGUE.hex())).otherwise(F.lit(_TRUSTED.hex()))
    made = s.withColumns({"message": F.sha2("model", 256), "now": digest, "signature": ed25519.signed(key, F.sha2("model", 256))})
    public = F.lit(ed25519.public_key(_TRUSTED).hex())
    return made.select("model", F.lit(_key_id(_TRUSTED)).alias("key_id"), ed25519.signature_ok(public, "now", "signature").alias("ok"))
