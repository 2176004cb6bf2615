"""Signed-record checks: chains, sequences, nonces, bindings, admission, manifests and logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import ordered
from probity.functions.scalars import FAILURE_PRIORITY, GENESIS, primary_category
from probity.sources.storage import materialize, release


def chain_heads(records: DataFrame, stream: str, order: list[str], body: str) -> DataFrame:
    """stream, n, head: the fold head = sha256(head + body) over a stream in order, from 64 zeros.

    A fold is serial within its stream; rows of a partition are sorted by Spark (which spills) and streamed through with
    one digest of state, so a long stream needs time but no memory.
    """
    dealt = records.select(F.col(stream).alias("stream"), *order, F.col(body).alias("body")).repartition("stream").sortWithinPartitions("stream", *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, head = None, 0, GENESIS
        for batch in batches:
            done = []
            for stream_id, text in zip(batch["stream"].tolist(), batch["body"].tolist(), strict=True):
                if n and stream_id != now:
                    done.append((now, n, head))
                    n, head = 0, GENESIS
                now, n = stream_id, n + 1
                head = hashlib.sha256((head + text).encode()).hexdigest()
            if done:
                yield pd.DataFrame(done, columns=["stream", "n", "head"])
        if n:
            yield pd.DataFrame([(now, n, head)], columns=["stream", "n", "head"])

    return dealt.select("stream", "body").mapInPandas(fold, f"stream {dict(records.dtypes)[stream]}, n long, head string")


def chain_records(batch: DataFrame, heads: DataFrame | None, order: str) -> DataFrame:
    """record_id, stream, seq, prev_record_hash, record_hash: a batch (record_id, stream, body) numbered and linked on to its streams.

    heads has stream, seq, record_hash of each stream's last record; a stream without one starts at 1 from 64 zeros. The
    hash is that of the hash before and the body. A stream's records are sorted by Spark and streamed through one state.
    """
    if heads is None:
        known = batch.withColumns({"_seq": F.lit(0).cast("long"), "_head": F.lit(GENESIS)})
    else:
        last = heads.select("stream", F.col("seq").alias("_seq"), F.col("record_hash").alias("_head"))
        known = batch.join(last, "stream", "left").withColumns({"_seq": F.coalesce("_seq", F.lit(0)).cast("long"), "_head": F.coalesce("_head", F.lit(GENESIS))})
    dealt = known.repartition("stream").sortWithinPartitions("stream", order).select("record_id", "stream", "body", "_seq", "_head")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, head = None, 0, GENESIS
        for part in batches:
            out = []
            for record_id, stream, body, first, start in part.itertuples(index=False):
                if stream != now:
                    now, seq, head = stream, first, start
                seq, before = seq + 1, head
                head = hashlib.sha256((before + body).encode()).hexdigest()
                out.append((record_id, stream, seq, before, head))
            yield pd.DataFrame(out, columns=["record_id", "stream", "seq", "prev_record_hash", "record_hash"])

    kinds = dict(batch.dtypes)
    return dealt.mapInPandas(link, f"record_id {kinds['record_id']}, stream {kinds['stream']}, seq long, prev_record_hash string, record_hash string")


def packed_digest(text: Column) -> Column:
    """A text as bytes, one for one: 64 lower-case hex digits as the 32 bytes they stand for, any other text as its own bytes and 33 more."""
    return F.when(text.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(text)).otherwise(F.concat(text.cast("binary"), F.lit(b"\0" * 33)))


def unpacked_digest(data: Column) -> Column:
    """The text that ``packed_digest`` made ``data`` of."""
    return F.when(F.length(data) == 32, F.lower(F.hex(data))).otherwise(F.substring(data, F.lit(1), F.length(data) - 33).cast("string"))


def chain_checks(records: DataFrame) -> DataFrame:
    """records (record_id, stream, seq, nonce, record_hash, prev_record_hash) with link_ok, seq_ok, nonce_ok, nonce_owner.

    The link and the number are compared with the record before in the stream as stored, so checks go on after
    a gap. Streams are scanned in order over all partitions, so a long one is no single task. A nonce belongs to its first use over
    all streams in (stream, seq) order; its uses are summed to the first before the shuffle, so a nonce that
    very many records repeat is no hot key. A null nonce is no nonce: it is neither owned nor repeated.
    Hashes are most of a record's bytes; they are dealt and written as ``packed_digest``.
    """
    names, hashes = records.columns, ("record_hash", "prev_record_hash")
    records = records.withColumns({c: packed_digest(F.col(c)) for c in hashes})
    rows = ordered.placed(records, ["stream", "seq", "record_id"])
    used = rows.where(F.col("nonce").isNotNull()).groupBy("nonce").agg(F.min(F.struct("stream", "seq", "record_id")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Links and numbers are decided before the join, so that the hashes needn't be dealt again where only the outcome is asked for.
    before = ordered.previous(records, ["stream"], ["seq", "record_id"], {"_prev_hash": "record_hash", "_prev_seq": "seq"}, rows)
    linked = before.select(
        *records.columns,
        F.col("prev_record_hash").eqNullSafe(F.coalesce(F.col("_prev_hash"), F.lit(bytes.fromhex(GENESIS)))).alias("link_ok"),
        (F.col("seq") == F.coalesce("_prev_seq", F.lit(0)) + 1).alias("seq_ok"),
    )
    # A nonce that one row has is that row's.
    named = linked.join(used.where(F.col("_n") > 1).select("nonce", "_first"), "nonce", "left")
    owner = F.when(F.col("_first").isNull(), F.col("record_id")).otherwise(F.col("_first.record_id"))
    out = named.withColumns({"nonce_owner": owner, "nonce_ok": owner == F.col("record_id")})
    return out.select(*[unpacked_digest(F.col(c)).alias(c) if c in hashes else F.col(c) for c in names], "link_ok", "seq_ok", "nonce_owner", "nonce_ok")


#: The checks of a record in their order, and the category of a failure.
CHECKS = {
    "output_binding": "TAMPERED_OUTPUT", "preprocess_binding": "TAMPERED_CONFIG", "inference_config_binding": "TAMPERED_CONFIG", "record_hash": "TAMPERED_RECORD",
    "signature": "FORGED_RECORD", "input_binding": "INPUT_MISMATCH", "model_binding": "MODEL_MISMATCH", "chain_link": "CHAIN_BROKEN",
    "sequence": "CHAIN_BROKEN", "nonce_unique": "REPLAY", "re_execution": "REEXEC_MISMATCH",
}
#: Checks that are recorded only where they fail.
ONLY_FAILURES = ("sequence", "nonce_unique")
SIGNED = ("schema", "record_id", "stream", "seq", "timestamp", "nonce", "bindings", "input_ref", "model_ref", "preprocess", "inference_config", "output", "prev_record_hash", "signer")


def signed_body(records: DataFrame, body: str = "body") -> DataFrame:
    """``records`` with the signed fields in one struct, in their fixed order; fields that a record lacks are null."""
    fields = [F.col(c).alias(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in SIGNED]
    return records.withColumn(body, F.struct(*fields))


#: Columns of a record that ``verify_records`` checks and leaves behind: texts and digests are most of a record's bytes.
CHECKED = ("body", "output", "output_sha256", "preprocess", "preprocess_sha256", "inference_config", "inference_config_sha256", "input_ref", "input_sha256", "key_id", "signature_ok")


def verify_records(records: DataFrame, trusted: DataFrame, models: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``chain_checks`` of ``records`` with the result of each of the eleven checks: a column ok_<check>, null where it is skipped; without ``CHECKED``.

    records also has output, preprocess, inference_config and body (canonical texts), the digests <name>_sha256 and
    input_sha256, model_sha256 that they bind, key_id, signature_ok (the outcome of the signature check under that key),
    input_ref and label. trusted has key_id; models has sha256; inputs has input_ref, sha256 of the inputs that are at hand;
    outputs has record_id, label of a new run of the registered model. Each lookup table has distinct keys.

    What a record tells by itself is decided first, so that only outcomes are dealt, written and sorted after it.
    """
    digest = lambda c: F.sha2(F.col(c), 256)
    kept = [c for c in records.columns if c not in CHECKED]
    alone = {
        "output_binding": digest("output").eqNullSafe(F.col("output_sha256")),
        "preprocess_binding": digest("preprocess").eqNullSafe(F.col("preprocess_sha256")),
        "inference_config_binding": digest("inference_config").eqNullSafe(F.col("inference_config_sha256")),
        "record_hash": digest("body").eqNullSafe(F.col("record_hash")),
    }
    looked_up = ["key_id", "signature_ok", "input_ref", "input_sha256"]
    joined = (
        records.select(*kept, *looked_up, *[c.alias(f"ok_{n}") for n, c in alone.items()])
        .join(trusted.select("key_id", F.lit(True).alias("_trusted")), "key_id", "left")
        .join(models.select(F.col("sha256").alias("model_sha256"), F.lit(True).alias("_model")), "model_sha256", "left")
        .join(inputs.select("input_ref", F.col("sha256").alias("_input")), "input_ref", "left")
    )
    found = {
        "signature": F.col("_trusted").isNotNull() & F.coalesce("signature_ok", F.lit(False)),
        "input_binding": F.when(F.col("_input").isNotNull(), F.col("_input").eqNullSafe(F.col("input_sha256"))),
        "model_binding": F.col("_model").isNotNull(),
    }
    known = joined.select(*kept, *[f"ok_{n}" for n in alone], *[c.alias(f"ok_{n}") for n, c in found.items()])
    again = F.when(F.col("ok_input_binding") & F.col("ok_model_binding") & F.col("_again").isNotNull(), F.col("label").eqNullSafe(F.col("_again")))
    results = {"chain_link": F.col("link_ok"), "sequence": F.col("seq_ok"), "nonce_unique": F.col("nonce_ok"), "re_execution": again}
    out = chain_checks(known).join(outputs.select("record_id", F.col("label").alias("_again")), "record_id", "left")
    out = out.withColumns({f"ok_{c}": r for c, r in results.items()})
    return out.select(*kept, "link_ok", "seq_ok", "nonce_owner", "nonce_ok", *[f"ok_{c}" for c in CHECKS])


def check_rows(verified: DataFrame) -> DataFrame:
    """record_id, place, check, status, category: a row for each check that is recorded (pass, fail or skipped)."""
    each = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("check"), F.when(F.col(f"ok_{c}").isNull(), "skipped").when(F.col(f"ok_{c}"), "pass").otherwise("fail").alias("status"), F.lit(category).alias("category"))
        for i, (c, category) in enumerate(CHECKS.items(), 1)
    ])
    rows = verified.select("record_id", F.explode(each).alias("c")).select("record_id", "c.*")
    return rows.where((F.col("status") == "fail") | ~F.col("check").isin(*ONLY_FAILURES))


def failures_of(verified: DataFrame, *more: str) -> DataFrame:
    """``verdicts`` of the eleven checks, with ``more`` columns of the records."""
    bad: dict[str, Column] = {}
    for check, category in CHECKS.items():
        failed = F.col(f"ok_{check}") == F.lit(False)
        bad[category] = F.coalesce(failed, F.lit(False)) | bad[category] if category in bad else F.coalesce(failed, F.lit(False))
    return verdicts(verified, bad, *more)


def verdicts(checked: DataFrame, failures: dict[str, Column], *more: str) -> DataFrame:
    """record_id, stream, seq, failure_categories (sorted), primary_category, verdict and ``more`` columns from the failure condition of each category.

    A null condition is a skipped check: neither passed nor failed.
    """
    each = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in failures.items()]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*each))))
    marked = checked.withColumn("failure_categories", found)
    return marked.select("record_id", "stream", "seq", "failure_categories", primary_category(F.col("failure_categories")).alias("primary_category"), F.when(F.size("failure_categories") > 0, "INVALID").otherwise("VALID").alias("verdict"), *more)


def failure_groups(verdict: DataFrame) -> DataFrame:
    """primary_category, priority, n, first_seq: invalid records by their most telling category."""
    order = F.array_position(F.array(*map(F.lit, FAILURE_PRIORITY)), F.col("primary_category")).cast("long")
    return verdict.where("verdict = 'INVALID'").groupBy("primary_category").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).withColumn("priority", order)


#: Rounds of admission: conflicts of nonces and numbers that hang on each other, one after the other.
ROUNDS = 1000


def ingest_admission(incoming: DataFrame, accepted: DataFrame, trusted: DataFrame, arrival: str = "record_id") -> DataFrame:
    """Admission of incoming records in the order of ``arrival``: record_id, accepted, reasons, replay.

    incoming has record_id, stream, seq, nonce, signer, hash_ok; accepted (stream, seq, nonce) is what the log
    holds; trusted has signer. Only an accepted record uses up its nonce and raises its stream's number, so a forged one
    blocks nobody. All reasons are given; replay only for a used nonce or a number that isn't higher than the
    stream's last; a stream without an accepted record takes any. A null nonce is never used before, a null number is 0.

    A record that is refused for its number can't raise the number, so numbers are a running maximum over the
    records that nothing else refuses. What depends on each other are nonces and numbers: rounds refuse the
    later uses of a nonce, until the accepted records don't change; a round more is needed only where a refused
    record had held back another. A round settles the earliest record that is still open for good, so there are at most as many as conflicts
    that hang on each other, and ``ROUNDS`` are allowed. A stream's running maximum is carried over partitions, so a long
    stream is no single task.
    """
    last = accepted.groupBy("stream").agg(F.max("seq").alias("_last"))
    seen = accepted.select("nonce", F.lit(True).alias("_seen")).where(F.col("nonce").isNotNull()).distinct()
    keys = trusted.select("signer", F.lit(True).alias("_trusted")).distinct()
    joined = incoming.join(last, "stream", "left").join(seen, "nonce", "left").join(keys, "signer", "left")
    fit = F.coalesce("hash_ok", F.lit(False)) & F.col("_trusted").isNotNull() & F.col("_seen").isNull()
    kept = ["record_id", "stream", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "nonce", F.col(arrival).alias("_at"), F.col("_last").cast("long").alias("_last"), F.coalesce("_seen", F.lit(False)).alias("_seen")]
    state = materialize(joined.select(*kept, F.coalesce("hash_ok", F.lit(False)).alias("_hash"), F.col("_trusted").isNotNull().alias("_key"), fit.alias("_fit"), F.lit(False).alias("_used")), "admission")
    for _ in range(ROUNDS):
        free = F.col("_fit") & ~F.col("_used")
        now = ordered.running(state.withColumn("_free", F.when(free, F.col("seq"))), ["stream"], ["_at", "record_id"], {"_before": "_free"}, F.max, inclusive=False)
        now = now.withColumn("_high", F.greatest("_last", "_before")).drop("_free", "_before")
        now = now.withColumn("_ok", free & F.coalesce(F.col("seq") > F.col("_high"), F.lit(True)))
        owner = now.where("_ok and nonce is not null").groupBy("nonce").agg(F.min(F.struct("_at", "record_id")).alias("_owner"))
        late = F.coalesce(F.struct("_at", "record_id") > F.col("_owner"), F.lit(False))
        done = materialize(now.join(owner, "nonce", "left").withColumn("_late", late).drop("_owner"), "admission")
        release(state)
        if not done.where("_fit and _late <> _used").limit(1).count():
            break
        state = done.withColumn("_used", F.col("_late")).drop("_high", "_ok", "_late")
        state._probity_path = done._probity_path
    else:
        raise RuntimeError("admission did not settle")
    bad_nonce, bad_seq = F.col("_seen") | F.col("_late"), F.coalesce(F.col("seq") <= F.col("_high"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~F.col("_hash"), "record hash mismatch"),
        F.when(~F.col("_key"), "untrusted signer"),
        F.when(bad_nonce, "nonce already used"),
        F.when(bad_seq, "sequence not increasing"),
    ))
    marked = done.withColumn("reasons", reasons).withColumn("replay", bad_nonce | bad_seq)
    return marked.select("record_id", (F.size("reasons") == 0).alias("accepted"), F.array_join("reasons", "; ").alias("reasons"), "replay")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change of everything added, removed or modified between two manifests, by one full outer join."""
    a = old.select(F.col(key).alias("key"), F.col(digest).alias("_old"))
    b = new.select(F.col(key).alias("key"), F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return a.join(b, "key", "full_outer").select("key", change.alias("change")).where(F.col("change").isNotNull())


def set_digest(df: DataFrame, digest: Column, key: Column, digits: int = 2) -> DataFrame:
    """n, digest of a set in any order of arrival: the digest of the bins' digests, each over its members in order.

    Bins go by the first ``digits`` hex digits of the member's digest, at most three, so no task sorts the whole set and a
    bin's list is a 256th (or 4,096th) of it. The digest depends on ``digits``, which a caller states with it: 2
    serves up to some 10^9 members, 3 ten times as many.
    """
    member = df.select(F.sha2(F.concat_ws("|", key, digest), 256).alias("m")).withColumn("bin", F.substring("m", 1, min(digits, 3)))
    bins = member.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("m"))), 256).alias("d"))
    return bins.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("bin", "d"))), lambda x: x["d"])), 256).alias("digest"))


def manifest_of(files: DataFrame) -> DataFrame:
    """n, digest of files (name, sha256): the SHA-256 of the canonical JSON object that maps every name to its digest, in order of names.

    A data set's digest as other tools compute it. The text is one, so its digest is a fold in one task; names are sorted by Spark over all
    partitions and streamed through one hash state, so the task's memory doesn't grow. ``set_digest`` is for digests in parallel.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(F.col(c))), r"^\[(.*)\]$", 1)
    entries = ordered.numbered(files.select("name", F.concat(quoted("name"), F.lit(":"), quoted("sha256")).alias("entry")), ["name"], "place")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, n = hashlib.sha256(b"{"), 0
        for batch in batches:
            for entry in batch["entry"]:
                state.update((("," if n else "") + entry).encode())
                n += 1
        state.update(b"}")
        yield pd.DataFrame({"n": [n], "digest": [state.hexdigest()]})

    # One partition, sorted by Spark, which spills; rows come to Python in batches.
    return entries.repartition(1).sortWithinPartitions("place").select("entry").mapInPandas(fold, "n long, digest string")


def added_by_batch(change: DataFrame, batches: DataFrame) -> DataFrame:
    """batch, added of a manifest's new files (key, change) by their batch (key, batch); files of none are ``unknown``."""
    new = change.where("change = 'added'").join(batches, "key", "left")
    return new.groupBy(F.coalesce("batch", F.lit("unknown")).alias("batch")).agg(F.count(F.lit(1)).alias("added"))


def audit_problems(events: DataFrame, body_hash: Column) -> DataFrame:
    """seq, problem of a log (seq, prev_hash, hash): gaps, broken links and changed contents.

    A log is one chain: it is compared with the row before by a window over ranges of seq, not over the whole in one task.
    """
    # Contents are compared before the rows are dealt, which then have one hash each.
    prev = events.select((F.col("seq") + 1).alias("seq"), packed_digest(F.col("hash")).alias("_before"), F.lit(True).alias("_has"))
    joined = events.select("seq", packed_digest(F.col("prev_hash")).alias("prev_hash"), (F.col("hash") != body_hash).alias("_modified")).join(prev, "seq", "left")
    first = events.agg(F.min("seq").alias("_first"))
    marked = joined.join(F.broadcast(first))
    opening = F.col("seq") == F.col("_first")
    problems = F.array_compact(F.array(
        F.when(F.when(opening, F.col("seq") != 1).otherwise(F.col("_has").isNull()), "sequence_gap"),
        F.when(~F.when(opening, F.col("prev_hash") == F.lit(bytes.fromhex(GENESIS))).otherwise(F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False))), "broken_link"),
        F.when(F.col("_modified"), "content_modified"),
    ))
    return marked.select("seq", F.explode(problems).alias("problem"))


def audit_report(events: DataFrame, body_hash: Column, head: DataFrame) -> DataFrame:
    """One row: valid, records, head_hash, head_ok, first_break_seq, n_problems of a log and its signed head.

    head has seq, hash, signature_ok (the outcome of the signature check) in at most one row. It holds if its hash
    is that of the last row and its signature does; without a head or rows head_ok is null. Nothing may be appended before
    the log is compared with its head, as a cut-off end shows only there.
    """
    problems = audit_problems(events, body_hash)
    whole = events.agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("_last"), F.max_by("hash", "seq").alias("_hash"))
    found = problems.agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    signed = head.agg(F.first(F.struct(F.col("hash").alias("h"), F.coalesce("signature_ok", F.lit(False)).alias("ok"))).alias("_head"))
    one = whole.join(F.broadcast(found)).join(F.broadcast(signed))
    head_ok = F.when(F.col("_head").isNotNull() & (F.col("records") > 0), F.col("_head.h").eqNullSafe(F.col("_hash")) & F.col("_head.ok"))
    out = one.withColumn("head_ok", head_ok).withColumn("n_problems", F.col("_n") + F.when(F.col("head_ok") == F.lit(False), 1).otherwise(0))
    first = F.when(F.col("head_ok") == F.lit(False), F.least(F.col("_first"), F.col("_last"))).otherwise(F.col("_first"))
    return out.select((F.col("n_problems") == 0).alias("valid"), "records", F.coalesce("_hash", F.lit(GENESIS)).alias("head_hash"), "head_ok", first.alias("first_break_seq"), "n_problems")


def latest_window(records: DataFrame, stream: str, order: str, n: int = 60) -> DataFrame:
    """The latest n rows of each stream; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(stream).orderBy(F.col(order).desc())
    return records.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)
