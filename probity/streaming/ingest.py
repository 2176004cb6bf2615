"""Streaming ingest of signed records, and windows over event time. Each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators.records import chain_records, ingest_admission


def tumbling(events: DataFrame, width: str, lateness: str | None = None) -> DataFrame:
    """window_start, event_type, n, total per window; with ``lateness`` a stream drops later rows and closes windows."""
    source = events.withWatermark("ts", lateness) if lateness and events.isStreaming else events
    out = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    """user_id, session_start, n, total: a session ends after ``gap`` without an event."""
    source = events.withWatermark("ts", lateness) if lateness and events.isStreaming else events
    out = source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n", F.round("total", 6).alias("total"))


def dedup_nonces(events: DataFrame, lateness: str | None = None, order: str | None = None) -> DataFrame:
    """First record of each nonce. Without ``lateness`` a stream's state keeps every nonce; with it only that long.

    A batch takes the least by ``order`` (any one without it).
    """
    if lateness and events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["nonce"])
    if order and not events.isStreaming:
        first = events.groupBy("nonce").agg(F.min_by(F.struct(*events.columns), order).alias("_first"))
        return first.select("_first.*")
    return events.dropDuplicates(["nonce"])


def latest_in_stream(events: DataFrame, size: int = 60, least: int = 20) -> DataFrame:
    """stream, n, ready, first_seq, last_seq: the window of the latest ``size`` records of each stream after every micro-batch.

    The state of a stream is that window's numbers; it is ready from ``least`` on.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held += batch["seq"].tolist()
        held = sorted(held)[-size:]
        state.update((held,))
        yield pd.DataFrame({"stream": [key[0]], "n": [len(held)], "ready": [len(held) >= least], "first_seq": [held[0]], "last_seq": [held[-1]]})

    return events.groupBy("stream").applyInPandasWithState(step, "stream long, n long, ready boolean, first_seq long, last_seq long", "held array<long>", "update", "NoTimeout")


def produce(records_path: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that makes chained records of a micro-batch (record_id, stream, body) and appends them.

    Each stream's last number and hash are kept beside the records; a batch that runs again replaces its own files.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, heads = batch.sparkSession, f"{records_path}-heads"
        schema = "stream long, seq long, record_hash string, batch long"
        last = _written(spark, f"{heads}/*", schema).where(F.col("batch") == number - 1).select("stream", "seq", "record_hash")
        made = chain_records(batch, last, order).withColumn("batch", F.lit(number).cast("long"))
        made.write.mode("overwrite").parquet(f"{records_path}/batch-{number}")
        new = spark.read.schema(made.schema).parquet(f"{records_path}/batch-{number}").select("stream", "seq", "record_hash")
        now = last.unionByName(new).groupBy("stream").agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("record_hash"))
        now.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{heads}/batch-{number}")

    return sink


def monotonic(events: DataFrame, arrival: str = "record_id") -> DataFrame:
    """record_id, stream, seq, accepted: a record is accepted if its number is above the stream's last accepted one.

    Records of a micro-batch go in the order of ``arrival``, as in admission, however Spark cuts a stream's rows into batches on their way. Gaps are
    allowed; the state of a stream is that one number. A stream's part of a micro-batch is held at once, which a limit on files or rows of a
    trigger bounds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([arrival, "record_id"])
        last = state.get[0] if state.exists else 0
        high = np.maximum.accumulate(np.append(last, rows["seq"].to_numpy(dtype=np.int64)))
        state.update((int(high[-1]),))
        yield rows[["record_id", "stream", "seq"]].assign(accepted=rows["seq"].to_numpy(dtype=np.int64) > high[:-1])

    return events.groupBy("stream").applyInPandasWithState(step, "record_id long, stream long, seq long, accepted boolean", "last long", "append", "NoTimeout")


_LOG = "record_id long, stream long, seq long, nonce long, batch long"
_REFUSED = "record_id long, stream long, reasons string, replay boolean, batch long"


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def admit(accepted_path: str, rejected_path: str, trusted: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: admit each micro-batch against the log, append to it and to the rejects.

    Each stream's last number is kept beside the log (one row a stream, written by every batch), so of the log only the
    nonces are read, and of those only what the batch's own nonces match. Files are written under the batch's
    number in overwrite mode, so a batch that runs again replaces its own.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, heads = batch.sparkSession, f"{accepted_path}-heads"
        log = _written(spark, f"{accepted_path}/*", _LOG).where(F.col("batch") < number)
        last = _written(spark, f"{heads}/*", "stream long, seq long, batch long").where(F.col("batch") == number - 1).select("stream", "seq")
        used = log.join(batch.select("nonce").distinct(), "nonce", "left_semi").select(F.lit(None).cast("long").alias("stream"), F.lit(None).cast("long").alias("seq"), "nonce")
        verdict = ingest_admission(batch, last.withColumn("nonce", F.lit(None).cast("long")).unionByName(used), trusted)
        done = batch.join(verdict, "record_id").withColumn("batch", F.lit(number).cast("long"))
        done.where("accepted").select("record_id", "stream", "seq", "nonce", "batch").write.mode("overwrite").parquet(f"{accepted_path}/batch-{number}")
        done.where("not accepted").select("record_id", "stream", "reasons", "replay", "batch").write.mode("overwrite").parquet(f"{rejected_path}/batch-{number}")
        new = spark.read.schema(_LOG).parquet(f"{accepted_path}/batch-{number}").select("stream", "seq")
        heads_now = last.unionByName(new).groupBy("stream").agg(F.max("seq").alias("seq")).withColumn("batch", F.lit(number).cast("long"))
        heads_now.write.mode("overwrite").parquet(f"{heads}/batch-{number}")

    return sink


def ingest_log(spark: SparkSession, accepted_path: str, rejected_path: str) -> DataFrame:
    """record_id, accepted, reasons, batch of everything that was submitted, accepted or not."""
    taken = _written(spark, f"{accepted_path}/*", _LOG).select("record_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reasons"), "batch")
    return taken.unionByName(_written(spark, f"{rejected_path}/*", _REFUSED).select("record_id", F.lit(False).alias("accepted"), "reasons", "batch"))
