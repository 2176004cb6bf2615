from pyspark.sql import functions as F

from probity.streaming import ingest

RECORD = "record_id long, stream long, seq long, nonce long, signer string, hash_ok boolean, ts timestamp, user_id long, event_type string, value double"


def _files(spark, tmp_path, *batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(RECORD).parquet(str(tmp_path / "in"))


def _row(i, seq=None, nonce=None, signer="k"):
    from datetime import datetime, timedelta

    return (i, 1, seq or i, nonce or i, signer, True, datetime(2024, 1, 1) + timedelta(minutes=10 * i), 1, "t", 1.0)


def test_admission_stream_equals_rules(spark, tmp_path):
    source = _files(spark, tmp_path, [_row(1), _row(2), _row(3, nonce=1), _row(4, signer="x")])
    trusted = spark.createDataFrame([("k",)], "signer string")
    sink = ingest.admit(str(tmp_path / "ok"), str(tmp_path / "bad"), trusted)
    source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "ok") + "/*").collect()) == [1, 2]
    bad = {r.record_id: (r.reasons, r.replay) for r in spark.read.parquet(str(tmp_path / "bad") + "/*").collect()}
    assert bad == {3: ("nonce already used", True), 4: ("untrusted signer", False)}


def test_tumbling_stream_equals_batch(spark, tmp_path):
    source = _files(spark, tmp_path, [_row(i) for i in range(1, 20)])
    out = ingest.tumbling(source, "1 hour")
    out.writeStream.format("memory").queryName("tumbling_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = ingest.tumbling(spark.read.schema(RECORD).parquet(str(tmp_path / "in")), "1 hour")
    assert sorted(map(tuple, spark.table("tumbling_out").collect())) == sorted(map(tuple, batch.collect()))


def test_numbers_rise_per_stream(spark, tmp_path):
    source = _files(spark, tmp_path, [_row(1), _row(2), _row(3, seq=2), _row(4, seq=9)])
    out = ingest.monotonic(source)
    out.writeStream.format("memory").queryName("monotonic_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.record_id: r.accepted for r in spark.table("monotonic_out").collect()} == {1: True, 2: True, 3: False, 4: True}


def test_nonces_are_kept_once(spark):
    df = spark.createDataFrame([_row(1), _row(2, nonce=1)], RECORD)
    assert ingest.dedup_nonces(df).count() == 1
    assert df.where(F.col("nonce") == 1).count() == 2


def test_order_of_a_micro_batch(spark, tmp_path):
    """5,000 records of one stream in one micro-batch: the order is that of arrival, whatever the size of the batches in which they come to Python."""
    rising, falling = [_row(i, seq=i) for i in range(1, 5001)], [(*_row(10_000 + i, seq=9000 - i)[:1], 2, *_row(10_000 + i, seq=9000 - i)[2:]) for i in range(1, 5001)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    results = []
    for size in ("100", "10000"):
        spark.conf.set(key, size)
        try:
            source = _files(spark, tmp_path / size, rising + falling)
            ingest.monotonic(source).writeStream.format("memory").queryName(f"order_{size}").outputMode("append").option("checkpointLocation", str(tmp_path / size / "cp")).trigger(availableNow=True).start().awaitTermination()
            results.append(sorted((r.record_id, r.accepted) for r in spark.table(f"order_{size}").collect()))
        finally:
            spark.conf.set(key, before)
    assert results[0] == results[1]
    # Of the falling ones only the first to arrive is above all before it.
    assert [i for i, ok in results[0] if ok] == [*range(1, 5001), 10_001]
