"""Rows of a hot key are spread: no shuffle task reads more than a stated share, without the help of adaptive plans."""

import pytest
from pyspark.sql import functions as F

from probity.llm import neardup, sharding, substrings, suffixes

PARTS = 16


@pytest.fixture
def largest_share(spark):
    """Runs a query over shuffles of ``PARTS`` tasks; gives the largest share of a stage's rows that one task read."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(PARTS)}
    before = {k: spark.conf.get(k) for k in settings}

    def run(fn, least):
        store = spark.sparkContext._jsc.sc().statusStore()
        bus = spark.sparkContext._jsc.sc().listenerBus()
        bus.waitUntilEmpty()
        seen = _stages(store)
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            fn()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        bus.waitUntilEmpty()
        worst = 0.0
        for stage in _stages(store) - seen:
            rows = _rows_read(store, *stage)
            if len(rows) > 1 and sum(rows) >= least:
                worst = max(worst, max(rows) / sum(rows))
        return worst

    return run


def _stages(store):
    jobs = store.jobsList(None)
    ids = set()
    for i in range(jobs.size()):
        stages = jobs.apply(i).stageIds()
        ids |= {(stages.apply(j), 0) for j in range(stages.size())}
    return ids


def _rows_read(store, stage, attempt):
    try:
        tasks = store.taskList(stage, attempt, 1000)
    except Exception:  # a stage that was skipped
        return []
    out = []
    for i in range(tasks.size()):
        metrics = tasks.apply(i).taskMetrics()
        if metrics.isDefined():
            out.append(metrics.get().shuffleReadMetrics().recordsRead())
    return out


def test_small_strata_share_no_bin(spark, largest_share):
    """As many sources as rows: all have the fraction 0.5."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("x").alias("text"))
    got = []
    share = largest_share(lambda: got.extend(sharding.shard_documents(docs).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("s")).collect()), 50_000)
    assert share < 0.25
    assert {(r.n, r.s) for r in got} == {(6250, 6249)}


def test_copies_of_one_text_and_null_keys(spark, largest_share, words):
    """Half of the rows are copies of one text, a quarter is empty."""
    one = " ".join(words(60, 1))
    i = F.col("id")
    docs = spark.range(12_000).select(i.alias("doc_id"), F.when(i % 2 == 0, one).when(i % 4 == 1, "").otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), i) for k in range(20)])).alias("text"))
    for fn, column in ((neardup.near_duplicates, "kept"), (substrings.repeated_passages, "n_removed = 0"), (suffixes.repeated_bytes, "n_removed = 0")):
        got = []
        share = largest_share(lambda fn=fn, got=got, column=column: got.append(fn(docs).where(column).count()), 8_000)
        assert share < 0.3, fn
        assert got == [6_000 + (fn is not suffixes.repeated_bytes)], fn


def test_anchor_of_very_many_texts(spark, largest_share, words):
    """A passage that all texts hold, each with its own words around it."""
    passage = " ".join(words(40, 2))
    i = F.col("id")
    own = lambda tag: F.concat_ws(" ", *[F.concat(F.lit(f"{tag}{k}y"), i) for k in range(8)])
    docs = spark.range(6_000).select(i.alias("doc_id"), F.concat_ws(" ", own("a"), F.lit(passage), own("b")).alias("text"))
    got = []
    share = largest_share(lambda: got.append(substrings.repeated_passages(docs).where("n_removed = 40").count()), 12_000)
    assert share < 0.3 and got == [5_999]
