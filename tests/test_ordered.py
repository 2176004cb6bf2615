"""Ordered scans over partitions against plain loops, with groups that fill many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from probity.functions.ordered import numbered, previous, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(rng.choice(["hot"] * 6 + ["b", "c", None]), i, rng.choice([None, *range(-5, 9)])) for i in rng.sample(range(10_000), 2_000)] + [("one", 1, 5)]
    return made, spark.createDataFrame(made, "g string, at long, v long").repartition(7)


def groups(made):
    out = {}
    for g, at, v in sorted(made, key=lambda r: r[1]):
        out.setdefault(g, []).append((at, v))
    return out


def test_numbers(rows, spark):
    made, df = rows
    got = numbered(df, [F.desc("at"), "g"], "k", first=0)
    assert got.columns == ["g", "at", "v", "k"]
    want = sorted(made, key=lambda r: (-r[1], r[0] is not None, r[0] or ""))
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r.k)] == [tuple(r) for r in want]
    assert sorted(r.k for r in got.collect()) == list(range(len(made)))
    assert numbered(df.where("false"), ["at"], "k").collect() == []


def test_previous_rows(rows):
    made, df = rows
    got = {(r.g, r.at): (r.before, r.value) for r in previous(df, ["g"], ["at"], {"before": "at", "value": "v"}).collect()}
    want = {}
    for g, some in groups(made).items():
        for k, (at, _) in enumerate(some):
            want[g, at] = some[k - 1] if k else (None, None)
    assert got == want and len(got) == len(made)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_folds(rows, inclusive):
    made, df = rows
    for fold, plain in ((F.sum, sum), (F.max, max), (F.min, min)):
        got = {(r.g, r.at): r.x for r in running(df, ["g"], ["at"], {"x": "v"}, fold, inclusive).collect()}
        for g, some in groups(made).items():
            for k, (at, _) in enumerate(some):
                values = [v for _, v in some[: k + inclusive] if v is not None]
                assert got[g, at] == (plain(values) if values else None)
    whole = running(df, [], ["at", "g"], {"x": "v"}).collect()
    assert max((r.at, r.x) for r in whole)[1] == sum(v for _, _, v in made if v is not None)


def test_no_task_holds_a_group(rows, spark):
    """One group of most rows lies in every range; here ranges aren't put together for being small."""
    _, df = rows
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    from probity.functions.ordered import placed

    try:
        parts = {r._part: r.n for r in placed(df.where("g = 'hot'"), ["g", "at"]).groupBy("_part").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset(key)
    assert len(parts) > 1 and max(parts.values()) < 0.5 * sum(parts.values())


def test_the_row_before_needs_no_join(rows):
    """A shuffled join for a few first rows dealt all rows once more."""
    _, df = rows
    got = previous(df, ["g"], ["at"], {"was": "v", "was_at": "at"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and got.columns == ["g", "at", "v", "was", "was_at"]
