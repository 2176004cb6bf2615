"""Text functions, functions of SQL, and what the tail does where it doesn't settle."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import pixels, registry, scalars, stats


def test_numbers_as_text(spark):
    values = [0.0, 10.85, -1234.5678, 1e-300, 2.5e17, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.a, r.b) for r in df.select(scalars.fixed(F.col("v")).alias("a"), scalars.scientific(F.col("v")).alias("b")).collect()]
    assert got[:5] == [(f"{v:.3f}", f"{v:.2e}") for v in values[:5]] and got[5] == (None, None)


def test_ages_and_nonces(spark):
    now = datetime(2024, 5, 1, 12)
    df = spark.createDataFrame([(now - timedelta(seconds=s),) for s in (0, 59, 60, 3599, 3600, 86399, 86400, 10**6, -5)], "t timestamp")
    assert [r.a for r in df.select(scalars.age(F.col("t"), F.lit(now)).alias("a")).collect()] == ["0s", "59s", "1m", "59m", "1h", "23h", "1d", "11d", "0s"]
    some = {r.n for r in spark.range(500).select(scalars.nonce().alias("n")).collect()}
    assert len(some) == 500 and all(len(n) == 32 and int(n, 16) >= 0 for n in some)


def test_functions_of_sql(spark):
    registry.register(spark)
    image = np.random.default_rng(0).integers(0, 256, (1, 12, 13, 3)).astype(np.uint8)
    spark.createDataFrame([(1, bytearray(image[0].tobytes())), (2, None)], "id long, rgb binary").createOrReplaceTempView("probity_pictures")
    got = {(r.x, r.y, r.key) for r in spark.sql("SELECT p.* FROM probity_pictures, LATERAL patches(rgb, 12, 13) p").collect()}
    _, x, y, key = pixels.patch_keys(image)
    assert got == set(zip(x.tolist(), y.tolist(), key.tolist(), strict=True)) and got
    assert spark.sql("SELECT binom_tail(3, 10, 0.1) AS p").first().p == pytest.approx(1 - sum(np.prod([10 - j for j in range(k)]) / max(np.prod(range(1, k + 1)), 1) * 0.1**k * 0.9 ** (10 - k) for k in range(3)))


def test_the_tail_says_where_it_does_not_settle(monkeypatch):
    monkeypatch.setattr(stats, "STEPS", 3)
    with pytest.raises(ArithmeticError):
        stats.beta_tail(0.1, 1e5, 9e5)
