"""Functions for SQL: ``register`` makes them known to a session, for ``spark.sql`` and ``F.expr``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions import pixels
from probity.functions.stats import binomial_tail


@F.pandas_udf(T.DoubleType())
def ks_statistic(values: pd.Series, current: pd.Series) -> pd.Series:
    """Largest gap of the distributions of two lists of values, of which ``current`` says how often each is in the reference and in the window.

    For partial states: values are distinct numbers in any order, current are structs of two counts; so a group's state has one entry for each
    distinct value, whatever the number of rows.
    """
    out = []
    for v, c in zip(values, current, strict=True):
        order = np.argsort(np.asarray(v, dtype=float))
        counts = np.array([[x["reference"], x["current"]] for x in c], dtype=float)[order]
        share = counts.cumsum(axis=0) / np.maximum(counts.sum(axis=0), 1)
        out.append(float(np.abs(share[:, 0] - share[:, 1]).max()) if len(v) else None)
    return pd.Series(out, dtype="float64")


class Patches:
    """UDTF: x, y, key of every square of a picture (raw RGB bytes) with enough contrast."""

    def eval(self, rgb: bytes, height: int, width: int) -> Iterator[tuple]:
        if rgb is not None:
            _, x, y, key = pixels.patch_keys(pixels.decode(pd.Series([bytes(rgb)]), height, width))
            yield from zip(x.tolist(), y.tolist(), key.tolist(), strict=True)


def register(spark: SparkSession) -> None:
    """binom_tail(k, n, p), ks_statistic(values, counts), and the table function patches(rgb, height, width)."""
    spark.udf.register("binom_tail", binomial_tail)
    spark.udf.register("ks_statistic", ks_statistic)
    spark.udtf.register("patches", F.udtf(Patches, returnType="x int, y int, key long"))
