"""Distribution shift of a current window against a reference: tests, local frames and the attribution ladder."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions import ordered, stats
from probity.operators.vectors import BLOCK_ROWS
from probity.sources.storage import materialize

#: Least window, significance after correction, and the limits of a local frame.
LEAST_WINDOW, SIGNIFICANT = 20, 0.01
LOCAL_Z, ALSO_Z, ALSO_MOST, GLOBAL_Z = 5.0, 3.0, 3, 3.0
#: Search for a median over all pairs: bins of a pass, distances that are sorted at once, rows that meet a block at a time.
BINS, SORTED, CHUNK = 4096, 200_000, 256


def feature_tests(long: DataFrame, feature: str, value: str, is_current: Column) -> DataFrame:
    """feature, n_ref, n_cur, ks, p_adjusted, shifted, change: KS tests corrected by the number of features, and the relative change of means."""
    got = stats.ks_two_sample(long.withColumnRenamed(feature, "feature"), value, is_current, ["feature"])
    n = got.agg(F.count(F.lit(1)).alias("_n"))
    means = long.groupBy(F.col(feature).alias("feature")).agg(F.avg(F.when(is_current, F.col(value))).alias("c"), F.avg(F.when(~is_current, F.col(value))).alias("r"))
    adjusted = F.least(F.lit(1.0), F.col("p_value") * F.col("_n"))
    joined = got.join(F.broadcast(n)).join(means, "feature")
    return joined.select("feature", "n_ref", "n_cur", "ks", adjusted.alias("p_adjusted"), (adjusted < SIGNIFICANT).alias("shifted"), ((F.col("c") - F.col("r")) / (F.abs("r") + 1e-6)).alias("change"))


def window_shift(long: DataFrame, keys: list[str], feature: str = "feature", value: str = "v", is_current: str = "cur", mmd: DataFrame | None = None) -> DataFrame:
    """keys, n, shifted_features, shifted, driver, driver_fraction of each window's features (keys, feature, v, cur).

    Each feature is tested against the reference of its window, corrected by their number. The driver is the feature with the
    largest share of current values outside the reference's 1 to 99 percentile (the first by name on a tie). A window is
    shifted if a feature is, or if its permutation probability (``mmd``: keys, p_value) is below the level too.
    """
    by = [*keys, feature]
    tests = stats.ks_two_sample(long, value, F.col(is_current), by)
    many = tests.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    band = stats.exact_percentiles(long.where(~F.col(is_current)), value, [0.01, 0.99], by)
    out = (F.col(value) < F.col("p")[0]) | (F.col(value) > F.col("p")[1])
    outside = long.where(is_current).join(band, by).groupBy(*by).agg(F.avg(out.cast("double")).alias("_out"))
    joined = tests.join(many, keys).join(outside, by).withColumn("_s", (F.least(F.lit(1.0), F.col("p_value") * F.col("_m")) < SIGNIFICANT).cast("int"))
    per = joined.groupBy(*keys).agg(F.max("n_cur").alias("n"), F.sum("_s").cast("long").alias("shifted_features"), F.max("_out").alias("driver_fraction"), F.min(F.struct((-F.col("_out")).alias("o"), F.col(feature).alias("f"))).alias("_d"))
    if mmd is not None:
        per = per.join(mmd.select(*keys, (F.col("p_value") < SIGNIFICANT).alias("_mmd")), keys, "left")
    also = F.coalesce(F.col("_mmd"), F.lit(False)) if mmd is not None else F.lit(False)
    return per.select(*keys, "n", "shifted_features", ((F.col("shifted_features") > 0) | also).alias("shifted"), F.col("_d.f").alias("driver"), "driver_fraction")


def top_changes(tests: DataFrame, k: int = 3) -> DataFrame:
    return tests.orderBy(F.abs("change").desc(), "feature").limit(k)


def frame_scores(regions: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frame, region, z and frame, z of current frames: how far each region, and the frame as a whole, lies from the reference.

    regions has id, cur, region, v; whole has id, cur, g. Deviations are those of the reference, a region's plus 1e-3 and a frame's plus 1e-6.
    """
    per = regions.where(~F.col("cur")).groupBy("region").agg(F.avg("v").alias("_mu"), (F.stddev_pop("v") + 1e-3).alias("_sd"))
    one = whole.where(~F.col("cur")).agg(F.avg("g").alias("_mu"), (F.stddev_pop("g") + 1e-6).alias("_sd"))
    scored = lambda c: F.round(F.abs((F.col(c) - F.col("_mu")) / F.col("_sd")), 6).alias("z")
    local = regions.where("cur").join(F.broadcast(per), "region").select(F.col("id").alias("frame"), "region", scored("v"))
    return local, whole.where("cur").join(F.broadcast(one)).select(F.col("id").alias("frame"), scored("g"))


def local_frames(regions: DataFrame, global_z: DataFrame) -> DataFrame:
    """frame, region, z of frames whose change lies in one place: regions (frame, region, z), global_z (frame, z)."""
    per = regions.groupBy("frame").agg(F.max_by("region", F.struct("z", (-F.col("region")).alias("r"))).alias("region"), F.max("z").alias("z"), F.sum((F.col("z") > ALSO_Z).cast("int")).alias("also"))
    whole = global_z.select("frame", F.col("z").alias("_whole"))
    return per.join(whole, "frame").where((F.col("z") > LOCAL_Z) & (F.col("also") <= ALSO_MOST) & (F.col("_whole") < GLOBAL_Z)).select("frame", "region", "z")


def attribution(window: DataFrame) -> DataFrame:
    """status of each window row (n, patches, top_region_count, shifted, driver_fraction).

    Too few rows first; then signs of a local manipulation, even without a shift; then a shift that its known
    drivers explain, one that they don't, and none.
    """
    least_local = F.greatest(F.lit(4.0), 0.08 * F.col("n"))
    status = (
        F.when(F.col("n") < LEAST_WINDOW, "INSUFFICIENT_DATA")
        .when((F.col("patches") > 0) | (F.col("top_region_count") >= least_local), "SUSPICIOUS")
        .when(F.col("shifted") & (F.col("driver_fraction") >= 0.5), "DRIFT")
        .when(F.col("shifted"), "INCONCLUSIVE")
        .otherwise("PASS")
    )
    return window.withColumn("status", status)


class Pairs:
    """Squared distances of every vector to every vector (id, embedding, cur), for kernel sums over whole tables.

    Vectors are dealt to blocks of at most ``block_rows``, and each two blocks meet in one task, in one order: what is
    summed over a pair counts for both orders. A task measures small chunks of rows. No pair is left out, none is stored, and no
    vector goes through the driver.
    """

    def __init__(self, df: DataFrame, block_rows: int = BLOCK_ROWS) -> None:
        self.df = materialize(df.select("id", "embedding", F.col("cur").cast("int").alias("cur")), "pairs")
        self.n = self.df.count()
        spread = min(math.isqrt(2 * df.sparkSession.sparkContext.defaultParallelism) + 1, -(-self.n // CHUNK))
        self.blocks = max(1, -(-self.n // block_rows), spread)

    def over(self, fn: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
        """fn(one, two, chunks, twice) of each two blocks: chunks gives rows of the first and their distances to the second; twice where these are two different blocks."""
        block, other = F.pmod(F.xxhash64("id"), F.lit(self.blocks)), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        rows = self.df.withColumn("_b", block.cast("int")).withColumn("_o", other)
        dealt = rows.select("id", "embedding", "cur", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), (F.col("_b") > F.col("_o")).alias("_second"))

        def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            second = group["_second"].to_numpy(dtype=bool)
            twice = key[0] != key[1]
            one = _arrays(group[~second])
            two = _arrays(group[second]) if twice else one
            if not len(one[0]) or not len(two[0]):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return fn(one, two, _chunks(one, two), twice)

        return dealt.groupBy("_p", "_q").applyInPandas(meet, schema)

    def median(self, positive: bool = False) -> float:
        """The median distance of two different vectors (only of those apart, if ``positive``); 0 without any.

        Passes of ``BINS`` counts narrow the range that holds the middle rank until its values can be sorted.
        """

        def kept(own: np.ndarray, squares: np.ndarray) -> np.ndarray:
            return squares[(squares > 0) if positive else ~own]

        def extent(one, two, chunks, twice) -> pd.DataFrame:
            found = [(len(d) * (1 + twice), d.max() if len(d) else 0.0) for d in (kept(own, squares) for _, own, squares in chunks)]
            return pd.DataFrame({"n": [sum(n for n, _ in found)], "top": [max(t for _, t in found)]})

        n, top = self.over(extent, "n long, top double").agg(F.sum("n"), F.max("top")).first()
        if not n or not top:
            return 0.0
        low, high, before, inside, rank = 0.0, top * (1 + 1e-9), 0, n, (n - 1) // 2
        while inside > SORTED and high - low > 1e-12 * high:

            def count(one, two, chunks, twice, low=low, high=high) -> pd.DataFrame:
                k = np.zeros(BINS + 2, dtype=np.int64)
                for _, own, squares in chunks:
                    at = np.clip(np.floor((kept(own, squares) - low) * (BINS / (high - low))), -1, BINS).astype(np.int64) + 1
                    k += np.bincount(at, minlength=BINS + 2) * (1 + twice)
                return pd.DataFrame({"bin": np.flatnonzero(k), "n": k[k > 0]})

            counts = np.zeros(BINS + 2, dtype=np.int64)
            for r in self.over(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
                counts[r.bin] = r.n
            ends = counts.cumsum()
            at = min(max(int(np.searchsorted(ends, rank, side="right")), 1), BINS)
            width = (high - low) / BINS
            before, inside, low, high = int(ends[at - 1]), int(counts[at]), low + (at - 1) * width, low + at * width

        def rest(one, two, chunks, twice) -> pd.DataFrame:
            parts, above = [], []
            for _, own, squares in chunks:
                d = kept(own, squares)
                parts.append(d[(d >= low) & (d < high)])
                above += [d[d >= high].min()] if (d >= high).any() else []
            values, k = np.unique(np.concatenate(parts), return_counts=True)
            return pd.DataFrame({"d": [*values, *([min(above)] if above else [])], "n": [*(k * (1 + twice)), *([0] if above else [])]})

        got = self.over(rest, "d double, n long").groupBy("d").agg(F.sum("n").alias("n")).groupBy("n", "d").count().orderBy("d").collect()
        values, ends = np.array([r.d for r in got if r.n]), np.cumsum([r.n for r in got if r.n])
        above = [r.d for r in got if not r.n]
        if not len(values):  # a value on the edge of the last range
            return float(above[0] if above else low)
        place = lambda k: values[min(int(np.searchsorted(ends, k - before, side="right")), len(values) - 1)]
        first = place(rank)
        if n % 2:
            return float(first)
        return float((first + (place(rank + 1) if rank + 1 - before < ends[-1] or not above else above[0])) / 2)

    def kernel_sums(self, width: float) -> DataFrame:
        """id, x, y, n, total: of each vector of kind x the sum of its RBF kernel with n vectors of kind y, in as many rows as blocks."""

        def sums(one, two, chunks, twice) -> pd.DataFrame:
            out, back = [], np.zeros((2, len(two[0])))
            for at, _, squares in chunks:
                kernel = np.exp(squares / -width) if width else (squares == 0).astype(float)
                kinds = one[1][at]
                for y in (0, 1):
                    out.append(pd.DataFrame({"id": one[0][at], "x": kinds, "y": y, "n": int((two[1] == y).sum()), "total": kernel[:, two[1] == y].sum(axis=1)}))
                    back[y] += kernel[kinds == y].sum(axis=0)
            if twice:
                out += [pd.DataFrame({"id": two[0], "x": two[1], "y": y, "n": int((one[1] == y).sum()), "total": back[y]}) for y in (0, 1)]
            return pd.concat(out)

        return self.over(sums, "id long, x int, y int, n long, total double").where("n > 0")


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(dtype=np.int64), rows["cur"].to_numpy(dtype=np.int32), np.array(rows["embedding"].tolist(), dtype=np.float64)


def _chunks(one: tuple, two: tuple) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Of ``CHUNK`` rows of ``one`` at a time: which ones, where they are themselves, and their squared distances to ``two``."""
    ids, matrix = two[0], two[2]
    norms = np.einsum("ij,ij->i", matrix, matrix)
    for i in range(0, len(one[0]), CHUNK):
        at = slice(i, i + CHUNK)
        x = one[2][at]
        scale = np.einsum("ij,ij->i", x, x)[:, None] + norms
        squares = np.clip(scale - 2.0 * (x @ matrix.T), 0.0, None)
        own = one[0][at][:, None] == ids
        # Equal vectors are at 0, not at what rounding leaves.
        squares[own | (squares <= 1e-13 * scale)] = 0.0
        yield at, own, squares


def mmd_permutation(pairs: Pairs, permutations: int = 200, seed: int = 0) -> tuple[float, float]:
    """``stats.mmd_test`` of all reference vectors (cur 0) against the current ones (cur 1), both ordered by id.

    With weights 1/n, and -1/m on a set S of m vectors, the form w' K w needs only the kernel's whole sum, its row sums
    on S and the few values inside S. Row sums are taken in pairs of blocks; the driver draws the places of the sets, each set's vectors meet in a
    task of their own, and a number for each set comes back.
    """
    spark = pairs.df.sparkSession
    m = pairs.df.where("cur = 1").count()
    n = pairs.n - m
    width = pairs.median(positive=True) or 1.0
    sums = materialize(pairs.kernel_sums(width).groupBy("id").agg(F.sum("total").alias("r")), "sums")
    whole = sums.agg(F.sum("r")).first()[0]
    sets = stats.trial_sets(n, m, permutations, seed)
    drawn = spark.createDataFrame(pd.DataFrame({"trial": np.repeat(np.arange(len(sets)), m), "at": sets.ravel()}), "trial long, at long")
    placed = ordered.numbered(pairs.df, ["cur", "id"], "at", first=0).join(F.broadcast(drawn), "at")

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["embedding"].tolist(), dtype=np.float64)
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=-1)
        return pd.DataFrame({"trial": rows["trial"].iloc[:1], "own": [float(np.exp(d / -width).sum())], "r": [rows["r"].sum()]})

    a, b = 1.0 / n, 1.0 / n + 1.0 / m
    value = F.lit(a * a * whole) - 2 * a * b * F.col("r") + b * b * F.col("own")
    trials = placed.join(sums, "id").select("trial", "embedding", "r").groupBy("trial").applyInPandas(inside, "trial long, own double, r double").select("trial", value.alias("value"))
    got = {r.trial: r.value for r in trials.collect()}
    return float(got[0]), float((1 + sum(v >= got[0] for k, v in got.items() if k)) / (permutations + 1))
