"""Nearest neighbours against a trusted reference set, votes, and outlier distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.sources.storage import materialize

K_LABEL, VOTE_SHARE = 11, 0.7
#: Vectors of the current window.
WINDOW = 60
#: A reference block that is sent to the tasks has at most so many vectors.
BLOCK_ROWS = 20_000


#: Products that a task holds at a time, and how much less than the k-th one rounds to the same nine places at most.
PRODUCTS, _ROUNDING = 2_000_000, 2e-9


def _top(own: np.ndarray, queries: list, ids: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k most similar of a block of reference vectors for each query; only those that may be among them are rounded and put in order."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    step, few = max(1, PRODUCTS // max(1, len(ids))), min(k, len(ids))
    for i in range(0, len(own) if few else 0, step):
        sims = np.array(queries[i : i + step], dtype=np.float64) @ matrix.T
        sims[np.isnan(sims)] = -np.inf
        if exclude_self:
            sims[own[i : i + step, None] == ids[None, :]] = -np.inf
        least = np.partition(sims, len(ids) - few, axis=1)[:, len(ids) - few]
        row, col = np.nonzero(sims >= least[:, None] - _ROUNDING)
        sim, ref = np.round(sims[row, col], 9), ids[col]
        order = np.lexsort((ref, -sim, row))
        row, ref, sim = row[order], ref[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = (place < k) & np.isfinite(sim)
        found.append((own[i : i + step][row[kept]], ref[kept], sim[kept]))
    query, ref, sim = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({"query_id": query, "ref_id": ref, "sim": sim})


def knn(queries: DataFrame, reference: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """query_id, ref_id, sim (nine places), rank of the k most similar reference vectors, ties by ref_id.

    A reference of at most ``BLOCK_ROWS`` vectors is sent to the tasks. A larger one is cut into cells around pivots
    (``_cells``); a query visits the cells that the triangle inequality can't rule out, and the result is exact. Where that leaves
    more than ``MOST_VISITS`` of all visits, as of vectors without clusters, pairs of blocks are measured instead. Vectors are taken to have unit length
    for the bound; others have a bound by their own length.
    """
    spark, schema = queries.sparkSession, "query_id long, ref_id long, sim double"
    n = reference.count()
    if n <= BLOCK_ROWS:
        rows = reference.select(id_col, vector).toPandas()
        sent = spark.sparkContext.broadcast((rows[id_col].to_numpy(dtype=np.int64), np.array(rows[vector].tolist(), dtype=np.float64)))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for batch in batches:
                if len(batch) and len(ids):
                    yield _top(batch[id_col].to_numpy(dtype=np.int64), batch[vector].tolist(), ids, matrix, k, exclude_self)

        found = queries.select(id_col, vector).mapInPandas(near, schema)
    else:
        refs, asked, pivots = _cells(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")), reference.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")), n)
        # The nearest cell gives k candidates, and with the least of them a bound for all others.
        first = materialize(_measure(refs, asked.select("id", "v", F.col("order")[0].alias("cell")), k, exclude_self, schema), "first")
        bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("sim").alias("_sim"))
        visits = visited(asked, bound, k).where(F.col("cell") != F.col("order")[0])
        total, alike = visits.select("cell").count(), asked.count() * pivots
        if total <= MOST_VISITS * alike:
            found = first.unionByName(_measure(refs, visits.select("id", "v", "cell"), k, exclude_self, schema))
        else:
            found = _by_blocks(refs, asked, n, k, exclude_self, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Pivots at most, and reference vectors for each of them.
PIVOTS, PER_PIVOT = 4096, 1_000
#: The share of all visits of cells by queries from which on blocks are measured instead.
MOST_VISITS = 0.25
#: Rounding of similarities, to nine places, and of distances that they are taken from.
_SLACK = 1e-6


def _cells(queries: DataFrame, reference: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Reference rows (cell, id, v), and queries (id, v, order: cells by distance, gaps: how near any vector of each may lie), both written.

    Pivots are reference vectors of the least hash, so many that a cell has some ``PER_PIVOT``; they are sent to the tasks, at most ``PIVOTS`` of them. A
    vector belongs to its nearest pivot; a cell's radius is the distance of its farthest vector, so another vector lies at
    least the distance to the pivot less the radius away from all of a cell.
    """
    spark, count = reference.sparkSession, int(min(PIVOTS, max(2, -(-n // PER_PIVOT))))
    chosen = reference.orderBy(F.xxhash64("id"), "id").limit(count).select("v").toPandas()["v"].tolist()
    sent = spark.sparkContext.broadcast(np.array(chosen, dtype=np.float64))

    def distances(rows: pd.Series) -> np.ndarray:
        x, p = np.array(rows.tolist(), dtype=np.float64), sent.value
        squares = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)
        return np.sqrt(np.clip(squares, 0.0, None))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(batch["v"])
                yield batch.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

    kind = dict(reference.dtypes)["v"]
    refs = materialize(reference.mapInPandas(assign, f"id long, v {kind}, cell int, far double"), "cells")
    radii = {r.cell: r.r for r in refs.groupBy("cell").agg(F.max("far").alias("r")).collect()}  # one number for each pivot
    radius = np.array([radii.get(i, -np.inf) for i in range(len(chosen))])

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        real = np.flatnonzero(np.isfinite(radius))
        for batch in batches:
            if len(batch):
                d = distances(batch["v"])[:, real]
                order = np.argsort(d, axis=1)
                gaps = np.take_along_axis(np.clip(d - radius[real], 0.0, None), order, axis=1)
                yield batch.assign(order=real[order].astype(np.int32).tolist(), gaps=gaps.tolist())

    asked = materialize(queries.mapInPandas(ranked, f"id long, v {kind}, order array<int>, gaps array<double>"), "asked")
    return refs.select("cell", "id", "v"), asked, len(chosen)


def visited(asked: DataFrame, bound: DataFrame, k: int) -> DataFrame:
    """``asked`` once for each cell that may hold one of its k nearest, given the least of k similarities found so far (bound: query_id, _n, _sim).

    Unit vectors at distance d have the similarity 1 - d * d / 2. Vectors of other lengths, and queries with fewer than k candidates, visit every cell.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    known = asked.join(bound, F.col("id") == F.col("query_id"), "left")
    farthest = F.when((F.col("_n") >= k) & (F.abs(length - 1) < _SLACK), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("_sim"))) + F.sqrt(F.lit(_SLACK)))
    cells = F.filter(F.arrays_zip("order", "gaps"), lambda c: farthest.isNull() | (c["gaps"] <= farthest))
    return known.select("id", "v", "order", F.explode(F.transform(cells, lambda c: c["order"])).alias("cell"))


def _measure(refs: DataFrame, asked: DataFrame, k: int, exclude_self: bool, schema: str) -> DataFrame:
    """The k most similar reference vectors of the same cell for each query (id, v, cell).

    A cell's vectors come first in its partition and stay while its queries stream past them, so a cell that all queries visit needs no
    copies; of a large cell ``BLOCK_ROWS`` vectors are measured at a time.
    """
    both = refs.select("cell", F.lit(0).alias("kind"), "id", "v").unionByName(asked.select("cell", F.lit(1).alias("kind"), "id", "v"))
    dealt = both.repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, rows = None, [], []
        block: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for (at, kind), part in batch.groupby(["cell", "kind"], sort=True):
                if at != cell:
                    cell, ids, rows, block = at, [], [], []
                if kind == 0:
                    ids += part["id"].tolist()
                    rows += part["v"].tolist()
                    continue
                if ids:
                    block += [(np.array(ids[i : i + BLOCK_ROWS], dtype=np.int64), np.array(rows[i : i + BLOCK_ROWS], dtype=np.float64)) for i in range(0, len(ids), BLOCK_ROWS)]
                    ids, rows = [], []
                for some, matrix in block:
                    yield _top(part["id"].to_numpy(dtype=np.int64), part["v"].tolist(), some, matrix, k, exclude_self)

    return dealt.mapInPandas(run, schema)


def _by_blocks(refs: DataFrame, asked: DataFrame, n: int, k: int, exclude_self: bool, schema: str) -> DataFrame:
    """The k most similar vectors of each of ``n`` reference vectors' blocks for each query (id, v): every pair, in pairs of blocks of some ``BLOCK_ROWS`` vectors.

    So a query is sent once for each block, not once for each cell.
    """
    wide, high = (max(1, -(-rows // BLOCK_ROWS)) for rows in (n, asked.count()))
    at = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select("id", "v", at(high).alias("i"), every(wide).alias("j"))
    right = refs.select("id", "v", every(high).alias("i"), at(wide).alias("j"))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(two["v"].tolist(), dtype=np.float64)
        return _top(one["id"].to_numpy(dtype=np.int64), one["v"].tolist(), two["id"].to_numpy(dtype=np.int64), matrix, k, exclude_self)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, schema)


def label_vote(neighbours: DataFrame, reference: DataFrame, queries: DataFrame, id_col: str = "vec_id", label: str = "label", share: float = VOTE_SHARE) -> DataFrame:
    """query_id, given, majority, votes, share, flagged: the neighbours' majority against the given label.

    A tie goes to the label of the nearer neighbour; a query is flagged if its label differs and the share is reached.
    """
    named = neighbours.join(reference.select(F.col(id_col).alias("ref_id"), F.col(label).alias("vote")), "ref_id")
    counted = named.groupBy("query_id", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    best = counted.groupBy("query_id").agg(F.max_by("vote", F.struct("n", (-F.col("first")).alias("f"))).alias("majority"), F.max("n").alias("votes"), F.sum("n").alias("k"))
    out = best.join(queries.select(F.col(id_col).alias("query_id"), F.col(label).alias("given")), "query_id")
    part = F.col("votes") / F.col("k")
    return out.select("query_id", "given", "majority", "votes", F.round(part, 9).alias("share"), ((F.col("majority") != F.col("given")) & (part >= share)).alias("flagged"))


def confusion_pairs(votes: DataFrame, group: Column) -> DataFrame:
    """grp, given, majority, n of the rows whose majority differs."""
    return votes.where("given <> majority").groupBy(group.alias("grp"), "given", "majority").agg(F.count(F.lit(1)).alias("n"))


def ood_distance(neighbours: DataFrame) -> DataFrame:
    """query_id, distance: the mean cosine distance to the neighbours."""
    return neighbours.groupBy("query_id").agg(F.round(F.avg(1 - F.col("sim")), 6).alias("distance"))


def mahalanobis(df: DataFrame, reference: DataFrame, features: list[str], ridge: float = 1e-3) -> Column:
    """Distance of a row from the reference's mean under its sample covariance plus a ridge.

    One aggregation of the reference gives d + d * d numbers; the inverse enters the plan as literals.
    """
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = reference.agg(*[F.avg(f) for f in features], *[F.covar_samp(features[i], features[j]) for i, j in pairs]).first()
    d = len(features)
    mean, cov = np.array(row[:d], dtype=float), np.eye(d) * ridge
    for (i, j), v in zip(pairs, row[d:], strict=True):
        cov[i, j] += v
        if i != j:
            cov[j, i] += v
    inverse = np.linalg.pinv(cov)
    delta = [F.col(f) - F.lit(float(m)) for f, m in zip(features, mean, strict=True)]
    return F.sqrt(sum((F.lit(float(inverse[i, j])) * delta[i] * delta[j] for i in range(d) for j in range(d)), F.lit(0.0)))
