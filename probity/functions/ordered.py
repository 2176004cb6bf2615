"""Scans in order with carried state: numbers, previous rows and running values over all partitions.

Rows are dealt by ranges of their order, sorted in their partitions and written with the partition and the place in it. What a partition
needs of those before it is a few numbers: how many rows they have, a group's last row, a group's totals. So no group and no table
is sorted in one task, however many of the rows it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.sources.storage import materialize

#: The lower bits of a monotonically increasing id are the row's place in its partition.
_PLACE_BITS = 33


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def placed(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df``, written, with _part and _place: the range of ``order`` that a row lies in, and its place there from 0.

    A range sort deals rows of equal order to one task, so the order must part rows.
    """
    keys = _columns(order)
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place")), "placed")


def numbered(df: DataFrame, order: list[str | Column], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name`` long: ``first``, ``first`` + 1... in ``order``."""
    rows = placed(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each partition of the sort.
    starts = sizes.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return joined.select(*df.columns, (F.col("_before") + F.col("_place") + first).cast("long").alias(name))


def previous(df: DataFrame, by: list[str], order: list[str], columns: dict[str, str], rows: DataFrame | None = None) -> DataFrame:
    """``df`` with columns of the row before in its group (``by``): new name to column; null for a group's first row.

    ``rows`` is ``df`` as ``placed`` by ``by`` and ``order``, where a caller reads it too.
    """
    rows = placed(df, [*by, *order]) if rows is None else rows
    # The last row of a group in each range it lies in is the one before the group's first row in its next range: it is put before that row, so nothing is joined.
    read = [c for c in dict.fromkeys(columns.values()) if c not in by]
    last = rows.groupBy(*by, "_part").agg(F.max_by(F.struct(*read, F.lit(True).alias("_has")), "_place").alias("_end"))
    over = Window.partitionBy(*by).orderBy("_part")
    carry = last.select(*by, "_part", F.lag("_end").over(over).alias("_carried")).where(F.col("_carried").isNotNull())
    carry = carry.select(*by, "_part", F.lit(-1).cast("long").alias("_place"), *[F.col(f"_carried.{c}") for c in read])
    inside = Window.partitionBy(*by, "_part").orderBy("_place")
    lagged = rows.unionByName(carry, allowMissingColumns=True).withColumns({f"_lag_{n}": F.lag(c).over(inside) for n, c in columns.items()})
    return lagged.where(F.col("_place") >= 0).select(*df.columns, *[F.col(f"_lag_{n}").alias(n) for n in columns])


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, str], fold: Callable[[Column], Column] = F.sum, inclusive: bool = True) -> DataFrame:
    """``df`` with running folds of columns (new name to column) in its group: of the rows so far, or of those before.

    ``fold`` is an aggregate that can be folded again over partial results of itself: a sum, a maximum, a minimum.
    """
    rows = placed(df, [*by, *order])
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*by, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, end)
    part = rows.withColumns({f"_run_{n}": fold(F.col(c)).over(inside) for n, c in values.items()})
    totals = rows.groupBy(*by, "_part").agg(*[fold(F.col(c)).alias(f"_all_{n}") for n, c in values.items()])
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_of"), *[fold(F.col(f"_all_{n}")).over(over).alias(f"_car_{n}") for n in values])
    same = F.col("_part") == F.col("_of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    # Greatest and least pass over nulls as the folds do; a sum is what one side has where the other has none.
    join = {F.max: F.greatest, F.min: F.least}.get(fold, lambda a, b: F.coalesce(F.col(a) + F.col(b), a, b))
    return part.join(carry, same).select(*df.columns, *[join(f"_run_{n}", f"_car_{n}").alias(n) for n in values])
