"""Runs of neighbouring rows along an axis, without one task for a whole chromosome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions of one bin; a window covers a bin, so its rows are bounded by what stands there.
BIN = 1 << 16


def runs(df: DataFrame, keys: list[str], pos: str, order: list[str], breaks: Callable[[Column], Column], group: str = "group", width: int = BIN) -> DataFrame:
    """df with `group`, the number of the run within keys: rows in the order `order` (which starts with
    pos), cut where breaks(previous row as a struct) is true.

    Windows run within bins of pos. What crosses a border, the last row of the bin before and the
    number of cuts so far, comes from a table with one row for each bin that holds rows.
    """
    cols = list(dict.fromkeys([*order]))
    at = df.withColumn("__bin", F.floor(F.col(pos) / width))
    last = at.groupBy(*keys, "__bin").agg(F.max(F.struct(*cols)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bin")
    last = last.withColumn("__before", F.lag("__last").over(across)).drop("__last")
    within = Window.partitionBy(*keys, "__bin").orderBy(*cols)
    at = at.withColumn("__prev", F.lag(F.struct(*cols)).over(within)).join(last, [*keys, "__bin"])
    at = at.withColumn("__prev", F.coalesce("__prev", "__before"))
    cut = F.when(F.col("__prev").isNull() | breaks(F.col("__prev")), 1).otherwise(0)
    at = at.withColumn("__cut", cut).withColumn("__n", F.sum("__cut").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = at.groupBy(*keys, "__bin").agg(F.sum("__cut").alias("__cuts"))
    sums = sums.withColumn("__up", F.coalesce(F.sum("__cuts").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__cuts")
    return at.join(sums, [*keys, "__bin"]).withColumn(group, F.col("__up") + F.col("__n")).drop("__bin", "__prev", "__before", "__cut", "__n", "__up")


def near_positions(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, window: int, how: str = "inner") -> DataFrame:
    """Pairs of rows whose positions differ by at most `window`: an equi-join on bins of that width, each left row looking in three."""
    size = window + 1
    a = left.withColumn("__b", F.explode(F.array(*[F.floor(F.col(left_pos) / size) + d for d in (-1, 0, 1)])))
    b = right.withColumn("__b", F.floor(F.col(right_pos) / size))
    return a.join(b, [*keys, "__b"], how).where(F.abs(F.col(left_pos) - F.col(right_pos)) <= window).drop("__b")
