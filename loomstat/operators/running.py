"""Running sums and ranks over a group's order, without a task that sees the whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import written

#: Rows that a range of the order holds, more or less.
ROWS = 100_000


def ranged(df: DataFrame, by: list[str], order: list[Column | str], rows: int | None = None) -> DataFrame:
    """``df``, written, with ``_range`` and ``_row``: ranges of about ``rows`` rows, numbered in the order of ``by`` and ``order``.

    There are as many ranges as the count of rows asks for. Bounds are sampled over all keys and, last, a number of the
    row, so rows that tie on any of them are split like others, even those that are equal in all columns.
    """
    numbered = written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    n = max(1, -(-numbered.count() // (rows or ROWS)))
    dealt = numbered.repartitionByRange(n, *by, *order, "_row")
    return written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str], backwards: bool = False) -> DataFrame:
    """Adds to every row the sums of columns over the rows before and with it: ``sums`` maps column to new name.

    Sums run within a range and over the totals of the ranges before. A table that ``ranged`` has cut keeps its ranges,
    another is cut by ``order``; ``backwards`` runs from the last range to the first, for an ``order`` that is the other
    way round than the one that cut. Rows that are equal in all of ``order`` come in any order, each after the other.
    A null group is a group like others.
    """
    if "_range" not in df.columns:
        df = ranged(df, by, order)
    place = F.desc("_range") if backwards else F.asc("_range")
    totals = df.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_t_{n}") for c, n in sums.items()))
    before = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_g_{i}" for i, c in enumerate([*by, "_range"])}
    keys = [F.col(c).alias(n) for c, n in names.items()]
    starts = totals.select(*keys, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums.values()))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    out = df.withColumns({f"_w_{n}": F.sum(c).over(within) for c, n in sums.items()}).join(starts, same)
    out = out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_w_{n}") for n in sums.values()})
    return out.drop("_range", "_row", *names.values(), *(f"_{k}_{n}" for n in sums.values() for k in "sw"))
