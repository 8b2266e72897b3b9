"""Exact order statistics of groups by refined counts: no task holds a group's values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import written

#: Ranges into which a round cuts what is left of a group.
RANGES = 1024


def selected(rows: DataFrame, by: list[str], value: str, targets: DataFrame) -> DataFrame:
    """(by, rank, value): of each group the value with each rank (from 1) in ``targets`` (by, rank), in rising order.

    A round counts the values between a target's bounds in RANGES equal ranges, with the least and greatest value of
    each (partial sums by task), and goes on in the range that holds the rank. It ends where that range has one value,
    however often. Equal bounds can't be cut further, and unequal ones always are, so a few rounds are enough.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf)).select(*by, F.col(value).cast("double").alias("_v"))
    bounds = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    active = written(targets.select(*by, "rank").distinct().join(bounds, by).withColumn("_below", F.lit(0).cast("long")), "select")
    key, done = [*by, "rank"], None
    before = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        over = active.where("_low = _high").select(*key, F.col("_low").alias("value"))
        done = over if done is None else done.unionByName(over)
        active = active.where("_low < _high")
        if not active.limit(1).count():
            return done
        met = rows.join(active, by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        at = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGES), F.lit(RANGES - 1))
        counts = met.groupBy(*key, "_below", at.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        sums = counts.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))  # RANGES rows a target
        holds = (F.col("_start") < F.col("rank")) & (F.col("rank") <= F.col("_start") + F.col("_n"))
        active = written(sums.where(holds).select(*key, "_low", "_high", F.col("_start").alias("_below")), "select")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, n): the exact median of the finite values of each group, and how many there are."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf))
    sizes = written(finite.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "select")
    middle = F.explode(F.array(F.floor((F.col("n") + 1) / 2).cast("long"), (F.floor(F.col("n") / 2) + 1).cast("long")))
    found = selected(finite, by, value, sizes.select(*by, middle.alias("rank")))
    return found.groupBy(*by).agg(F.avg("value").alias("median")).join(sizes, by)
