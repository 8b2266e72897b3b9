"""Validation of runs against planted effects: do estimates cover the truth, and is the rest calibrated?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import CHI2_MEDIAN, chi2_1_quantile
from .selection import medians

#: Standard errors within which an estimate covers the truth, and the band in which lambda is fine.
WITHIN, BAND = 4.0, (0.8, 1.2)


def truth_check(results: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("run",), within: float = WITHIN, band: tuple[float, float] = BAND) -> DataFrame:
    """Per run (``by``): planted, found, covered, hits, n, lambda, fine.

    ``truth`` has ``by``, predictor and true_effect (null: planted, but of no known size; then only its hit counts).
    planted counts its rows, found those with a result, covered those whose effect lies within ``within`` standard
    errors of the truth or has no size, hits those with P below the run's Bonferroni threshold. lambda is over the rows
    that are not planted; it is fine within ``band``, and a run is if all its planted rows are covered too.
    """
    key = [*by, "predictor"]
    met = truth.join(results.select(*key, "beta", "SE", "P"), key, "left")
    near = F.col("true_effect").isNull() & F.col("P").isNotNull() | (F.abs(F.col("beta") - F.col("true_effect")) <= F.lit(within) * F.col("SE"))
    line = results.groupBy(*by).agg((F.lit(0.05) / F.count(F.lit(1))).alias("_line"))
    seen = met.join(line, list(by), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("planted"), F.count("P").alias("found"), F.count_if(near).alias("covered"), F.count_if(F.col("P") < F.col("_line")).alias("hits")
    )
    rest = results.join(truth.select(*key), key, "left_anti").where("P > 0 AND P <= 1").withColumn("_x", chi2_1_quantile(F.col("P")))
    scale = medians(rest, list(by), "_x").select(*by, "n", (F.col("median") / CHI2_MEDIAN).alias("lambda"))
    out = seen.join(scale, list(by), "left")
    return out.withColumn("fine", F.coalesce((F.col("covered") == F.col("planted")) & F.col("lambda").between(*band), F.lit(False)))
