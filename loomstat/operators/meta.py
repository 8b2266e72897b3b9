"""Meta-analysis of strata: inverse-variance fixed effects, DerSimonian-Laird random effects, allele harmonisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_p, normal_p
from ..plans.stages import written
from ..sources.config import ALPHA, GENOMEWIDE

#: Effect columns by preference, and their errors and P-values.
EFFECTS = (("beta", "SE", "P"), ("beta_mean", "SE_mean", "P_mean"), ("tau_var", "SE_var", "P_var"), ("beta_SNPxTIME", "SE_SNPxTIME", "P_SNPxTIME"))
#: The band of allele frequencies and their spread over strata that make a strand doubtful.
BAND, SPREAD = (0.40, 0.60), 0.15


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def effect_axis(results: DataFrame, first_stratum: str) -> tuple[str, str, str]:
    """The first effect column with any value in the first stratum."""
    there = [e for e in EFFECTS if e[0] in results.columns]
    one = results.where(F.col("stratum") == first_stratum).agg(*(F.count(e[0]).alias(e[0]) for e in there)).first()
    return next((e for e in there if one[e[0]]), there[0])


def harmonised(results: DataFrame, key: tuple[str, ...] = ("predictor",)) -> DataFrame:
    """Effects turned to one allele: that of the first stratum (in order) that has one; elsewhere beta and EAF flip.

    Adds beta_h, eaf_h, ref_allele. Alleles are compared as written; a third allele flips too.
    """
    order = Window.partitionBy(*key).orderBy("stratum").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ref = F.first("effect_allele", ignorenulls=True).over(order)
    flip = F.coalesce(F.col("effect_allele") != F.col("ref_allele"), F.lit(False))
    out = results.withColumn("ref_allele", ref)
    return out.withColumns({"beta_h": F.when(flip, -F.col("beta")).otherwise(F.col("beta")), "eaf_h": F.when(flip, 1 - F.col("EAF")).otherwise(F.col("EAF"))})


def combined(rows: DataFrame, key: tuple[str, ...] = ("predictor",)) -> DataFrame:
    """Fixed and random effects, heterogeneity and direction per key from beta_h and SE of its usable studies.

    One aggregation: with w = 1 / SE^2, everything follows from sums of w, w^2, w*b and w*b^2 about a shifted b, and
    the random effects need the pairs once more; a key has as many pairs as there are strata.
    """
    ok = finite(F.col("beta_h")) & finite(F.col("SE")) & (F.col("SE") > 0)
    study = F.when(ok, F.struct("stratum", F.col("beta_h").alias("b"), (1 / (F.col("SE") * F.col("SE"))).alias("w"), F.col("N").alias("n")))
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(study)).alias("s"))  # one entry a stratum
    add = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    g = g.withColumn("n_studies", F.size("s").cast("long")).withColumn("_w", add(lambda x: x["w"]))
    k = F.col("n_studies")
    g = g.withColumn("beta_FE", F.when(k > 0, add(lambda x: x["w"] * x["b"]) / F.col("_w"))).withColumn("SE_FE", F.when(k > 0, 1 / F.sqrt("_w")))
    fe = F.col("beta_FE")
    g = g.withColumn("Q", F.when(k > 1, add(lambda x: x["w"] * (x["b"] - fe) * (x["b"] - fe))))
    df = (k - 1).cast("double")
    g = g.withColumn("I2", F.when(F.col("Q") > 0, F.greatest(F.lit(0.0), (F.col("Q") - df) / F.col("Q") * 100)).when(F.col("Q") <= 0, 0.0))
    spread = F.col("_w") - add(lambda x: x["w"] * x["w"]) / F.col("_w")
    g = g.withColumn("tau2", F.when(k > 1, F.when(spread > 0, F.greatest(F.lit(0.0), (F.col("Q") - df) / spread)).otherwise(0.0)))
    t = F.coalesce("tau2", F.lit(0.0))
    w2 = lambda x: 1 / (1 / x["w"] + t)
    g = g.withColumn("_v", add(w2))
    g = g.withColumn("beta_RE", F.when(k == 1, fe).when(k > 1, add(lambda x: w2(x) * x["b"]) / F.col("_v"))).withColumn("SE_RE", F.when(k == 1, F.col("SE_FE")).when(k > 1, 1 / F.sqrt("_v")))
    sign = lambda x: F.when(x["b"] > 0, "+").when(x["b"] < 0, "-").otherwise("0")
    g = g.withColumn("direction", F.array_join(F.transform("s", sign), "")).withColumn("N_total", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0)).cast("long")))
    g = g.withColumns({f"Z_{m}": F.try_divide(F.col(f"beta_{m}"), F.col(f"SE_{m}")) for m in ("FE", "RE")})
    names = [*key, "n_studies", "N_total", "direction", "beta_FE", "SE_FE", "Z_FE", "beta_RE", "SE_RE", "Z_RE", "Q", "I2", "tau2"]
    return g.select(*names)


def with_p(meta: DataFrame) -> DataFrame:
    """P-values, and significance over all rows; a missing P is not significant."""
    out = meta.withColumns({"P_FE": normal_p(F.col("Z_FE")), "P_RE": normal_p(F.col("Z_RE")), "P_het": chi2_p(F.col("Q"), (F.col("n_studies") - 1).cast("double"))})
    rows = meta.agg((F.lit(ALPHA) / F.count(F.lit(1))).alias("bonferroni_threshold"))
    out = out.crossJoin(F.broadcast(rows))  # one row
    yes = lambda m, limit: F.coalesce(F.col(f"P_{m}") < limit, F.lit(False))
    return out.withColumns({f"significant_{m}": yes(m, F.col("bonferroni_threshold")) for m in ("FE", "RE")} | {f"genomewide_{m}": yes(m, F.lit(GENOMEWIDE)) for m in ("FE", "RE")})


def strand_flags(rows: DataFrame, key: tuple[str, ...] = ("predictor",)) -> DataFrame:
    """EAF (harmonised mean), palindromic, allele_mismatch, strand_flag per key from harmonised rows.

    The identity is that of the first stratum. A pair of complementary alleles or an allele foreign to the identity is
    flagged where the frequency is near one half or differs between strata.
    """
    at = F.col("stratum")
    g = rows.groupBy(*key).agg(
        F.min_by("effect_allele", F.when(F.col("effect_allele").isNotNull(), at)).alias("effect_allele"),
        F.min_by("other_allele", F.when(F.col("other_allele").isNotNull(), at)).alias("other_allele"),
        F.collect_set(F.upper("effect_allele")).alias("_seen"),  # at most one entry a stratum
        F.avg("eaf_h").alias("EAF"),
        (F.max("eaf_h") - F.min("eaf_h")).alias("_spread"),
    )
    a, b = F.upper("effect_allele"), F.upper("other_allele")
    pal = F.coalesce((F.length(a) == 1) & (F.translate(a, "ACGT", "TGCA") == b) & a.isin("A", "C", "G", "T"), F.lit(False))
    mismatch = F.exists("_seen", lambda x: ~F.coalesce((x == a) | (x == b), F.lit(False)))
    doubtful = F.coalesce(F.col("EAF").between(*BAND), F.lit(False)) | F.coalesce(F.col("_spread") > SPREAD, F.lit(False))
    g = g.withColumns({"palindromic": pal, "allele_mismatch": mismatch})
    return g.withColumn("strand_flag", (F.col("palindromic") | F.col("allele_mismatch")) & doubtful).drop("_seen", "_spread")


def by_stratum(rows: DataFrame, strata: list[str], key: tuple[str, ...] = ("predictor",)) -> DataFrame:
    """Wide per-stratum columns beta_s, SE_s, P_s, N_s, EAF_s, effects harmonised."""
    values = {"beta": "beta_h", "SE": "SE", "P": "P", "N": "N", "EAF": "eaf_h"}
    at = lambda s, c: F.max(F.when(F.col("stratum") == s, F.col(c)))
    return rows.groupBy(*key).agg(*(at(s, c).alias(f"{n}_{s}") for s in strata for n, c in values.items()))


def placed(results: DataFrame) -> DataFrame:
    """Adds ``_place``: empty, but for ids that stand on several rows of a stratum, which are told apart by it.

    Such rows of different strata meet where position and pair of alleles (in either order) agree, and, if these repeat
    too, by their number in the order of effect allele and effect. So two variants with one id are never one study more
    of each other.
    """
    many = results.groupBy("predictor", "stratum").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("predictor").distinct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in results.columns else F.lit("")
    alleles = F.array_join(F.array_sort(F.array(F.upper(text("effect_allele")), F.upper(text("other_allele")))), "/")
    at = F.concat_ws(":", text("CHR"), text("POS"), alleles)
    order = [c for c in ("effect_allele", "beta", "SE", "P") if c in results.columns]
    number = F.row_number().over(Window.partitionBy("stratum", "predictor", "_at").orderBy(*order))
    repeated = results.join(many, "predictor", "left_semi").withColumn("_at", at).withColumn("_place", F.concat_ws("#", "_at", number)).drop("_at")
    return results.join(many, "predictor", "left_anti").withColumn("_place", F.lit("")).unionByName(repeated)


def meta_analysis(results: DataFrame) -> DataFrame:
    """The whole table for one run: ``results`` has predictor, stratum, alleles, EAF, N and the effect columns.

    A row for each predictor; for an id that repeats within a stratum a row for each of its variants (see ``placed``).
    """
    strata = sorted(r["stratum"] for r in results.select("stratum").distinct().collect())  # one row a stratum
    key = ("predictor", "_place")
    beta, se, p = effect_axis(results, strata[0])
    rows = written(harmonised(placed(results).withColumns({"beta": F.col(beta), "SE": F.col(se), "P": F.col(p)}), key), "studies")
    there = [c for c in ("CHR", "POS", "model_type") if c in rows.columns]
    out = combined(rows, key).join(strand_flags(rows, key), list(key)).join(by_stratum(rows, strata, key), list(key))
    if there:
        out = out.join(rows.groupBy(*key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("stratum"))).alias(c) for c in there)), list(key))
    return with_p(out.drop("_place"))
