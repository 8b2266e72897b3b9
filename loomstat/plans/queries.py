"""Registered queries of the association engine over the trade tables, and the same results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import normal_p
from ..operators import design, meta, nulls, refits, report, scans, tails
from ..sources import binary, genotypes, results
from . import trade
from .stages import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


S, D, V, T = trade.SUBJECTS, trade.DOSAGES, trade.VISITS, trade.STUDY
TABULAR = ["mean_quantity", "mean_discount", "mean_tax", "n_orders", "had_pending"]


def people(spark: SparkSession, sf_dir: str, strata: bool = False) -> DataFrame:
    s = trade.subjects(spark, sf_dir)
    return s.withColumn("strata", F.col("segment") if strata else F.lit("ALL"))


# ---- filters, strata, rows


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IS DISTINCT FROM 'BUILDING' AND NOT c_nationkey IN (1, 2)")
def prefilter_null_semantics(spark, sf_dir):
    c = trade.table(spark, sf_dir, "customer")
    return design.filtered(c, ["c_acctbal > 1000", "c_mktsegment != 'BUILDING'", "c_nationkey not in [1, 2]"]).select("c_custkey", "c_name")


@query(f"WITH {S} SELECT IID, segment AS strata FROM subj WHERE segment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT IID, 'ALL' FROM subj")
def strata_filter(spark, sf_dir):
    return design.stratified(trade.subjects(spark, sf_dir), "segment", [None, "BUILDING", "MACHINERY"]).select("IID", "strata")


@query(f"WITH {S} SELECT IID, round(y, 6) AS y FROM subj WHERE NOT (n_orders < 5) AND (acctbal > 0 OR had_pending = 1) AND y / n_orders < 40000")
def sample_filter(spark, sf_dir):
    s = design.filtered(trade.subjects(spark, sf_dir), "not n_orders < 5 and (acctbal > 0 or had_pending == 1) and y / n_orders < 40000")
    return rounded(s.select("IID", "y"))


@query(f"WITH {V} SELECT count(*) AS n, count(DISTINCT IID) AS subjects, round(sum(price), 4) AS price FROM (SELECT IID, price, CASE WHEN years > 0.5 THEN years END AS late FROM visits) WHERE late IS NOT NULL")
def complete_case(spark, sf_dir):
    v = trade.visits(spark, sf_dir).withColumn("late", F.when(F.col("years") > 0.5, F.col("years")))
    kept = v.na.drop(subset=["IID", "late"])
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("IID").alias("subjects"), F.sum("price").alias("price")), 4)


@query(f"WITH {V} SELECT IID, arg_min(_row, _row) AS first_row, round(arg_min(price, _row), 6) AS price FROM visits GROUP BY IID")
def dedup_first(spark, sf_dir):
    v = design.complete(trade.visits(spark, sf_dir), "IID", ["price"], by=None)
    return rounded(v.select("IID", F.col("_row").alias("first_row"), "price"))


# ---- derived columns


@query(f"WITH {S} SELECT IID, round(ln(y) - log10(n_orders) + greatest(acctbal, 0) / 1000 + sqrt(abs(acctbal)), 6) AS score FROM subj")
def derive_rowwise(spark, sf_dir):
    s = trade.subjects(spark, sf_dir)
    return rounded(design.derived(s, "score", "log(y) - log10(n_orders) + maximum(acctbal, 0) / 1000 + sqrt(abs(acctbal))").select("IID", "score"))


@query(f"WITH {V} SELECT IID, _row, round(first_value(price) OVER (PARTITION BY IID ORDER BY years, _row), 6) AS bl FROM visits")
def derive_baseline(spark, sf_dir):
    return rounded(design.derived(trade.visits(spark, sf_dir), "bl", "baseline_of(price)", time_column="years").select("IID", "_row", "bl"))


@query(f"""WITH {V}, e AS (SELECT IID, arg_min(price, (years, _row)) AS a, arg_max(price, (years, _row)) AS b, count(*) AS n FROM visits GROUP BY IID)
SELECT IID, round(CASE WHEN n >= 2 THEN b - a END, 6) AS change FROM e""")
def derive_delta(spark, sf_dir):
    return rounded(design.derived(trade.visits(spark, sf_dir), "change", "delta(price)", time_column="years").select("IID", "change").distinct())


@query(f"WITH {V} SELECT IID, round(CASE WHEN count(*) >= 2 AND max(years) > min(years) THEN regr_slope(price, years) END, 5) AS slope FROM visits GROUP BY IID")
def derive_slope(spark, sf_dir):
    return rounded(design.derived(trade.visits(spark, sf_dir), "slope", "slope_of(price ~ years)").select("IID", "slope").groupBy("IID").agg(F.first("slope").alias("slope")), 5)


@query(f"WITH {S}, {D} SELECT IID, round(coalesce(value, avg(value) OVER ()), 6) AS snp FROM cells WHERE predictor = 'Brand#11'")
def derive_snp(spark, sf_dir):
    s = trade.subjects(spark, sf_dir)
    d = trade.dosages(spark, sf_dir, s).select("IID", F.col("predictor").alias("ID"), F.col("value").alias("dosage"))
    return rounded(design.derived(s, "snp", "snp(Brand#11)", dosages=d).select("IID", "snp"))


# ---- predictors


LONG = "long AS (" + " UNION ALL ".join(f"SELECT IID, segment, y, acctbal, '{c}' AS predictor, {c} AS value FROM subj" for c in TABULAR) + ")"


@query(f"WITH {S}, {LONG} SELECT IID, predictor, round(value, 6) AS value FROM long")
def unpivot_predictors(spark, sf_dir):
    return rounded(design.unpivoted(trade.subjects(spark, sf_dir), ["IID"], TABULAR))


@query(f"""WITH {S}, {LONG} SELECT predictor, count(*) AS "N", count(value) AS n_obs, round(avg(value), 6) AS predictor_mean, round(stddev_samp(value), 6) AS predictor_sd,
CASE WHEN bool_and(value IN (0, 1)) THEN 'binary' WHEN bool_and(value IN (0, 1, 2)) THEN 'dosage' ELSE 'other' END AS kind FROM long GROUP BY predictor""")
def predictor_kind(spark, sf_dir):
    return rounded(design.kinds(design.unpivoted(trade.subjects(spark, sf_dir), ["IID"], TABULAR), ["predictor"]).drop("sd_pop"))


@query(f"""WITH {S}, {LONG}, m AS (SELECT predictor, avg(value) AS a, stddev_samp(value) AS s, coalesce(bool_and(value IN (0, 1, 2)), false) AS flat FROM long GROUP BY 1)
SELECT IID, predictor, NOT flat AS zscored, round(CASE WHEN flat THEN value ELSE (value - a) / s END, 6) AS value FROM long JOIN m USING (predictor)""")
def tabular_zscore(spark, sf_dir):
    long = design.unpivoted(trade.subjects(spark, sf_dir), ["IID"], TABULAR)
    return rounded(design.z_scored(long, ["predictor"]).select("IID", "predictor", "zscored", "value"))


# ---- variants


@query(f"WITH {S}, {D} SELECT c.IID, predictor, value FROM cells c JOIN subj s ON s.IID = c.IID WHERE s.acctbal > 5000")
def sample_align(spark, sf_dir):
    s = trade.subjects(spark, sf_dir)
    return trade.dosages(spark, sf_dir, s).join(s.where("acctbal > 5000").select("IID"), "IID", "left_semi")


STATS = """st AS (SELECT predictor, count(value) AS n_obs, avg(value) / 2 AS "EAF", avg(value) AS mu, stddev_samp(value) AS sd, count(*) AS n FROM cells GROUP BY 1),
st2 AS (SELECT *, least("EAF", 1 - "EAF") AS "MAF", 1 - n_obs / n::DOUBLE AS missing_rate FROM st)"""


def variant_table(spark, sf_dir):
    s = trade.subjects(spark, sf_dir)
    n = s.count()
    return genotypes.statistics(trade.dosages(spark, sf_dir, s).withColumnRenamed("value", "dosage"), n, ("predictor",))


@query(f"""WITH {S}, {D}, {STATS} SELECT predictor, n_obs, round("EAF", 6) AS "EAF", round("MAF", 6) AS "MAF", round("MAF" * 2 * n_obs, 4) AS "MAC",
round(missing_rate, 6) AS missing_rate, round(mu, 6) AS predictor_mean, round(sd, 6) AS predictor_sd FROM st2""")
def variant_stats(spark, sf_dir):
    return rounded(variant_table(spark, sf_dir).withColumn("MAC", F.round("MAC", 4)))


@query(f"""WITH {S}, {D}, {STATS} SELECT predictor, n_obs FROM st2 WHERE "MAF" >= 0.2 AND "MAF" * 2 * n_obs >= 20 AND missing_rate <= 0.027""")
def variant_qc(spark, sf_dir):
    return genotypes.passing(variant_table(spark, sf_dir), 0.2, 20, 0.027).select("predictor", "n_obs")


@query(f"WITH {S}, {D} SELECT IID, predictor, round(coalesce(value, avg(value) OVER (PARTITION BY predictor)), 6) AS value FROM cells")
def mean_impute(spark, sf_dir):
    s = trade.subjects(spark, sf_dir)
    d = trade.dosages(spark, sf_dir, s).withColumnRenamed("value", "dosage")
    return rounded(genotypes.mean_imputed(d, ("predictor",)).select("IID", "predictor", F.col("dosage").alias("value")))


# ---- linear scans


def linear_sql(cells: str, strata: str, more: str = "", z: bool = False) -> str:
    """A regression on a constant, acctbal and the predictor, by sums of centred products."""
    value = "(value - avg(value) OVER w) / stddev_samp(value) OVER w" if z else "value"
    return f"""i AS (SELECT {strata} AS strata, predictor, IID, value IS NOT NULL AS seen, coalesce(value, avg(value) OVER w) AS g FROM {cells} WINDOW w AS (PARTITION BY predictor, {strata})),
j AS (SELECT i.*, s.y, s.acctbal AS a FROM i JOIN subj s USING (IID){more}),
c AS (SELECT strata, predictor, count(*) AS "N", count(*) FILTER (seen) AS n_obs, regr_sxx(g, g) AS gg, regr_sxx(a, a) AS aa, regr_sxx(y, y) AS yy, regr_sxy(g, a) AS ga, regr_sxy(g, y) AS gy, regr_sxy(a, y) AS ay FROM j GROUP BY 1, 2),
r AS (SELECT *, gg - ga * ga / aa AS g2, gy - ga * ay / aa AS gy2, yy - ay * ay / aa AS y2 FROM c),
lin AS (SELECT *, gy2 / g2 AS beta, sqrt((y2 - gy2 * gy2 / g2) / ("N" - 3) / g2) AS "SE" FROM r)"""


OUT = """SELECT strata, predictor, "N", n_obs, round(beta, 4) AS beta, round("SE", 4) AS "SE", round(beta / "SE", 6) AS t FROM lin"""


def written_cells(d: genotypes.BySubject) -> genotypes.BySubject:
    return genotypes.BySubject(written(d.rows, "cells"), d.predictors)


def linear(spark, sf_dir, strata=False, covariates=("acctbal",), extra=None) -> DataFrame:
    s = written(people(spark, sf_dir, strata).select("strata", "IID", "id", "y", "acctbal"), "people")
    d = trade.cells(spark, sf_dir, s)
    frame = s.select("strata", "IID", "y", "acctbal")
    if extra:
        d = written_cells(d)  # read by the covariate and by the scan
        one = genotypes.mean_imputed(d.of(extra).withColumnRenamed("value", "dosage"), ("predictor",))
        frame = written(frame.join(one.select("IID", F.col("dosage").alias("_snp")), "IID"), "frame")
        covariates = (*covariates, "_snp")
    null = scans.linear_null(frame, "y", list(covariates))
    return scans.linear_scan(d, null, len(covariates), ["IID"], ["predictor"])


def shown(df: DataFrame) -> DataFrame:
    return df.select("strata", "predictor", "N", "n_obs", F.round("beta", 4).alias("beta"), F.round("SE", 4).alias("SE"), F.round("t", 6).alias("t"))


@query(f"WITH {S}, {D}, {linear_sql('cells', repr('ALL'))} {OUT}")
def linear_scan_genetic(spark, sf_dir):
    return shown(linear(spark, sf_dir))


@query(f"WITH {S}, {D}, {linear_sql('cells', 'segment')} {OUT}")
def linear_scan_strata(spark, sf_dir):
    return shown(linear(spark, sf_dir, strata=True))


def tabular(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = design.complete(people(spark, sf_dir), "IID", ["y", "acctbal"])
    long = design.z_scored(design.unpivoted(s, ["strata", "IID"], TABULAR), ["strata", "predictor"])
    null = scans.linear_null(s.select("strata", "IID", "y", "acctbal"), "y", ["acctbal"])
    facts = long.select("strata", "predictor", "zscored", "predictor_mean").distinct()
    return scans.linear_scan(long.select("strata", "IID", "predictor", "value"), null, 1, ["strata", "IID"], ["predictor"]), facts


TAB = f"""WITH {S}, {LONG}, z AS (SELECT IID, predictor, CASE WHEN coalesce(bool_and(value IN (0, 1, 2)) OVER w, false) THEN value ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS value
FROM long WINDOW w AS (PARTITION BY predictor)), {linear_sql('z', repr('ALL'))} {OUT}"""


@query(TAB)
def linear_scan_tabular(spark, sf_dir):
    return shown(tabular(spark, sf_dir)[0])


@query(f"""WITH {S}, {D}, x AS (SELECT IID, coalesce(value, avg(value) OVER ()) AS x FROM cells WHERE predictor = 'Brand#11'),
i AS (SELECT predictor, IID, value IS NOT NULL AS seen, coalesce(value, avg(value) OVER (PARTITION BY predictor)) AS g FROM cells WHERE predictor <> 'Brand#11'),
j AS (SELECT i.*, y, x FROM i JOIN subj USING (IID) JOIN x USING (IID)),
c AS (SELECT predictor, count(*) AS "N", count(*) FILTER (seen) AS n_obs, regr_sxx(g, g) AS gg, regr_sxx(x, x) AS aa, regr_sxx(y, y) AS yy, regr_sxy(g, x) AS ga, regr_sxy(g, y) AS gy, regr_sxy(x, y) AS ay FROM j GROUP BY 1),
r AS (SELECT *, gg - ga * ga / aa AS g2, gy - ga * ay / aa AS gy2, yy - ay * ay / aa AS y2 FROM c),
lin AS (SELECT 'ALL' AS strata, *, gy2 / g2 AS beta, sqrt((y2 - gy2 * gy2 / g2) / ("N" - 3) / g2) AS "SE" FROM r) {OUT}""")
def linear_conditional(spark, sf_dir):
    """Conditioned on a variant, which then can't be told apart from itself and drops out."""
    return shown(linear(spark, sf_dir, covariates=(), extra="Brand#11").where("beta is not null"))


@query(f"""WITH {S}, {D}, {linear_sql('cells', 'segment')} SELECT strata, round(median(pow(beta / "SE", 2)) / 0.45493642311957283, 6) AS lambda, count(*) AS n FROM lin GROUP BY 1""")
def lambda_gc(spark, sf_dir):
    scan = linear(spark, sf_dir, strata=True).withColumn("chi2", F.col("t") * F.col("t"))
    return rounded(report.lambda_gc(scan, ["strata"], "chi2"))


@query(f"""WITH {T}, b AS (SELECT run, pow(beta / "SE", 2) AS x, least("EAF", 1 - "EAF") AS f FROM study),
u AS (SELECT run, 'all' AS band, x FROM b UNION ALL SELECT run, CASE WHEN f >= 0.05 THEN 'common' WHEN f >= 0.01 THEN 'low' ELSE 'rare' END, x FROM b)
SELECT run, band, round(median(x) / 0.45493642311957283, 6) AS lambda, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 20""")
def lambda_by_maf(spark, sf_dir):
    r = trade.study(spark, sf_dir).withColumn("chi2", F.pow(F.col("beta") / F.col("SE"), 2.0))
    return rounded(report.lambda_by_band(r, ["run"], "chi2"))


@query(f"""WITH {T}, k AS (SELECT * FROM study WHERE P > 0 AND P <= 1 AND SE > 0)
SELECT run, predictor, round(0.05 / count(*) OVER (PARTITION BY run), 12) AS threshold, P < 0.05 / count(*) OVER (PARTITION BY run) AS significant, P < 5e-8 AS genomewide FROM k""")
def bonferroni(spark, sf_dir):
    r = scans.thresholds(scans.without_failures(trade.study(spark, sf_dir)), ["run"])
    return r.select("run", "predictor", F.round("bonferroni_threshold", 12).alias("threshold"), "significant", F.col("genomewide_sig").alias("genomewide"))


# ---- logistic


def logistic(spark, sf_dir, covariates) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = written(people(spark, sf_dir), "people").withColumn("acct", F.col("acctbal") / 1000)  # a round of the fit reads it
    null, _ = nulls.logistic_null(s.select("strata", "IID", "big", "acct"), "big", covariates)
    null = written(null, "null")
    d = written_cells(trade.cells(spark, sf_dir, s))  # read by the scan and by its tail
    return scans.logistic_scan(d, null, len(covariates) + 1, ["IID"], ["predictor"]), null, d.long()


@query(f"""WITH {S}, {D}, i AS (SELECT predictor, IID, coalesce(value, avg(value) OVER (PARTITION BY predictor)) AS g FROM cells), n AS (SELECT avg(big) AS p FROM subj),
u AS (SELECT predictor, sum(g * (big - p)) AS "U", regr_sxx(g, g) * any_value(p * (1 - p)) AS "V" FROM i JOIN subj USING (IID), n GROUP BY 1)
SELECT predictor, round("U" / "V", 5) AS beta, round(1 / sqrt("V"), 5) AS "SE", round("U" * "U" / "V", 5) AS chi2 FROM u""")
def logistic_score(spark, sf_dir):
    return rounded(logistic(spark, sf_dir, [])[0].select("predictor", "beta", "SE", "chi2"), 5)


def tail_of(scan: DataFrame, spark, sf_dir) -> DataFrame:
    return tails.tail(scan.withColumn("MAF", F.least(F.col("mu") / 2, 1 - F.col("mu") / 2)), p_cutoff=0.2)


@query()
def spa_logistic(spark, sf_dir):
    """Score P-values of the tail, and from the saddlepoint; where that has none the score's stays."""
    scan, null, d = logistic(spark, sf_dir, ["acct"])
    rows = written(tail_of(scan, spark, sf_dir).select("strata", "predictor", "P"), "tail")
    met, p, w = refits.cells(rows, d, null), F.col("_p"), F.col("_w")
    spa = refits.saddlepoint(met, F.col("g") * (F.col("_y") - p), w, [F.col("_wq0") / w, F.col("_wq1") / w], refits.bernoulli(p))
    return refits.spa_or_score(rows, spa).select("predictor", "P_score", "P", "test")


@query()
def firth_hits(spark, sf_dir):
    scan, null, d = logistic(spark, sf_dir, ["acct"])
    rows = written(tail_of(scan, spark, sf_dir).select("strata", "predictor", "P"), "tail")
    w = F.col("_w")
    out = refits.firth(refits.cells(rows, d, null), "_y", [F.col("_wq0") / w, F.col("_wq1") / w]).withColumn("test", F.lit("firth"))
    return out.select("predictor", "beta", "SE", "test", normal_p(F.col("beta") / F.col("SE")).alias("P"))


# ---- repeated measures


@query(f"""WITH {V}, g AS (SELECT IID, regr_slope(price, years) AS slope, regr_sxx(price, years) AS sxx, regr_sxy(price, years) AS sxy, regr_syy(price, years) AS syy, count(*) AS n_visits FROM visits GROUP BY 1)
SELECT IID, round(slope, 4) AS slope, round(greatest(syy - sxy * sxy / sxx, 0), 3) AS rss, n_visits FROM g WHERE n_visits >= 2 AND sxx > 1e-9""")
def slope_persubject(spark, sf_dir):
    s = design.subject_slopes(trade.visits(spark, sf_dir), "IID", "price", "years")
    return s.select("IID", F.round("slope", 4).alias("slope"), F.round("rss", 3).alias("rss"), "n_visits")


SLOPES = f"""WITH {S}, {D}, {V}, g AS (SELECT IID, regr_slope(price, years) AS slope, count(*) AS n, regr_sxx(price, years) AS sxx FROM visits GROUP BY 1 HAVING count(*) >= 2),
i AS (SELECT predictor, IID, slope, avg(value) OVER (PARTITION BY predictor) AS m, value FROM cells JOIN g USING (IID) WHERE sxx > 0.01),
c AS (SELECT predictor, count(*) AS "N", regr_sxx(coalesce(value, m), coalesce(value, m)) AS gg, regr_sxx(slope, slope) AS yy, regr_sxy(coalesce(value, m), slope) AS gy FROM i GROUP BY 1)
SELECT predictor, "N", round(gy / gg, 4) AS beta, round(sqrt((yy - gy * gy / gg) / ("N" - 2) / gg), 4) AS "SE" FROM c"""


@query(SLOPES)
def slope_scan(spark, sf_dir):
    """Two stages: each subject's slope, then a linear scan of the slopes."""
    s = trade.subjects(spark, sf_dir)
    slopes = design.subject_slopes(trade.visits(spark, sf_dir), "IID", "price", "years").where("sxx > 0.01").withColumn("strata", F.lit("ALL"))
    null = scans.linear_null(written(slopes.select("strata", "IID", "slope"), "slopes"), "slope", [])
    out = scans.linear_scan(trade.cells(spark, sf_dir, s), null, 0, ["IID"], ["predictor"])
    return out.select("predictor", "N", F.round("beta", 4).alias("beta"), F.round("SE", 4).alias("SE"))


def mixed(spark, sf_dir):
    """Subjects, their visits, the visits' products and the fits."""
    s = written(trade.subjects(spark, sf_dir).select("IID", "id", (F.col("acctbal") / 1000).alias("acct")), "people")
    v = trade.visits(spark, sf_dir).select("IID", "id", "years", "price").join(s.select("id", "acct"), "id").withColumn("strata", F.lit("ALL"))  # visits are dealt by id
    products = nulls.subject_products(v, "price", "years", ["acct"], ["strata", "IID"])
    products = written(products, "products")
    return s, v, products, nulls.fit_mixed(products, 3)


@query()
def lmm_components(spark, sf_dir):
    *_, fits = mixed(spark, sf_dir)
    rows = [(s, *map(float, f.alpha), float(f.D[0, 0]), float(f.D[0, 1]), float(f.D[1, 1]), float(f.sigma2), f.rounds, f.converged) for s, f in fits.items()]
    return spark.createDataFrame(rows, "strata string, a0 double, a1 double, a2 double, d00 double, d01 double, d11 double, sigma2 double, rounds int, converged boolean")


@query()
def gallop_scan(spark, sf_dir):
    s, _, products, fits = mixed(spark, sf_dir)
    null = written(nulls.gallop_null(products, fits, 3), "null")
    out = scans.gallop_scan(trade.cells(spark, sf_dir, s), null, {s: f.a_inverse for s, f in fits.items()}, ["IID"], ["predictor"])
    return out.withColumn("converged", F.lit(fits["ALL"].converged))  # one stratum


def dispersion(v: DataFrame, residual: F.Column, t: str) -> DataFrame:
    """Per subject the excess of squared residuals over their log-linear trend in time, and its visits.

    Residuals are written: the trend, the mean and the sums read them one after the other."""
    e = written(v.select("strata", "IID", F.col(t).alias("_t"), (residual * residual).alias("_e2")), "residuals").withColumn("_l", F.log(F.col("_e2") + 1e-8))
    line = e.groupBy("strata").agg(F.regr_slope("_l", "_t").alias("_s"), F.regr_intercept("_l", "_t").alias("_i"))
    ratio = e.join(F.broadcast(line), "strata").withColumn("_ratio", F.col("_e2") / F.exp(F.col("_i") + F.col("_s") * F.col("_t")))  # one row a stratum
    mean = ratio.groupBy("strata").agg(F.avg("_ratio").alias("_mean"))
    return ratio.join(F.broadcast(mean), "strata").groupBy("strata", "IID").agg(F.sum(F.col("_ratio") / F.col("_mean") - 1).alias("excess"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V}, m AS (SELECT *, price - avg(price) OVER (PARTITION BY IID) AS r FROM visits), l AS (SELECT regr_slope(ln(r * r + 1e-8), years) AS s, regr_intercept(ln(r * r + 1e-8), years) AS i FROM m),
q AS (SELECT IID, r * r / exp(i + s * years) AS x FROM m, l) SELECT IID, round(sum(x / (SELECT avg(x) FROM q) - 1), 5) AS excess, count(*) AS n FROM q GROUP BY 1""")
def dispersion_excess(spark, sf_dir):
    from pyspark.sql import Window

    v = trade.visits(spark, sf_dir).withColumn("strata", F.lit("ALL")).withColumn("_r", F.col("price") - F.avg("price").over(Window.partitionBy("IID")))
    return dispersion(v, F.col("_r"), "years").select("IID", F.round("excess", 5).alias("excess"), "n")


@query()
def trajgwas_scan(spark, sf_dir):
    """Mean axis from the mixed model, variance axis from a scan of scaled excess dispersion, and both together."""
    from ..functions.special import chi2_p

    s, v, products, fits = mixed(spark, sf_dir)
    null = written(nulls.gallop_null(products, fits, 3), "null")
    d = written_cells(trade.cells(spark, sf_dir, s))  # read by both scans
    mean = scans.gallop_scan(d, null, {s: f.a_inverse for s, f in fits.items()}, ["IID"], ["predictor"])
    a = fits["ALL"].alpha
    fit = F.lit(float(a[0])) + F.lit(float(a[1])) * F.col("acct") + (F.lit(float(a[2])) + F.col("_b1")) * F.col("years") + F.col("_b0")
    effects = null.select("IID", "_b0", "_b1").join(s.select("IID", "id").distinct(), "IID").drop("IID")
    excess = dispersion(v.join(effects, "id"), F.col("price") - fit, "years")
    scaled = written(excess.withColumn("tau", F.col("excess") / F.sqrt(2.0 * F.col("n"))).join(s.select("IID", "acct").distinct(), "IID"), "scaled")
    tau = scans.linear_scan(d, scans.linear_null(scaled.select("strata", "IID", "tau", "acct"), "tau", ["acct"]), 1, ["IID"], ["predictor"])
    tau = tau.select("strata", "predictor", F.col("beta").alias("tau_var"), F.col("SE").alias("SE_var"), F.col("t").alias("_t"), normal_p(F.col("t")).alias("P_var"))
    out = mean.join(tau, ["strata", "predictor"]).withColumn("_z", F.col("beta_SNP") / F.col("SE_SNP"))
    out = out.withColumn("P_joint", chi2_p(F.col("_z") * F.col("_z") + F.col("_t") * F.col("_t"), F.lit(2.0)))
    return out.select("predictor", "N", F.col("beta_SNP").alias("beta_mean"), F.col("SE_SNP").alias("SE_mean"), F.col("P_SNP").alias("P_mean"), "tau_var", "SE_var", "P_var", "P_joint", F.lit(fits["ALL"].converged).alias("converged"))


# ---- survival


def survival(spark, sf_dir) -> DataFrame:
    """Days from the first to the last order; the event is a pending order."""
    s = people(spark, sf_dir)
    return s.select("strata", "IID", (F.datediff("last_date", "first_date") + 1).cast("double").alias("days"), F.col("had_pending").alias("event"), (F.col("acctbal") / 1000).alias("acct"))


DAYS = "t AS (SELECT IID, (date_diff('day', first_date::DATE, last_date::DATE) + 1)::DOUBLE AS days, had_pending AS event FROM subj)"
HAZARD = "h AS (SELECT days, sum(event) AS d, sum(count(*)) OVER (ORDER BY days DESC) AS r FROM t GROUP BY days), k AS (SELECT days, sum(d / r) OVER (ORDER BY days) AS cum FROM h)"


@query(f"WITH {S}, {DAYS}, {HAZARD} SELECT IID, days, round(event - cum, 6) AS martingale FROM t JOIN k USING (days)")
def cox_martingale(spark, sf_dir):
    null, _ = nulls.cox_null(survival(spark, sf_dir), "days", "event", [])
    return null.select("IID", "days", F.round("_m", 6).alias("martingale"))


COX = f"""WITH {S}, {D}, {DAYS}, {HAZARD}, m AS (SELECT IID, event - cum AS m FROM t JOIN k USING (days)),
i AS (SELECT predictor, m, coalesce(value, avg(value) OVER (PARTITION BY predictor)) AS g FROM cells JOIN m USING (IID)),
c AS (SELECT predictor, count(*) AS "N", regr_sxx(g, g) AS gg, regr_sxx(m, m) AS yy, regr_sxy(g, m) AS gy FROM i GROUP BY 1)
SELECT predictor, "N", round(gy / gg, 6) AS beta, round(sqrt((yy - gy * gy / gg) / ("N" - 2) / gg), 6) AS "SE" FROM c"""


@query(COX)
def cox_scan(spark, sf_dir):
    null, _ = nulls.cox_null(survival(spark, sf_dir), "days", "event", [])
    lin = scans.linear_null(written(null.select("strata", "IID", F.col("_m").alias("m")), "null"), "m", [])
    out = scans.linear_scan(trade.cells(spark, sf_dir, trade.subjects(spark, sf_dir)), lin, 0, ["IID"], ["predictor"])
    return rounded(out.select("predictor", "N", "beta", "SE"))


def cox_tail(spark, sf_dir):
    """The scan of martingale residuals, their null models (Cox, linear) and the cells."""
    null, b = nulls.cox_null(survival(spark, sf_dir), "days", "event", ["acct"])
    null = written(null, "null")
    lin = scans.linear_null(null.select("strata", "IID", F.col("_m").alias("m"), "acct"), "m", ["acct"])
    d = written_cells(trade.cells(spark, sf_dir, trade.subjects(spark, sf_dir)))
    return scans.linear_scan(d, lin, 1, ["IID"], ["predictor"]), null.select("strata", "IID", "_m", "days", "event", "acct"), lin, d


@query()
def spacox(spark, sf_dir):
    scan, null, lin, d = cox_tail(spark, sf_dir)
    rows = written(tail_of(scan, spark, sf_dir).select("strata", "predictor", "P"), "tail")
    spa = refits.empirical(rows, d, lin, 1, tails.Empirical.of(null, "_m"))
    return refits.spa_or_score(rows, spa).select("predictor", "P_score", "P", "test")


@query()
def cox_refit(spark, sf_dir):
    scan, null, _, d = cox_tail(spark, sf_dir)
    rows = written(tail_of(scan, spark, sf_dir).select("strata", "predictor", "P"), "tail")
    out = refits.cox(refits.cells(rows, d.long(), null), "days", "event", ["acct"])
    out = out.withColumn("test", F.when(F.col("model_type").isNull(), "score").otherwise("full"))
    return out.select("predictor", "beta", "SE", "model_type", "test", normal_p(F.col("beta") / F.col("SE")).alias("P"))


# ---- meta-analysis


def studies(spark, sf_dir) -> DataFrame:
    """The scan by segment as studies: every seventh brand is palindromic, one segment reports the other allele."""
    r = linear(spark, sf_dir, strata=True)
    last = F.substring("predictor", -1, 1).cast("int")
    ea, oa = F.when(last % 3 == 0, "A").otherwise("C"), F.when(last % 3 == 0, "T").otherwise("A")
    turned = (F.col("strata") == "BUILDING") & (last % 2 == 1)
    return r.select(
        "predictor", F.col("strata").alias("stratum"), F.when(turned, oa).otherwise(ea).alias("effect_allele"), F.when(turned, ea).otherwise(oa).alias("other_allele"),
        F.when(turned, 1 - F.col("mu") / 2).otherwise(F.col("mu") / 2).alias("EAF"), F.when(turned, -F.col("beta")).otherwise(F.col("beta")).alias("beta"), "SE", "P", "N",
    )


STUDIES = f"""WITH {S}, {D}, {linear_sql('cells', 'segment')}, mu AS (SELECT predictor, segment AS strata, avg(value) AS mu FROM cells GROUP BY 1, 2),
l AS (SELECT lin.*, mu.mu, right(predictor, 1)::INT AS k FROM lin JOIN mu USING (predictor, strata)),
a AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'A' ELSE 'C' END AS ea0, CASE WHEN k % 3 = 0 THEN 'T' ELSE 'A' END AS oa0, strata = 'BUILDING' AND k % 2 = 1 AS turned FROM l),
st AS (SELECT predictor, strata AS stratum, CASE WHEN turned THEN oa0 ELSE ea0 END AS ea, CASE WHEN turned THEN ea0 ELSE oa0 END AS oa,
       CASE WHEN turned THEN 1 - mu / 2 ELSE mu / 2 END AS eaf, CASE WHEN turned THEN -beta ELSE beta END AS beta, "SE" AS se, "N" AS n FROM a),
ref AS (SELECT predictor, arg_min(ea, stratum) AS ref, arg_min(oa, stratum) AS ref_oa FROM st GROUP BY 1),
hm AS (SELECT st.*, ref, ref_oa, CASE WHEN ea <> ref THEN -beta ELSE beta END AS b, CASE WHEN ea <> ref THEN 1 - eaf ELSE eaf END AS f, 1 / (se * se) AS w FROM st JOIN ref USING (predictor)),
fe AS (SELECT predictor, count(*) AS k, sum(w * b) / sum(w) AS bfe, sum(w) AS sw, sum(w * w) AS sw2, sum(n)::BIGINT AS n FROM hm GROUP BY 1),
qq AS (SELECT predictor, sum(w * (b - bfe) * (b - bfe)) AS q FROM hm JOIN fe USING (predictor) GROUP BY 1),
he AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q * 100) ELSE 0 END AS i2 FROM fe JOIN qq USING (predictor)),
re AS (SELECT predictor, sum(b / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS bre, 1 / sqrt(sum(1 / (1 / w + tau2))) AS sre FROM hm JOIN he USING (predictor) GROUP BY 1)"""


def combined(spark, sf_dir):
    return meta.combined(meta.harmonised(studies(spark, sf_dir)))


@query(f"""{STUDIES} SELECT predictor, k AS n_studies, n AS "N_total", round(bfe, 3) AS "beta_FE", round(1 / sqrt(sw), 3) AS "SE_FE", round(bfe * sqrt(sw), 5) AS "Z_FE" FROM fe""")
def meta_fixed(spark, sf_dir):
    m = combined(spark, sf_dir)
    return m.select("predictor", "n_studies", "N_total", F.round("beta_FE", 3).alias("beta_FE"), F.round("SE_FE", 3).alias("SE_FE"), F.round("Z_FE", 5).alias("Z_FE"))


@query(f"""{STUDIES} SELECT predictor, round(bre, 3) AS "beta_RE", round(sre, 3) AS "SE_RE" FROM re""")
def meta_random(spark, sf_dir):
    return rounded(combined(spark, sf_dir).select("predictor", "beta_RE", "SE_RE"), 3)


@query(f"""{STUDIES} SELECT predictor, round(q, 5) AS "Q", round(i2, 4) AS "I2", round(tau2, 0) AS tau2 FROM he""")
def meta_heterogeneity(spark, sf_dir):
    return combined(spark, sf_dir).select("predictor", F.round("Q", 5).alias("Q"), F.round("I2", 4).alias("I2"), F.round("tau2", 0).alias("tau2"))


@query(f"{STUDIES} SELECT predictor, string_agg(CASE WHEN b > 0 THEN '+' WHEN b < 0 THEN '-' ELSE '0' END, '' ORDER BY stratum) AS direction FROM hm GROUP BY 1")
def meta_direction(spark, sf_dir):
    return combined(spark, sf_dir).select("predictor", "direction")


@query(f'{STUDIES} SELECT predictor, stratum, ref AS ref_allele, round(b, 3) AS beta, round(f, 6) AS "EAF" FROM hm')
def meta_harmonize(spark, sf_dir):
    h = meta.harmonised(studies(spark, sf_dir))
    return h.select("predictor", "stratum", "ref_allele", F.round("beta_h", 3).alias("beta"), F.round("eaf_h", 6).alias("EAF"))


@query(f"""{STUDIES}, z AS (SELECT predictor, ref, ref_oa, avg(f) AS f, max(f) - min(f) AS spread, bool_or(ea NOT IN (ref, ref_oa)) AS mis FROM hm GROUP BY 1, 2, 3)
SELECT predictor, ref = 'A' AND ref_oa = 'T' OR ref = 'T' AND ref_oa = 'A' AS palindromic, mis AS allele_mismatch, round(f, 6) AS "EAF",
((ref = 'A' AND ref_oa = 'T' OR ref = 'T' AND ref_oa = 'A') OR mis) AND (f BETWEEN 0.4 AND 0.6 OR spread > 0.15) AS strand_flag FROM z""")
def meta_strand_flags(spark, sf_dir):
    f = meta.strand_flags(meta.harmonised(studies(spark, sf_dir)))
    return f.select("predictor", "palindromic", "allele_mismatch", F.round("EAF", 6).alias("EAF"), "strand_flag")


@query(f"""{STUDIES},
two AS (SELECT predictor, 1 AS v, stratum, beta, se, n, ea, ref FROM hm UNION ALL SELECT 'Brand#11', 2, stratum, -beta, 2 * se, n, ea, ref FROM hm WHERE predictor = 'Brand#12')
SELECT predictor, count(*) AS n_studies, sum(n)::BIGINT AS "N_total", round(sum(CASE WHEN ea <> ref THEN -beta ELSE beta END / (se * se)) / sum(1 / (se * se)), 3) AS "beta_FE" FROM two GROUP BY predictor, v""")
def meta_repeated_ids(spark, sf_dir):
    """One variant more under an id that another has: two rows, each with its own studies."""
    s = written(studies(spark, sf_dir), "studies").withColumns({"CHR": F.lit("1"), "POS": F.lit(1).cast("long")})
    more = s.where("predictor = 'Brand#12'").withColumns({"predictor": F.lit("Brand#11"), "POS": F.lit(2).cast("long"), "beta": -F.col("beta"), "SE": 2 * F.col("SE")})
    m = meta.meta_analysis(s.unionByName(more))
    return m.select("predictor", "n_studies", "N_total", F.round("beta_FE", 3).alias("beta_FE"))


@query()
def meta_table(spark, sf_dir):
    """The whole table with P-values, identities and per-stratum columns."""
    return meta.meta_analysis(written(studies(spark, sf_dir), "studies"))


# ---- reports


@query(f"""WITH {T}, r AS (SELECT run, predictor, P, row_number() OVER (PARTITION BY run ORDER BY P, predictor) AS rank, count(*) OVER (PARTITION BY run) AS n FROM study WHERE P > 0 AND P <= 1)
SELECT run, predictor, rank, round(-log10(P), 6) AS observed, round(-log10((rank - 0.5) / n), 6) AS expected FROM r WHERE n >= 20""")
def qq_points(spark, sf_dir):
    q = report.qq(trade.study(spark, sf_dir).select("run", "predictor", "P"), ["run"])
    return rounded(q.select("run", "predictor", "rank", "observed", "expected"))


@query(f"""WITH {T}, c AS (SELECT CHR, min(POS) AS low, CASE WHEN count(*) > 1 THEN max(POS) - min(POS) ELSE 1 END AS span FROM study GROUP BY 1),
o AS (SELECT CHR, coalesce(sum(span * 1.02::DOUBLE + 1) OVER (ORDER BY substr(CHR, 4)::INT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - low AS off FROM c)
SELECT predictor, round(POS + off, 3) AS x, round(-log10(P), 6) AS mlogp, P < 0.05 / (SELECT count(*) FROM study) AS significant FROM study JOIN o USING (CHR)""")
def manhattan_coords(spark, sf_dir):
    m = report.manhattan(trade.study(spark, sf_dir))
    return m.select("predictor", F.round("x", 3).alias("x"), F.round("mlogp", 6).alias("mlogp"), "significant")


@query(f"""WITH {T}, r AS (SELECT *, P < 0.05 / count(*) OVER () AS significant, row_number() OVER (ORDER BY P, predictor) AS k FROM study)
SELECT predictor, round(beta, 6) AS beta, round(-log10(P), 6) AS mlogp, significant, CASE WHEN significant AND k <= 12 THEN predictor END AS label FROM r""")
def volcano_top(spark, sf_dir):
    return rounded(report.volcano(trade.study(spark, sf_dir)).select("predictor", "beta", "mlogp", "significant", "label"))


@query(f"WITH {T} SELECT run, any_value(model_type) AS model_type, min(N) AS n_min, max(N) AS n_max, count(*) AS tests, count(*) FILTER (P < 5e-8) AS hits FROM study GROUP BY 1")
def coverage_summary(spark, sf_dir):
    return report.coverage(trade.study(spark, sf_dir), ["run"])


@query(f"""WITH {T}, s AS (SELECT run, predictor, P / 1e6 AS P FROM study), b AS (SELECT run, predictor, min(P) AS p FROM s WHERE P < 5e-8 GROUP BY 1, 2)
SELECT run, predictor, round(-log10(p), 6) AS mlogp FROM b ORDER BY p, run, predictor LIMIT 50""")
def top_hits(spark, sf_dir):
    h = report.top_hits(trade.study(spark, sf_dir).withColumn("P", F.col("P") / 1e6), ["run", "predictor"])
    return h.select("run", "predictor", F.round(-F.log10("P"), 6).alias("mlogp"))


# ---- whole results


@query()
def association_results(spark, sf_dir):
    """The tabular run as a result table with all its columns."""
    scan, facts = tabular(spark, sf_dir)
    rows = scan.join(facts, ["strata", "predictor"]).withColumns({"model_type": F.lit("linear"), "test": F.lit("wald"), "n_subjects": F.col("N"), "missing_rate": 1 - F.col("n_obs") / F.col("N")})
    return results.conform(scans.thresholds(scans.without_failures(rows), ["strata"]))


# ---- the same scans from packed dosages


def packed(spark, sf_dir) -> tuple[DataFrame, genotypes.Packed, DataFrame]:
    """(subjects, packed dosages, variants with their predictor)."""
    s = written(people(spark, sf_dir), "people")
    samples = genotypes.numbered(written(s.select("IID").withColumn("_at", F.monotonically_increasing_id()), "samples"), "sample_idx")
    d = trade.dosages(spark, sf_dir, s)
    variants = d.select("predictor").distinct().withColumn("variant_idx", F.xxhash64("predictor"))
    rows = genotypes.packed(d.join(variants, "predictor").select("variant_idx", "IID", F.col("value").alias("dosage")), samples)
    return s, genotypes.Packed(written(rows, "packed"), samples), variants


@query(f"WITH {S}, {D}, {linear_sql('cells', repr('ALL'))} {OUT}")
def packed_linear_scan(spark, sf_dir):
    s, values, variants = packed(spark, sf_dir)
    null = scans.linear_null(s.select("strata", "IID", "y", "acctbal"), "y", ["acctbal"])
    return shown(scans.linear_scan(values, null, 1, ["IID"], ["variant_idx"]).join(variants, "variant_idx"))


@query(SQL["packed_linear_scan"])
def binary_dosage_scan(spark, sf_dir):
    """The same scan from binary files: packed dosages are written by tasks in the binary format and read by its source."""
    s, values, variants = packed(spark, sf_dir)
    number = genotypes.numbered(values.rows.select("variant_idx").withColumn("_at", F.monotonically_increasing_id()), "_k")
    folder = f"{shared_dir(spark)}/binary-{uuid.uuid4().hex}"
    renamed = values.rows.join(number, "variant_idx").select(F.col("_k").alias("variant_idx"), "dosage")
    binary.write_dosages(renamed, folder, values.samples.count(), per_file=8)
    rows = binary.read_dosages(spark, folder, step=4)
    null = scans.linear_null(s.select("strata", "IID", "y", "acctbal"), "y", ["acctbal"])
    out = scans.linear_scan(genotypes.Packed(rows, values.samples), null, 1, ["IID"], ["variant_idx"])
    return shown(out.withColumnRenamed("variant_idx", "_k").join(number, "_k").join(variants, "variant_idx"))


@query(SQL["logistic_score"])
def packed_logistic_scan(spark, sf_dir):
    s, values, variants = packed(spark, sf_dir)
    null, _ = nulls.logistic_null(s.select("strata", "IID", "big"), "big", [])
    out = scans.logistic_scan(values, null, 1, ["IID"], ["variant_idx"]).join(variants, "variant_idx")
    return rounded(out.select("predictor", "beta", "SE", "chi2"), 5)


@query(COX)
def packed_cox_scan(spark, sf_dir):
    _, values, variants = packed(spark, sf_dir)
    null, _ = nulls.cox_null(survival(spark, sf_dir), "days", "event", [])
    lin = scans.linear_null(null.select("strata", "IID", F.col("_m").alias("m")), "m", [])
    out = scans.linear_scan(values, lin, 0, ["IID"], ["variant_idx"]).join(variants, "variant_idx")
    return rounded(out.select("predictor", "N", "beta", "SE"))


@query(SLOPES)
def packed_slope_scan(spark, sf_dir):
    _, values, variants = packed(spark, sf_dir)
    slopes = design.subject_slopes(trade.visits(spark, sf_dir), "IID", "price", "years").where("sxx > 0.01").withColumn("strata", F.lit("ALL"))
    null = scans.linear_null(slopes.select("strata", "IID", "slope"), "slope", [])
    out = scans.linear_scan(values, null, 0, ["IID"], ["variant_idx"]).join(variants, "variant_idx")
    return out.select("predictor", "N", F.round("beta", 4).alias("beta"), F.round("SE", 4).alias("SE"))
