"""More registered queries: steps of runs, meta-analysis and reports one by one, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design, meta, report, scans, tails, truth
from ..sources import genotypes
from . import trade
from .queries import QUERIES, SQL, STUDIES, D, S, T, V, combined, logistic, query, rounded, studies  # noqa: F401
from .stages import written

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def p_sql(z: str) -> str:
    """SQL for the two-sided P of a standard normal ``z``, by the series of the error function about zero."""
    x = f"greatest(abs({z}) / sqrt(2.0::DOUBLE), 1e-300)"
    term = f"exp(2 * n * ln(2.0::DOUBLE) + lgamma(n + 1.0::DOUBLE) - lgamma(2 * n + 2.0::DOUBLE) + (2 * n + 1) * ln({x}) - {x} * {x})"
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda n: {term})))"


@query(f"""WITH {S}, s AS (SELECT IID, segment AS strata FROM subj UNION ALL SELECT IID, 'ALL' FROM subj)
SELECT IID, strata FROM s QUALIFY count(*) OVER (PARTITION BY strata) >= 200""")
def large_strata(spark, sf_dir):
    s = design.stratified(trade.subjects(spark, sf_dir), "segment", [None, *SEGMENTS])
    return design.large_enough(s, 200).select("IID", "strata")


@query(f"WITH {T} SELECT run, stratum, predictor FROM study WHERE P < 0.01 OR least(\"EAF\", 1 - \"EAF\") <= 0.05")
def tail_rows(spark, sf_dir):
    return tails.tail(trade.study(spark, sf_dir).withColumn("MAF", F.least("EAF", 1 - F.col("EAF")))).select("run", "stratum", "predictor")


@query(f"""WITH {V}, b AS (SELECT *, first_value(price) OVER (PARTITION BY IID ORDER BY years, _row) AS bl FROM visits)
SELECT IID, _row, round(price - bl, 6) AS gain, round(ln(abs(price - bl) + 1), 6) AS scaled FROM b""")
def derive_chain(spark, sf_dir):
    """Derived columns that use derived columns."""
    v = design.all_derived(trade.visits(spark, sf_dir), {"bl": "baseline_of(price)", "gain": "price - bl", "scaled": "log(abs(gain) + 1)"}, time_column="years")
    return rounded(v.select("IID", "_row", "gain", "scaled"))


@query(f"""WITH {S} SELECT IID, 'mean_quantity' AS predictor, round(mean_quantity, 10) AS value FROM subj UNION ALL SELECT IID, 'mean_discount', round(mean_discount, 10) FROM subj
UNION ALL SELECT IID, 'mean_tax', round(mean_tax, 10) FROM subj""")
def pattern_predictors(spark, sf_dir):
    s = trade.subjects(spark, sf_dir)
    return rounded(design.unpivoted(s, ["IID"], design.predictor_columns(s, {"prefix": "mean_"})), 10)


@query(f"WITH {V} SELECT IID, round(arg_min(price, (years, _row)), 6) AS price, arg_min(priority, (years, _row)) AS priority FROM visits GROUP BY IID")
def baseline_values(spark, sf_dir):
    return rounded(design.baseline_values(trade.visits(spark, sf_dir), "IID", "years", ["price", "priority"]))


@query(f"WITH {V} SELECT IID, _row, round(price, 6) AS price FROM visits QUALIFY row_number() OVER (PARTITION BY IID ORDER BY years, _row) = 1")
def baseline_rows(spark, sf_dir):
    return rounded(design.baseline_rows(trade.visits(spark, sf_dir), "IID", "years").select("IID", "_row", "price"))


WIDE = ", ".join(f"round(max(b) FILTER (stratum = '{s}'), 3) AS \"beta_{s}\", max(n) FILTER (stratum = '{s}') AS \"N_{s}\", round(max(f) FILTER (stratum = '{s}'), 6) AS \"EAF_{s}\"" for s in SEGMENTS)


@query(f"{STUDIES} SELECT predictor, {WIDE} FROM hm GROUP BY 1")
def meta_by_stratum(spark, sf_dir):
    wide = meta.by_stratum(meta.harmonised(studies(spark, sf_dir)), SEGMENTS)
    columns = [(f"beta_{s}", 3) for s in SEGMENTS] + [(f"EAF_{s}", 6) for s in SEGMENTS]
    return wide.select("predictor", *(F.round(c, d).alias(c) for c, d in columns), *(f"N_{s}" for s in SEGMENTS))


@query(f"""{STUDIES}, p AS (SELECT predictor, {p_sql('bfe * sqrt(sw)')} AS pf, {p_sql('bre / sre')} AS pr FROM fe JOIN re USING (predictor))
SELECT predictor, round(pf, 6) AS "P_FE", round(pr, 6) AS "P_RE", pf < 0.05 / count(*) OVER () AS "significant_FE", pr < 0.05 / count(*) OVER () AS "significant_RE" FROM p""")
def meta_p(spark, sf_dir):
    return rounded(meta.with_p(combined(spark, sf_dir)).select("predictor", "P_FE", "P_RE", "significant_FE", "significant_RE"))


HITS = f"""WITH {T}, a AS (SELECT run, predictor, stratum AS source, P / 1e6 AS P FROM study
UNION ALL SELECT run, predictor, 'FE', P / 2e6 FROM study WHERE \"POS\" % 3 = 0)
SELECT run, predictor, arg_min(source, (P, source)) AS source, round(-log10(min(P)), 6) AS mlogp FROM a WHERE P < 5e-8 GROUP BY 1, 2 ORDER BY min(P), 1, 2 LIMIT 50"""


@query(HITS)
def united_hits(spark, sf_dir):
    """Hits of strata and of a combined table, which has a smaller P for every third position."""
    s = trade.study(spark, sf_dir)
    m = s.where("POS % 3 = 0").select("run", "predictor", F.col("beta").alias("beta_FE"), F.col("SE").alias("SE_FE"), (F.col("P") / 2e6).alias("P_FE"))
    return report.united_hits(s.withColumn("P", F.col("P") / 1e6), m).select("run", "predictor", "source", F.round(-F.log10("P"), 6).alias("mlogp"))


@query("SELECT o_orderkey, greatest(0.0::DOUBLE, least(2.0::DOUBLE, round(o_totalprice / 100000 * 16384) / 16384)) AS dosage FROM orders")
def dosage_grid(spark, sf_dir):
    o = trade.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", genotypes.quantised(F.col("o_totalprice") / 100_000).alias("dosage"))


@query("SELECT p_brand AS \"ID\", max(p_partkey) AS variant_idx FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'absent') GROUP BY 1")
def variants_by_id(spark, sf_dir):
    """Of repeated ids the last in order counts; unknown ones are left out."""
    v = trade.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_idx"), F.col("p_brand").alias("ID"))
    return genotypes.by_id(v, ["Brand#11", "Brand#22", "absent"]).select("ID", "variant_idx")


#: Newton steps of a logistic model with one covariate, twelve of them, then the score test of every predictor.
SCORE = f"""WITH RECURSIVE {S}, {D}, pt AS (SELECT IID, big AS y, acctbal / 1000 AS a FROM subj),
b(k, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, b0 + (saa * u0 - sa * u1) / (s * saa - sa * sa), b1 + (s * u1 - sa * u0) / (s * saa - sa * sa)
  FROM (SELECT k, b0, b1, sum(y - p) AS u0, sum((y - p) * a) AS u1, sum(p * (1 - p)) AS s, sum(p * (1 - p) * a) AS sa, sum(p * (1 - p) * a * a) AS saa
        FROM (SELECT k, b0, b1, y, a, 1 / (1 + exp(-(b0 + b1 * a))) AS p FROM b, pt WHERE k < 12) GROUP BY k, b0, b1)),
fit AS (SELECT IID, a, y - p AS r, p * (1 - p) AS w FROM (SELECT pt.*, 1 / (1 + exp(-(b0 + b1 * a))) AS p FROM pt, b WHERE k = 12)),
g AS (SELECT predictor, IID, value, coalesce(value, avg(value) OVER (PARTITION BY predictor)) AS g FROM cells),
t AS (SELECT predictor, count(*) AS n, count(value) AS n_obs, sum(g * r) AS u, sum(w * g * g) AS gg, sum(w * g) AS g1, sum(w * g * a) AS ga, sum(w) AS s, sum(w * a) AS sa, sum(w * a * a) AS saa FROM g JOIN fit USING (IID) GROUP BY 1),
v AS (SELECT *, gg - (saa * g1 * g1 - 2 * sa * g1 * ga + s * ga * ga) / (s * saa - sa * sa) AS v FROM t)
SELECT predictor, n AS "N", n_obs, round(u / v, 5) AS beta, round(1 / sqrt(v), 5) AS "SE", round(u * u / v, 5) AS chi2, round({p_sql('u / sqrt(v)')}, 5) AS "P" FROM v"""


@query(SCORE)
def logistic_score_covariates(spark, sf_dir):
    return rounded(logistic(spark, sf_dir, ["acct"])[0].select("predictor", "N", "n_obs", "beta", "SE", "chi2", "P"), 5)


@query(f"""WITH {S}, {D}, o AS (SELECT IID, any_value(y) / 1000 + 30 * coalesce(max(value) FILTER (predictor = 'Brand#11'), 0) - 20 * coalesce(max(value) FILTER (predictor = 'Brand#12'), 0) AS o FROM cells JOIN subj USING (IID) GROUP BY IID),
i AS (SELECT predictor, o, coalesce(value, avg(value) OVER (PARTITION BY predictor)) AS g FROM cells JOIN o USING (IID)),
c AS (SELECT predictor, count(*) AS n, regr_sxx(g, g) AS gg, regr_sxx(o, o) AS yy, regr_sxy(g, o) AS gy FROM i GROUP BY 1),
r AS (SELECT predictor, gy / gg AS beta, sqrt((yy - gy * gy / gg) / (n - 2) / gg) AS se FROM c)
SELECT 'planted' AS run, 2::BIGINT AS planted, count(*) FILTER (predictor IN ('Brand#11', 'Brand#12')) AS found,
count(*) FILTER (predictor = 'Brand#11' AND abs(beta - 30) <= 4 * se OR predictor = 'Brand#12' AND abs(beta + 20) <= 4 * se) AS covered, count(*) FILTER (predictor NOT IN ('Brand#11', 'Brand#12')) AS n FROM r""")
def truth_coverage(spark, sf_dir):
    """Two effects planted into the outcome: does the scan cover them within four standard errors?"""
    s = trade.subjects(spark, sf_dir).withColumn("strata", F.lit("ALL"))
    d = written(trade.dosages(spark, sf_dir, s), "dosages")
    effects = {"Brand#11": 30.0, "Brand#12": -20.0}
    own = d.groupBy("IID").agg(*(F.coalesce(F.max(F.when(F.col("predictor") == v, F.col("value"))), F.lit(0.0)).alias(f"_{k}") for k, v in enumerate(effects)))
    planted = sum((F.col(f"_{k}") * b for k, b in enumerate(effects.values())), F.col("y") / 1000)
    null = scans.linear_null(s.join(own, "IID").select("strata", "IID", planted.alias("o")), "o", [])
    scan = written(scans.linear_scan(d, null, 0, ["IID"], ["predictor"]), "scan").withColumn("run", F.lit("planted"))
    known = spark.createDataFrame([("planted", *e) for e in effects.items()], "run string, predictor string, true_effect double")
    return truth.truth_check(scan, known).select("run", "planted", "found", "covered", "n")
