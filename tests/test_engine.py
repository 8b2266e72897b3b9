"""The association engine on small tables: hand-computed values, invariants, planted effects."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import expressions, special
from loomstat.operators import design, meta, nulls, report, scans, tails
from loomstat.operators.running import ranged, running
from loomstat.plans import queries, runner, trade
from loomstat.sources import clinical, config, genotypes, results


def test_tails_of_distributions():
    assert special.norm_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert special.norm_sf(30.0) == pytest.approx(4.906713927148187e-198, rel=1e-10)
    assert special.norm_isf([0.025, 0.5, 1e-300, 0.975]) == pytest.approx([1.959963984540054, 0, 37.0471, -1.959963984540054], rel=1e-5, abs=1e-9)
    assert special.t_two_sided([2.2281388519649385, 12.706204736432095], [10, 1]) == pytest.approx([0.05, 0.05], rel=1e-10)
    assert special.t_two_sided(40.0, 200.0) < 1e-90
    assert special.chi2_sf([3.841458820694124, 5.991464547107979, 7.814727903251179], [1, 2, 3]) == pytest.approx([0.05] * 3, rel=1e-10)
    assert special.chi2_sf([0.0, 300.0], [2, 2]) == pytest.approx([1, math.exp(-150)], rel=1e-10)
    assert special.chi2_1_isf(0.5) == pytest.approx(special.CHI2_MEDIAN, rel=1e-9)
    assert np.isnan(special.t_two_sided(1.0, 0.0)) and np.isnan(special.chi2_sf(-1.0, 1.0))


def test_expressions(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, None), (3, -1.0, "b")], "k int, x double, s string")
    keep = lambda e: [r["k"] for r in design.filtered(df, e).orderBy("k").collect()]
    assert keep("x > 0") == [1] and keep("x != 2") == [2, 3] and keep("s != 'a'") == [2, 3] and keep("not x > 0") == [2, 3]
    assert keep("s in ['a', 'b'] and k < 3") == [1] and keep("s not in ['a']") == [2, 3] and keep("1 <= k <= 2") == [1, 2] and keep("x.isnull()") == [2]
    got = df.select(expressions.column("log(x)", df), expressions.column("minimum(x, k)", df), expressions.column("k / 0", df)).collect()
    assert got[2][0] is None and got[1][1] is None and got[0][1] == 1 and got[0][2] is None
    for bad in ("__import__('os')", "x.real", "lambda: 1", "nope + 1", "log(x, 2)", "x ="):
        with pytest.raises(expressions.ExpressionError):
            expressions.column(bad, df)


def test_derived(spark):
    rows = [(1, "a", 0.0, 1.0), (2, "a", 2.0, 5.0), (3, "a", None, 9.0), (4, "b", 1.0, None), (5, "b", 2.0, 3.0), (6, "c", 1.0, 7.0), (7, None, 1.0, 1.0), (8, "d", 1.0, 1.0), (9, "d", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "_row long, IID string, t double, y double")
    got = {r["_row"]: r for r in design.all_derived(df, {"b": "baseline_of(y)", "d": "delta(y)", "s": "slope_of(y ~ t)", "z": "b + 1"}, time_column="t").collect()}
    assert got[3]["b"] == 1 and got[4]["b"] is None and got[7]["b"] is None and got[6]["z"] == 8
    assert got[1]["d"] == 8 and got[5]["d"] is None and got[6]["d"] is None
    assert got[1]["s"] == pytest.approx(2) and got[5]["s"] is None and got[8]["s"] is None
    with pytest.raises(expressions.ExpressionError):
        design.derived(df, "s", "slope_of(y)")


def test_design_rules(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "x", 2.0), (2, "a", 9.0, "x", 2.0), (3, "b", None, "y", 2.0), (4, None, 1.0, "y", 2.0), (5, "c", 3.0, "y", float("nan"))], "_row long, IID string, y double, g string, w double")
    assert [r["y"] for r in design.complete(df, "IID", ["y"]).orderBy("IID").collect()] == [1.0, 3.0]
    assert design.complete(df, "IID", ["y", "w"]).count() == 1
    with pytest.raises(ValueError):
        design.stratified(df, None, ["x"])
    with pytest.raises(ValueError):
        design.require_numeric(df, ["g"])
    assert design.predictor_columns(df, {"prefix": "y"}) == ["y"] and design.predictor_columns(df, {"regex": "^[yw]$"}) == ["y", "w"]
    with pytest.raises(ValueError):
        design.predictor_columns(df, {"suffix": "zz"})
    kinds = spark.createDataFrame([(c, v) for c, vs in {"b": [0, 1, None], "d": [0, 1, 2], "o": [0.5, 1], "n": [None]}.items() for v in vs for v in [None if v is None else float(v)]], "predictor string, value double")
    assert {r["predictor"]: r["kind"] for r in design.kinds(kinds, ["predictor"]).collect()} == {"b": "binary", "d": "dosage", "o": "other", "n": "other"}


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.integers(0, 50)), k, 1.0) for g in "ab" for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, k int, one double")
    for down in (False, True):
        order = [F.desc("x") if down else F.asc("x"), "k"]
        got = running(df, ["g"], order, {"one": "rank"}).collect()
        for g in "ab":
            mine = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["x"] if down else r["x"], r["k"]))
            assert [r["rank"] for r in mine] == list(range(1, 701))


def test_running_sums_both_ways_over_one_cut(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.integers(0, 400)), k, int(rng.integers(0, 9))) for g in ("a", None) for k in range(900)]
    df = ranged(spark.createDataFrame(rows, "g string, x double, k int, v long"), ["g"], ["x", "k"], rows=100)
    assert df.select("_range").distinct().count() > 10
    up = running(df, ["g"], ["x", "k"], {"v": "s"}).collect()
    down = running(df, ["g"], [F.desc("x"), F.desc("k")], {"v": "s"}, backwards=True).collect()
    for g in ("a", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        total = np.cumsum([r[3] for r in mine])
        assert [r["s"] for r in sorted((r for r in up if r["g"] == g), key=lambda r: (r["x"], r["k"]))] == total.tolist()
        back = [r["s"] for r in sorted((r for r in down if r["g"] == g), key=lambda r: (r["x"], r["k"]))]
        assert back == (total[-1] - total + [r[3] for r in mine]).tolist()


def test_running_splits_ties(spark):
    """A million equal values of one group, a third of the rows equal in all columns: no range is far above its size."""
    third = F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("v"), "id"))
    df = spark.range(1_000_000).select(F.lit("run").alias("g"), F.lit(0.5).alias("p"), third.alias("predictor"), F.lit(1).cast("long").alias("one"))
    cut = ranged(df, ["g"], ["p", "predictor"], rows=50_000)
    largest = cut.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest <= 100_000
    ranks = running(cut, ["g"], ["p", "predictor"], {"one": "rank"})
    got = ranks.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(got) == (1, 1_000_000, 1_000_000)
    same = ranks.where("predictor = 'same'").agg(F.min("rank"), F.max("rank"), F.count(F.lit(1))).first()
    assert same[1] - same[0] + 1 == same[2] and same[2] == 333_334


@pytest.fixture(scope="module")
def data():
    """300 subjects, 12 variants, planted effects."""
    rng = np.random.default_rng(8)
    n, m = 300, 12
    G = rng.binomial(2, rng.uniform(0.2, 0.5, m), (n, m)).astype(float)
    G[rng.random(G.shape) < 0.02] = np.nan
    age, pc = rng.normal(60, 8, n), rng.normal(size=n)
    clean = np.where(np.isnan(G), np.nanmean(G, 0), G)
    y = 2 + 0.05 * age + 1.2 * clean[:, 0] + rng.normal(size=n)
    case = (rng.random(n) < 1 / (1 + np.exp(-(-0.6 + 1.1 * clean[:, 1])))).astype(float)
    t = rng.exponential(5 * np.exp(-0.9 * clean[:, 2]))
    event = (t < 8).astype(float)
    return dict(n=n, m=m, G=G, clean=clean, age=age, pc=pc, y=y, case=case, t=np.round(np.minimum(t, 8), 1), event=event, rng=rng)


def frames(spark, data, extra=()):
    n, m = data["n"], data["m"]
    people = spark.createDataFrame([("ALL", f"s{i}", *(float(data[c][i]) for c in ("y", "age", "pc", "case", "t", "event"))) for i in range(n)], "strata string, IID string, y double, age double, pc double, case double, t double, event double")
    values = spark.createDataFrame([(f"s{i}", j, None if np.isnan(data["G"][i, j]) else float(data["G"][i, j])) for i in range(n) for j in range(m)], "IID string, predictor long, value double")
    return people, values


def ols(X, y):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    r = y - X @ b
    return b, np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (r @ r) / (len(y) - X.shape[1]))


def test_linear_scan_is_least_squares(spark, data):
    people, values = frames(spark, data)
    null = scans.linear_null(people, "y", ["age", "pc"])
    for r in scans.linear_scan(values, null, 2, ["IID"], ["predictor"]).collect():
        b, se = ols(np.column_stack([np.ones(data["n"]), data["age"], data["pc"], data["clean"][:, r["predictor"]]]), data["y"])
        assert (r["beta"], r["SE"]) == (pytest.approx(b[3], rel=1e-8), pytest.approx(se[3], rel=1e-8))
        assert r["P"] == pytest.approx(float(special.t_two_sided(b[3] / se[3], data["n"] - 4)), rel=1e-6)
    # a predictor that is a covariate can't be told apart from it
    same = people.select("IID", F.lit(99).cast("long").alias("predictor"), F.col("age").alias("value"))
    assert scans.linear_scan(same, null, 2, ["IID"], ["predictor"]).first()["beta"] is None


def test_logistic_scan_and_tails(spark, data):
    people, values = frames(spark, data)
    null, b = nulls.logistic_null(people, "case", ["age", "pc"])
    X, y = np.column_stack([np.ones(data["n"]), data["age"], data["pc"]]), data["case"]
    p = 1 / (1 + np.exp(-X @ b["ALL"]))
    assert np.abs(X.T @ (y - p)).max() < 1e-6
    w = p * (1 - p)
    got = {r["predictor"]: r for r in scans.logistic_scan(values, null, 3, ["IID"], ["predictor"]).collect()}
    for j, r in got.items():
        g = data["clean"][:, j]
        V = g @ (w * g) - (g * w) @ X @ np.linalg.solve((X * w[:, None]).T @ X, X.T @ (w * g))
        assert r["V"] == pytest.approx(V, rel=1e-7) and r["beta"] == pytest.approx(g @ (y - p) / V, rel=1e-6)
        spa = tails.spa_logistic(g, p, X, float(g @ (y - p)))
        assert np.isnan(spa) or abs(math.log(spa / r["P"])) < 1.0
    assert got[1]["P"] < 1e-4
    bf, se = tails.firth(np.column_stack([np.repeat([0.0, 1.0], 20), np.ones(40)]), np.repeat([0.0, 1.0], 20))
    assert 5 < bf[0] < 10 and np.isfinite(se).all()  # separated, yet finite


def test_packed_scans_equal_long_ones(spark, data, monkeypatch):
    people, values = frames(spark, data)
    both = people.unionByName(people.where("IID > 's2'").withColumn("strata", F.lit("some")))
    n, m = data["n"], data["m"]
    iids = [f"s{i}" for i in range(n)]
    samples = spark.createDataFrame([*enumerate(iids), (n, "nobody")], "sample_idx long, IID string")
    rows = [(j, [-9.0 if np.isnan(x) else float(x) for x in data["G"][:, j]] + [1.0]) for j in range(m)]
    rows.append((m, [-9.0] * (n + 1)))
    packed = genotypes.Packed(spark.createDataFrame(rows, "variant_idx long, dosage array<float>"), samples)
    null, _ = nulls.logistic_null(both, "case", ["age", "pc"])
    expected = {(r["strata"], r["predictor"]): r for r in scans.logistic_scan(values, null, 3, ["IID"], ["predictor"]).collect()}
    for sent in (scans.SENT, 0):
        monkeypatch.setattr(scans, "SENT", sent)
        monkeypatch.setattr(scans, "BLOCK", 64)
        monkeypatch.setattr(scans, "GROUP", 2)
        got = {(r["strata"], r["variant_idx"]): r for r in scans.logistic_scan(packed, null, 3, ["IID"], ["variant_idx"]).collect()}
        assert set(got) == {(s, j) for s, j in expected}
        for key, r in got.items():
            for c in ("N", "n_obs", "mu", "predictor_sd", "beta", "SE", "P"):
                assert r[c] == pytest.approx(expected[key][c], rel=1e-5), (key, c)


def test_cox(spark, data):
    people, values = frames(spark, data)
    null, b = nulls.cox_null(people, "t", "event", ["age"])
    fit, _ = tails.cox_fit(data["age"][:, None], data["t"], data["event"], 0.0)
    assert b["ALL"][0] == pytest.approx(fit[0], rel=1e-5, abs=1e-7)
    assert null.agg(F.sum("_m")).first()[0] == pytest.approx(0, abs=1e-6)
    got = tails.cox_tiers(np.column_stack([data["clean"][:, 2], data["age"]]), data["t"], data["event"])
    assert got[2] == "cox" and abs(got[0] - 0.9) < 4 * got[1]
    m = np.array([r["_m"] for r in null.collect()])
    mean, law = tails.Empirical.of(null, "_m")["ALL"]
    assert mean == pytest.approx(m.mean(), abs=1e-12)
    for s in (-30.0, -0.015, 1.5):  # points of the grid
        e = np.exp(s * (m - mean) - (top := (s * (m - mean)).max()))
        assert law.k0[round((s + 30) / 0.015)] == pytest.approx(math.log(e.mean()) + top) and law.k1[round((s + 30) / 0.015)] == pytest.approx((e * (m - mean)).sum() / e.sum())
    rng = np.random.default_rng(0)
    g = rng.normal(size=len(m))
    score = 2.5 * np.sqrt((g * g).sum() * m.var())
    assert 0.003 < law.p(g - g.mean(), float(score)) < 0.05


def test_mixed_model_and_gallop(spark):
    rng = np.random.default_rng(3)
    n = 200
    g = rng.binomial(2, 0.3, n).astype(float)
    rows, X, Z = [], [], []
    for i in range(n):
        b = rng.multivariate_normal([0, 0], [[1, 0.2], [0.2, 0.3]])
        age = rng.normal()
        for t in np.sort(rng.uniform(0, 4, rng.integers(2, 6))):
            y = 1 + 0.5 * age + 0.3 * t + 0.4 * g[i] + 0.25 * g[i] * t + b[0] + b[1] * t + rng.normal() * 0.7
            rows.append(("ALL", f"s{i}", float(t), float(age), float(y)))
    visits = spark.createDataFrame(rows, "strata string, IID string, t double, age double, y double")
    products = nulls.subject_products(visits, "y", "t", ["age"], ["strata", "IID"]).persist()
    fits = nulls.fit_mixed(products, 3, rounds=40)
    f = fits["ALL"]
    assert abs(f.D[0, 0] - 1) < 0.5 and abs(f.sigma2 - 0.49) < 0.1 and abs(f.alpha[1] - 0.5) < 0.4
    null = nulls.gallop_null(products, fits, 3)
    values = spark.createDataFrame([(f"s{i}", 1, float(g[i])) for i in range(n)], "IID string, predictor long, value double")
    r = scans.gallop_scan(values, null, {"ALL": f.a_inverse}, ["IID"], ["predictor"]).first()
    A, u = np.zeros((5, 5)), np.zeros(5)
    for i in range(n):
        mine = [x for x in rows if x[1] == f"s{i}"]
        t, y = np.array([x[2] for x in mine]), np.array([x[4] for x in mine])
        Z = np.column_stack([np.ones(len(t)), t])
        V = np.linalg.inv(f.sigma2 * np.eye(len(t)) + Z @ f.D @ Z.T)
        X = np.column_stack([np.ones(len(t)), [x[3] for x in mine], t, np.full(len(t), g[i]), g[i] * t])
        A, u = A + X.T @ V @ X, u + X.T @ V @ y
    b, se = np.linalg.solve(A, u), np.sqrt(np.diag(np.linalg.inv(A)))
    assert (r["beta_SNP"], r["beta_SNPxTIME"]) == (pytest.approx(b[3], rel=1e-6), pytest.approx(b[4], rel=1e-6))
    assert (r["SE_SNP"], r["SE_SNPxTIME"]) == (pytest.approx(se[3], rel=1e-6), pytest.approx(se[4], rel=1e-6))


def test_mixed_model_against_em(spark):
    """The components are those that plain EM, subject by subject and in many rounds, comes to; also near a zero slope variance."""
    rng = np.random.default_rng(5)
    rows = []
    for s, slope in (("a", 0.4), ("b", 0.0)):
        for i in range(60):
            b0, b1 = rng.normal(), rng.normal() * slope
            rows += [(s, f"s{i}", float(t), 2 + b0 + (0.3 + b1) * t + rng.normal() * 0.5) for t in range(rng.integers(2, 7))]
    visits = spark.createDataFrame(rows, "strata string, IID string, t double, y double")
    fits = nulls.fit_mixed(nulls.subject_products(visits, "y", "t", [], ["strata", "IID"]).persist(), 2)

    def likelihood(mine, D, s2):
        A, b, c = np.zeros((2, 2)), np.zeros(2), 0.0
        for t, y in mine:
            Z = np.column_stack([np.ones(len(t)), t])
            V = s2 * np.eye(len(t)) + Z @ D @ Z.T
            W = np.linalg.inv(V)
            A, b, c = A + Z.T @ W @ Z, b + Z.T @ W @ y, c + y @ W @ y + np.linalg.slogdet(V)[1]
        return -(c - b @ np.linalg.solve(A, b)) / 2

    for s, f in fits.items():
        by = {}
        for k, i, t, y in rows:
            if k == s:
                by.setdefault(i, []).append((t, y))
        mine = [tuple(np.array(x) for x in zip(*v, strict=True)) for v in by.values()]
        D, s2 = np.eye(2) * 0.5, 0.5
        for _ in range(1500 if s == "a" else 300):
            A, b, parts = np.zeros((2, 2)), np.zeros(2), []
            for t, y in mine:
                Z = np.column_stack([np.ones(len(t)), t])
                W = np.linalg.inv(s2 * np.eye(len(t)) + Z @ D @ Z.T)
                A, b = A + Z.T @ W @ Z, b + Z.T @ W @ y
                parts.append((Z, W, y))
            a = np.linalg.solve(A, b)
            w = [Z.T @ W @ (y - Z @ a) for Z, W, y in parts]
            D = (D + D.T) / 2
            d = sum(np.outer(x, x) - Z.T @ W @ Z for x, (Z, W, _) in zip(w, parts, strict=True))
            e = sum(((y - Z @ a) @ W @ W @ (y - Z @ a)) - np.trace(W) for Z, W, y in parts)
            D, s2 = D + D @ (d + d.T) @ D.T / 2 / len(mine), s2 + s2 * s2 * e / sum(len(y) for *_, y in parts)
        assert f.converged and f.rounds < 60
        assert likelihood(mine, f.D, f.sigma2) >= likelihood(mine, D, s2) - 1e-4
        if s == "a":
            assert np.allclose(f.D, D, atol=2e-3) and abs(f.sigma2 - s2) < 2e-3 and np.allclose(f.alpha, a, atol=1e-3)


def test_meta(spark):
    rows = [("v1", "A", "A", "G", 0.3, 1.0, 0.5, 0.04, 100), ("v1", "B", "G", "A", 0.7, -2.0, 0.5, 0.001, 100), ("v1", "C", "A", "G", 0.3, 0.0, 1.0, 1.0, 50), ("v2", "B", "A", "T", 0.5, 1.0, 0.5, 0.04, 10),
            ("v3", "A", "A", "G", 0.1, None, 0.5, None, 10), ("v3", "B", "A", "G", 0.1, 1.0, 0.0, None, 10), ("v4", "A", "A", "G", 0.42, 1.0, 1.0, 0.3, 5), ("v4", "B", "C", "G", 0.42, 1.0, 1.0, 0.3, 5)]
    df = spark.createDataFrame(rows, "predictor string, stratum string, effect_allele string, other_allele string, EAF double, beta double, SE double, P double, N long")
    got = {r["predictor"]: r for r in meta.meta_analysis(df).collect()}
    v = got["v1"]
    w, b = np.array([4, 4, 1.0]), np.array([1, 2, 0.0])
    fe = (w * b).sum() / w.sum()
    q = (w * (b - fe) ** 2).sum()
    tau2 = max(0, (q - 2) / (w.sum() - (w**2).sum() / w.sum()))
    wr = 1 / (1 / w + tau2)
    assert v["beta_FE"] == pytest.approx(fe) and v["Q"] == pytest.approx(q) and v["tau2"] == pytest.approx(tau2)
    assert v["beta_RE"] == pytest.approx((wr * b).sum() / wr.sum()) and v["direction"] == "++0" and v["N_total"] == 250
    assert v["P_het"] == pytest.approx(math.exp(-q / 2)) and v["beta_B"] == 2.0 and v["EAF_B"] == pytest.approx(0.3)
    one = got["v2"]
    assert one["beta_RE"] == one["beta_FE"] == 1 and one["Q"] is None and one["palindromic"] and one["strand_flag"] and one["P_FE"] == pytest.approx(0.04550026389635842)
    assert got["v3"]["n_studies"] == 0 and got["v3"]["beta_FE"] is None and not got["v3"]["significant_FE"]
    assert got["v4"]["allele_mismatch"] and got["v4"]["strand_flag"]


def test_calibration_and_failures(spark):
    p = [(f"v{i}", (i + 0.5) / 1000, 0.1, 1.0) for i in range(1000)]
    df = spark.createDataFrame([*p, ("zero", 0.0, 1.0, 1.0), ("none", None, 1.0, 1.0), ("se", 0.5, 1.0, 0.0)], "predictor string, P double, beta double, SE double").withColumn("strata", F.lit("ALL"))
    assert report.lambda_gc(df.where("P > 0"), ["strata"]).first()["lambda"] == pytest.approx(1, abs=0.01)
    kept = scans.thresholds(scans.without_failures(df), ["strata"])
    assert kept.count() == 1000 and kept.first()["bonferroni_threshold"] == pytest.approx(0.00005)
    assert report.lambda_gc(df.limit(0), ["strata"]).count() == 0
    q = report.qq(df, ["strata"]).orderBy("rank").first()
    assert q["rank"] == 1 and q["expected"] == pytest.approx(-math.log10(0.5 / 1001))


def test_discovery_and_config(spark, tmp_path):
    for name in ("a-b-EUR-20260101_000000.csv", "a-b-EUR-20260201_000000.csv", "a-b-ALL-20260101_000000.csv", "META_a-b-20260101_000000.csv", "other.csv"):
        (tmp_path / name).write_text("x")
    found = results.discover(spark, str(tmp_path))
    assert set(found) == {("a-b", "EUR"), ("a-b", "ALL")} and "20260201" in found[("a-b", "EUR")]
    assert list(results.discover(spark, str(tmp_path), meta=True)) == [("a-b",)]
    c = config.parse({"defaults": {"covariates": ["a", "b"]}, "runs": [{"name": "r", "outcome": "y", "add_covariates": ["c", "a"], "drop_covariates": ["b"]}]})
    assert c.runs[0].covariates == ["a", "c"] and c.runs[0].get("min_n") == 30 and c.runs[0].strata == [None]
    for bad in ({}, {"runs": 1}, {"runs": [{"model": "nope"}]}, {"runs": [{"strata": ["x"]}]}):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_a_whole_configuration(spark, data, tmp_path):
    n, m, rng = data["n"], data["m"], np.random.default_rng(1)
    iids = [f"{i:04d}" for i in range(n)]
    lines = ["\t".join(["IID", "ancestry", "visit", "years", "AGE", "y", "case", "tte", "event", "traj", "PRT1_NPX", "flag"])]
    for i in range(n):
        for v in range(3):
            traj = 1 + 0.5 * v + 0.6 * data["clean"][i, 3] * v + rng.normal()
            cell = "NA" if i == 5 else f"{data['y'][i] * 2 + rng.normal():.6g}"
            lines.append("\t".join([iids[i], "EUR" if i % 3 else "AJ", f"V{v}", f"{v + 0.1 * (i % 3):.3f}", f"{data['age'][i]:.5g}", f"{data['y'][i]:.6g}", str(int(data["case"][i])), f"{data['t'][i]:.4g}", str(int(data["event"][i])), f"{traj:.6g}", cell, str(i % 2)]))
    (tmp_path / "clinical_1.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "geno.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"{1 + j % 3}\t{100 * (j + 1)}\trs{j}\tA\tG\n" for j in range(m)))
    (tmp_path / "geno.psam").write_text("#IID\tSEX\n" + "".join(f"{i}\t1\n" for i in iids))
    packed = [(j, [-9.0 if np.isnan(x) else float(x) for x in data["G"][:, j]]) for j in range(m)]
    spark.createDataFrame(packed, "variant_idx long, dosage array<float>").write.parquet(str(tmp_path / "geno.dosage.parquet"))
    raw = {
        "defaults": {"genotype_prefix": "geno", "time_col": "years", "covariates": ["AGE"], "derive": {"y_bl": "baseline_of(y)", "rs0_col": "snp(rs0)"}, "prefilter": ["AGE > 0"]},
        "runs": [
            {"name": "lin", "outcome": "y_bl", "strata_col": "ancestry", "strata": ["EUR", "AJ"]},
            {"name": "cond", "outcome": "y_bl", "condition_snps": ["rs0", "absent"]},
            {"name": "logi", "model": "logistic", "outcome": "case"},
            {"name": "cox", "model": "cox", "duration_col": "tte", "event_col": "event"},
            {"name": "slope", "model": "slope", "outcome": "traj"},
            {"name": "tab", "predictor_source": "tabular", "outcome": "y", "predictors": {"suffix": "_NPX"}},
            {"name": "tablog", "predictor_source": "tabular", "model": "logistic", "outcome": "case", "predictors": ["flag", "PRT1_NPX"]},
            {"name": "tabcox", "predictor_source": "tabular", "model": "cox", "duration_col": "tte", "event_col": "event", "predictors": ["flag"]},
        ],
    }
    got = runner.run_all(spark, config.parse(raw), str(tmp_path))
    assert set(got) == {"lin", "cond", "logi", "cox", "slope", "tab", "tablog"}
    assert all(df.columns == results.RESULT_COLUMNS for df in got.values())
    best = lambda name, **w: min((r for r in got[name].collect() if all(r[k] == v for k, v in w.items())), key=lambda r: r["P"])
    assert best("lin", strata="EUR")["predictor"] == "rs0" and best("lin", strata="EUR")["genomewide_sig"]
    cond = {r["predictor"]: r for r in got["cond"].collect()}
    assert "rs0" not in cond and cond["rs1"]["conditioned_on"] == "rs0,absent" and cond["rs1"]["N"] == n
    assert best("logi")["predictor"] == "rs1" and best("cox")["predictor"] == "rs2" and best("slope")["predictor"] == "rs3"
    assert {r["test"] for r in got["logi"].collect()} <= {"score", "spa", "firth"} and best("cox")["n_events"] == int(data["event"].sum())
    tab = got["tab"].first()
    assert (tab["predictor"], tab["zscored"], tab["N"], tab["n_obs"]) == ("PRT1_NPX", True, n, n - 1) and tab["significant"]
    assert {r["predictor"]: r["zscored"] for r in got["tablog"].collect()} == {"flag": False, "PRT1_NPX": True}
    folder = str(tmp_path / "results")
    metas = runner.meta_all(spark, folder, str(tmp_path / "meta"), ["lin"])
    assert metas["lin"].where("predictor = 'rs0'").first()["n_studies"] == 2 and os.listdir(tmp_path / "meta")
    combined = results.read_meta(spark, results.discover(spark, str(tmp_path / "meta"), meta=True))
    text = report.summary(results.read_results(spark, results.discover(spark, folder)), combined)
    assert "## Coverage" in text and "rs0" in text and all(f"| lin | {s} |" in text for s in ("EUR", "AJ", "FE", "RE"))
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    paths = [p for (run, _), p in results.discover(spark, folder).items() if run == "lin"]
    again = runner.meta_explicit(spark, [*paths, str(tmp_path / "odd.csv")], str(tmp_path / "own.csv"))
    assert again.where("predictor = 'rs0'").first()["n_studies"] == 2 and (tmp_path / "own.csv").exists()


def test_repeated_ids_and_statistics(spark):
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "variant_idx long, ID string")
    assert [r["variant_idx"] for r in genotypes.by_id(v, ["a", "zz"]).collect()] == [2]
    d = spark.createDataFrame([(0, 2.0), (0, 2.0), (0, None), (1, 0.0), (1, 0.0), (1, 0.0)], "variant_idx long, dosage double")
    s = {r["variant_idx"]: r for r in genotypes.statistics(d, 3).collect()}
    assert (s[0]["EAF"], s[0]["MAF"], s[0]["n_obs"]) == (1.0, 0.0, 2) and s[0]["missing_rate"] == pytest.approx(1 / 3)
    assert genotypes.passing(genotypes.statistics(d, 3)).count() == 0


def test_clinical_types(spark, tmp_path):
    (tmp_path / "x_1.tsv").write_text("IID\ta\tb\n001\t1\tNA\n002\tNaN\tt\n")
    (tmp_path / "x_2.tsv").write_text("IID\ta\tb\n001\t1\t1.5\n002\tNaN\t2\n")
    path = clinical.latest(spark, "x_*.tsv", str(tmp_path))
    assert path.endswith("x_2.tsv")
    df = clinical.read_clinical(spark, path)
    assert dict(df.dtypes) | {"_row": ""} == {"IID": "string", "a": "bigint", "b": "double", "_row": ""}
    assert [r["IID"] for r in df.orderBy("_row").collect()] == ["001", "002"]
    with pytest.raises(FileNotFoundError):
        clinical.latest(spark, "none*", str(tmp_path))


def test_every_query_is_named_after_its_operator():
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) >= 45


@pytest.mark.parametrize("name", ["gallop_scan", "trajgwas_scan"])
def test_mixed_queries_use_all_rounds_and_say_if_unconverged(spark, monkeypatch, name):
    fit, asked = nulls.fit_mixed, []

    def short(products, p, **more):
        asked.append(more)
        return fit(products, p, rounds=1)

    monkeypatch.setattr(nulls, "fit_mixed", short)
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [{}]
    assert out.select("converged").distinct().collect() == [(False,)]


def tail_cells_table(spark, n=400):
    """Two predictors of two strata, one of them with missing values, against an outcome, a time with ties and a covariate."""
    rng = np.random.default_rng(4)
    rows = []
    for s in ("a", "b"):
        x, g = rng.normal(size=n), rng.integers(0, 3, (2, n)).astype(float)
        y = (rng.random(n) < 1 / (1 + np.exp(1 - g[0] - x / 2))).astype(float)
        t = np.ceil(rng.exponential(20 / (1 + g[0])))
        rows += [(s, f"{s}{i}", f"v{k}", None if k and i % 9 == 0 else float(g[k, i]), float(x[i]), float(y[i]), float(t[i])) for k in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "strata string, IID string, predictor string, value double, x double, y double, t double")
    return df.select("strata", "predictor").distinct(), df.select("IID", "predictor", "value"), df.select("strata", "IID", "x", "y", "t").distinct()


def test_refits_by_sums_are_those_in_memory(spark):
    """Firth, saddlepoint and Cox by distributed sums against the fits that see all subjects."""
    from pyspark.sql import functions as F

    from loomstat.operators import refits

    rows, values, people = tail_cells_table(spark)
    met = refits.cells(rows, values, people)
    plain = {k: g for k, g in met.toPandas().groupby(["strata", "predictor"])}
    assert len(plain) == 4 and all(g["g"].notna().all() for g in plain.values())
    got = {(r["strata"], r["predictor"]): r for r in refits.firth(met, "y", [F.lit(1.0), F.col("x")]).collect()}
    cox = {(r["strata"], r["predictor"]): r for r in refits.cox(met, "t", "y", ["x"]).collect()}
    p = 0.2 + 0.3 * F.col("y") + 0.1 * (F.col("x") > 0).cast("double")
    score = F.col("g") * (F.col("y") - p)
    spa = {(r["strata"], r["predictor"]): r["spa"] for r in refits.saddlepoint(met, score / 8, p * (1 - p), [F.lit(1.0), F.col("x")], refits.bernoulli(p)).collect()}
    for k, g in plain.items():
        X = np.column_stack([g["g"], np.ones(len(g)), g["x"]])
        b, se = tails.firth(X, g["y"].to_numpy())
        assert np.allclose([got[k]["beta"], got[k]["SE"]], [b[0], se[0]], rtol=1e-6)
        beta, se, model = tails.cox_tiers(X[:, [0, 2]], g["t"].to_numpy(), g["y"].to_numpy())
        assert cox[k]["model_type"] == model and np.allclose([cox[k]["beta"], cox[k]["SE"]], [beta, se], rtol=1e-6)
        q = (0.2 + 0.3 * g["y"] + 0.1 * (g["x"] > 0)).to_numpy()
        s = float(g["g"] @ (g["y"] - q)) / 8
        want = tails.logistic_ps(X[:, 0][None], q, X[:, 1:], np.array([s]))[0]
        assert np.allclose(spa[k], want, rtol=1e-6, equal_nan=True)


def test_cox_refit_of_what_has_no_fit(spark):
    """A constant predictor, and a stratum without events, have no fit in any tier."""
    from loomstat.operators import refits

    rows = [("a", "const", 1.0, float(i % 7), float(i + 1), float(i % 2)) for i in range(40)] + [("b", "calm", float(i % 3), float(i % 5), float(i + 1), 0.0) for i in range(40)]
    met = spark.createDataFrame(rows, "strata string, predictor string, g double, x double, t double, y double")
    got = {r["predictor"]: r for r in refits.cox(met, "t", "y", ["x"]).collect()}
    assert got["const"]["model_type"] is None and set(got) == {"const", "calm"}
    g = met.where("predictor = 'calm'").toPandas()
    want = tails.cox_tiers(g[["g", "x"]].to_numpy(), g["t"].to_numpy(), g["y"].to_numpy())
    assert got["calm"]["model_type"] == (want and want[2])


def test_packed_products_in_pieces(spark, monkeypatch):
    """Sums over packed dosages are the same in pieces, and a task's arrays stay small however many subjects there are."""
    import pandas as pd

    rng = np.random.default_rng(8)
    n = 5000
    dosages = rng.integers(0, 3, (6, n)).astype(np.float32)
    dosages[rng.random(dosages.shape) < 0.05] = genotypes.MISSING_DOSAGE
    table = pd.DataFrame({"strata": np.where(np.arange(n) % 3, "a", "b"), "at": np.arange(n), "x": rng.normal(size=n), "w": rng.random(n)})
    columns = scans.by_stratum(table, ["x"], ["w"])
    whole = dict(scans.block_products(dosages, columns))
    monkeypatch.setattr(scans, "AT_ONCE", 600)
    largest = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(self)[at]
            largest.append(out.size)
            return out

    parts = dict(scans.block_products(dosages.view(Watched), columns))
    assert set(parts) == {"a", "b"} and all(np.allclose(parts[s], whole[s]) for s in parts)
    assert max(largest) <= 600


def test_values_by_subject_give_the_sums_of_rows(spark):
    """Scans over one array a subject: the statistics of one row a cell, with missing values and a subject in two strata."""
    rng = np.random.default_rng(11)
    n, names = 120, ["a", "b", "c"]
    cells = [[None if rng.random() < 0.1 or (v == 2 and i % 2) else float(rng.integers(0, 3)) for v in range(3)] for i in range(n)]
    values = genotypes.BySubject(
        spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(cells)], "IID string, values array<double>").repartition(5), spark.createDataFrame(list(enumerate(names)), "at int, predictor string")
    )
    assert sorted((r["IID"], r["predictor"], r["value"]) for r in values.long().where("value is not null").collect()) == sorted((f"s{i}", names[v], x) for i, c in enumerate(cells) for v, x in enumerate(c) if x is not None)
    rows = [(s, f"s{i}", float(rng.normal()), float(rng.normal()), float(rng.random()) if i else None) for s in ("x", "y") for i in range(n) if s == "x" or i % 3]
    people = spark.createDataFrame(rows, "strata string, IID string, u double, v double, w double")
    want, got = ({(r["strata"], r["predictor"]): r.asDict() for r in scans.imputed_sums(d, people, ["IID"], ["predictor"], ["u", "v"], ["w"]).collect()} for d in (values.long(), values))
    assert set(want) == set(got) and len(got) == 6
    for k, r in want.items():
        assert set(got[k]) == set(r) and all(got[k][c] == pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else got[k][c] == x for c, x in r.items()), k


def test_bought_lines_by_customer(spark):
    """Cells of the trade tables, counted by hand: at most 2 a brand, one in 37 missing, none for customers without lines of it."""
    sf = "/root/testdata/sf0.001"
    read = lambda name: trade.table(spark, sf, name).toPandas()
    lines = read("lineitem").merge(read("orders"), left_on="l_orderkey", right_on="o_orderkey").merge(read("part"), left_on="l_partkey", right_on="p_partkey")
    bought = lines.groupby(["o_custkey", "p_brand"]).size().to_dict()
    brands, ids = sorted(read("part")["p_brand"].unique()), sorted(read("orders")["o_custkey"].unique())
    want = {(str(i), b): None if (i * 31 + v) % 37 == 0 else min(2.0, float(bought.get((i, b), 0))) for i in ids for v, b in enumerate(brands)}
    got = trade.dosages(spark, sf, trade.subjects(spark, sf)).collect()
    assert len(got) == len(want) and {(r["IID"], r["predictor"]): r["value"] for r in got} == want


def test_trajgwas_reads_the_tables_once(spark):
    """What both axes share is written: the result reads neither lines nor orders again."""
    files = queries.QUERIES["trajgwas_scan"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any(t in f for f in files for t in ("lineitem", "orders", "customer"))


def test_linear_conditional_reads_the_tables_once(spark):
    """The covariate and the scan share written cells; one predictor's cells are those among all."""
    files = queries.QUERIES["linear_conditional"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any(t in f for f in files for t in ("lineitem", "orders", "customer"))
    d = trade.cells(spark, "/root/testdata/sf0.001", trade.subjects(spark, "/root/testdata/sf0.001"))
    one, all_ = (sorted(map(tuple, x.collect()), key=str) for x in (d.of("Brand#12"), d.long().where("predictor = 'Brand#12'")))
    assert one == all_ and len(one) > 50


def test_empirical_tails_by_subject_are_those_in_memory(spark, monkeypatch):
    """The saddlepoint under the residuals' law by sums over one array a subject, against the rows that see all subjects:
    missing values, subjects of one stratum only, one without values, a predictor that is not in the tail."""
    from loomstat.operators import refits

    rng = np.random.default_rng(5)
    n, names = 300, ["a", "b", "c", "d"]
    x, G = rng.normal(size=n), rng.binomial(2, 0.3, (4, n)).astype(float)
    G[rng.random(G.shape) < 0.05] = np.nan
    G[:, 7] = np.nan  # no row
    m = rng.exponential(size=n) ** 1.5 + 0.3 * np.nan_to_num(G[0]) - 0.2 * np.nan_to_num(G[3]) + 0.1 * x
    rows = [(f"s{i}", [None if np.isnan(g) else float(g) for g in G[:, i]]) for i in range(n) if i != 7]
    values = genotypes.BySubject(spark.createDataFrame(rows, "IID string, values array<double>").repartition(3), spark.createDataFrame(list(enumerate(names)), "at int, predictor string"))
    strata = {"x": np.arange(n), "y": np.arange(0, n, 2) + 1}
    people = spark.createDataFrame([(s, f"s{i}", float(m[i]), float(x[i])) for s, who in strata.items() for i in who], "strata string, IID string, m double, x double")
    tail = spark.createDataFrame([(s, v, 0.01) for s in strata for v in "adc" if (s, v) != ("y", "c")], "strata string, predictor string, P double")
    laws = tails.Empirical.of(people, "m")
    null = scans.linear_null(people, "m", ["x"])
    monkeypatch.setattr(refits, "AT_ONCE", 90)
    found = refits.empirical(tail, values, null, 1, laws)
    assert found.dtypes == [("strata", "string"), ("predictor", "string"), ("spa", "double")]
    got = {(r["strata"], r["predictor"]): r["spa"] for r in found.collect()}
    assert set(got) == {("x", "a"), ("x", "d"), ("x", "c"), ("y", "a"), ("y", "d")}
    for (s, v), p in got.items():
        who, g = strata[s], G[names.index(v)]
        g = np.where(np.isnan(g[who]), np.nanmean(g[who]), g[who])
        Q = np.linalg.qr(np.column_stack([np.ones(len(who)), x[who]]))[0]
        R, (mean, law) = g - Q @ (Q.T @ g), laws[s]
        want = law.p(R, float(R @ (m[who] - mean)))
        assert 0 < want < 1 and p == pytest.approx(want, rel=1e-7), (s, v)
    far = refits.empirical(tail.where("predictor = 'a'"), values, null.withColumn("_y", F.col("_y") * 1000), 1, laws)
    assert all(np.isnan(r["spa"]) for r in far.collect())  # no saddlepoint inside the bracket
    assert refits.empirical(tail.where("P > 1"), values, null, 1, laws).count() == 0


def test_spacox_has_no_group_of_all_subjects(spark):
    plan = queries.QUERIES["spacox"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Generate" not in plan
