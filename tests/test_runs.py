"""Longitudinal runs, tails on packed dosages, refits, and meta-analysis of repeated ids, through what the commands call."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import meta, nulls, tails
from loomstat.plans import runner
from loomstat.sources import binary, config, genotypes


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """300 subjects of two ancestries, 4 visits, 40 variants; one variant moves the slope, one the spread, one the level."""
    path, rng = tmp_path_factory.mktemp("study"), np.random.default_rng(11)
    n, m = 300, 40
    G = rng.binomial(2, rng.uniform(0.2, 0.5, m), (n, m)).astype(float)
    G[rng.random(G.shape) < 0.02] = -9
    clean = np.where(G < 0, 1.0, G)
    lines = ["\t".join(["IID", "ancestry", "visit", "years", "AGE", "flat", "traj"])]
    for i in range(n):
        b0, b1 = rng.normal(size=2) * (1.0, 0.3)
        for v in range(4):
            t = v + 0.1 * (i % 3)
            noise = rng.normal() * math.exp(0.45 * (clean[i, 4] - 1))
            y = 1 + b0 + 0.6 * clean[i, 5] + (0.5 + b1 + 0.4 * clean[i, 3]) * t + noise
            lines.append("\t".join([f"{i:04d}", "EUR" if i % 3 else "AJ", f"V{v}", f"{t:.3f}", f"{50 + i % 40}", "1" if i % 3 == 0 else f"{y:.6g}", f"{y:.6g}"]))
    (path / "clinical_1.tsv").write_text("\n".join(lines) + "\n")
    (path / "geno.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"{1 + j % 3}\t{100 * (j + 1)}\trs{j}\tA\tG\n" for j in range(m)))
    (path / "geno.psam").write_text("#IID\tSEX\n" + "".join(f"{i:04d}\t1\n" for i in range(n)))
    (path / "geno.pgen").write_bytes(binary.file_bytes(list(G.T), n))
    return path


RUNS = [
    {"name": "gallop", "model": "gallop", "outcome": "traj"},
    {"name": "gsnp", "model": "gallop", "outcome": "traj", "report_term": "SNP"},
    {"name": "mean", "model": "trajgwas", "outcome": "traj", "report_term": "MEAN"},
    {"name": "var", "model": "trajgwas", "outcome": "traj", "report_term": "VAR"},
    {"name": "joint", "model": "trajgwas", "outcome": "traj"},
    {"name": "plain", "model": "trajgwas", "outcome": "traj", "report_term": "VAR", "spa": False},
]


@pytest.fixture(scope="module")
def found(spark, folder):
    raw = {"defaults": {"genotype_prefix": "geno", "time_col": "years", "covariates": ["AGE"], "spa_p_cutoff": 0.05}, "runs": RUNS}
    return {name: {r["predictor"]: r for r in df.collect()} for name, df in runner.run_all(spark, config.parse(raw), str(folder)).items()}


def test_gallop_runs_from_binary_dosages(found):
    assert len(found["gallop"]) == 40
    best = min(found["gallop"].values(), key=lambda r: r["P"])
    assert best["predictor"] == "rs3" and best["P"] == best["P_SNPxTIME"] and best["test"] == "wald" and best["model_type"] == "gallop" and best["n_obs"] == 1200
    assert abs(best["beta"] - 0.4) < 4 * best["SE"]
    assert min(found["gsnp"].values(), key=lambda r: r["P"])["predictor"] == "rs5"
    assert all(r["P"] == r["P_SNP"] for r in found["gsnp"].values())


def test_trajgwas_terms_and_its_tail(found):
    for name, column in (("mean", "P_mean"), ("var", "P_var"), ("joint", "P_joint"), ("plain", "P_var")):
        assert len(found[name]) == 40 and all(r["P"] == r[column] for r in found[name].values())
    assert {r["test"] for r in found["plain"].values()} == {"score"}
    assert min(found["var"].values(), key=lambda r: r["P"])["predictor"] == "rs4"
    plain, some = found["plain"], 0
    for v, r in found["joint"].items():
        # the second look is taken by the variance axis' own P, whatever the joint P is
        looked = plain[v]["P_var"] < 0.05 or r["MAF"] <= 0.05
        assert r["test"] == ("spa" if looked and r["P_var"] != plain[v]["P_var"] else "score")
        assert r["P_joint"] == pytest.approx(plain[v]["P_joint"]) and r["P_mean"] == found["mean"][v]["P_mean"]
        some += looked and r["P_joint"] > 0.05
        if not looked:
            assert r["P_var"] == pytest.approx(plain[v]["P_var"])
    assert found["joint"]["rs4"]["test"] == "spa"
    assert all(r["P_mean"] == pytest.approx(found["gsnp"][v]["P"]) for v, r in found["mean"].items())


@pytest.mark.parametrize("model", ["gallop", "trajgwas"])
def test_slopes_for_the_stratum_whose_mixed_model_fails(spark, folder, monkeypatch, model):
    real = nulls.Round.of.__func__

    def of(cls, v, D, s2, p, n, subjects):
        if subjects == 100:  # the smaller stratum
            raise np.linalg.LinAlgError("planted")
        return real(cls, v, D, s2, p, n, subjects)

    monkeypatch.setattr(nulls.Round, "of", classmethod(of))
    raw = {"defaults": {"genotype_prefix": "geno", "time_col": "years", "covariates": ["AGE"], "strata_col": "ancestry"}, "runs": [{"name": model, "model": model, "outcome": "traj", "strata": ["AJ", "EUR"]}]}
    got = runner.run_all(spark, config.parse(raw), str(folder))[model].collect()
    assert {(r["strata"], r["model_type"]) for r in got} == {("AJ", "slope"), ("EUR", model)}
    with pytest.raises(np.linalg.LinAlgError):
        visits = spark.createDataFrame([("AJ", f"{i}", float(t), float(i * t)) for i in range(100) for t in range(3)], "strata string, IID string, t double, y double")
        nulls.fit_mixed(nulls.subject_products(visits, "y", "t", [], ["strata", "IID"]), 2)


def test_dosages_must_fit_the_lists(spark, folder, tmp_path):
    for name in ("pvar", "psam"):
        (tmp_path / f"geno.{name}").write_text((folder / f"geno.{name}").read_text())
    (tmp_path / "geno.pgen").write_bytes(binary.file_bytes([np.zeros(300)] * 3, 300))
    with pytest.raises(ValueError, match="3 variants"):
        runner.Genotypes.read(spark, str(tmp_path / "geno"))


def one_saddle(k1, k2, s):
    low, high, t = -100.0, 100.0, 0.0
    if not k1(low) <= s <= k1(high):
        return None
    for _ in range(200):
        t = (low + high) / 2
        low, high = (low, t) if k1(t) > s else (t, high)
    return t


def test_saddlepoints_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(2)
    n, v = 400, 30
    G = rng.binomial(2, 0.2, (v, n)).astype(float)
    X = np.column_stack([np.ones(n), rng.normal(size=n)])
    p = 1 / (1 + np.exp(-X @ [-1.5, 0.5]))
    y = (rng.random(n) < p).astype(float)
    scores = G @ (y - p) * rng.uniform(0, 4, v)
    got = tails.logistic_ps(G, p, X, scores)
    w = p * (1 - p)
    for g, s, value in zip(G, scores, got, strict=True):
        g = g - X @ np.linalg.solve((X * w[:, None]).T @ X, (X * w[:, None]).T @ g)
        q = lambda t: p * np.exp(g * t) / (1 - p + p * np.exp(g * t))  # noqa: B023, E731
        t = one_saddle(lambda t: float((g * (q(t) - p)).sum()), None, s)  # noqa: B023
        if t is None or abs(t) < 1e-7:
            assert np.isnan(value)
            continue
        k0, k2 = np.sum(np.log1p(p * np.expm1(g * t)) - t * g * p), (g * g * q(t) * (1 - q(t))).sum()
        square = 2 * (t * s - k0)
        if np.isnan(value):
            assert square < 1e-9 or value != value
            continue
        w_, u = math.copysign(math.sqrt(square), t), t * math.sqrt(k2)
        upper = 0.5 * math.erfc(w_ / math.sqrt(2)) + math.exp(-w_ * w_ / 2) / math.sqrt(2 * math.pi) * (1 / u - 1 / w_)
        assert value == pytest.approx(2 * min(upper, 1 - upper), rel=1e-5)
    assert (~np.isnan(got)).sum() > 20


@pytest.mark.parametrize("sent", [tails.SENT, 0])
def test_tails_of_packed_values_equal_those_of_rows(spark, monkeypatch, sent):
    rng = np.random.default_rng(6)
    n, m = 120, 9
    G = rng.binomial(2, 0.3, (m, n)).astype(float)
    G[rng.random(G.shape) < 0.05] = -9
    iids = [f"s{i:03d}" for i in range(n)]
    samples = spark.createDataFrame([(i, s) for i, s in enumerate(reversed(iids))], "sample_idx long, IID string")
    packed = genotypes.Packed(spark.createDataFrame([(j, [float(x) for x in G[j, ::-1]]) for j in range(m)], "variant_idx long, dosage array<float>"), samples)
    people = spark.createDataFrame([(s, i, float(k)) for s in ("a", "b") for k, i in enumerate(iids) if s == "a" or k % 3], "strata string, IID string, x double")
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("a", 4, 0.125), ("b", 8, 0.1)], "strata string, variant_idx long, P double")
    monkeypatch.setattr(tails, "SENT", sent)
    monkeypatch.setattr(tails, "AT_ONCE", 150)

    def f(tail_rows, people_, values):
        return tail_rows[["P"]].assign(total=values @ people_["x"].to_numpy(), n=len(people_))

    out = tails.refined(rows, packed, people, f, "P double, total double, n long", on="variant_idx")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Generate" not in plan) == bool(sent)
    got = {(r["strata"], r["variant_idx"]): (r["P"], r["total"], r["n"]) for r in out.collect()}
    assert set(got) == {("a", 1), ("b", 1), ("a", 4), ("b", 8)}
    for (s, j), (p, total, size) in got.items():
        who = np.array([k for k in range(n) if s == "a" or k % 3])
        g = G[j, who]
        g = np.where(g < 0, g[g >= 0].mean(), g)
        assert (size, total) == (len(who), pytest.approx(g @ who)) and p == {("a", 1): 0.5, ("b", 1): 0.25, ("a", 4): 0.125, ("b", 8): 0.1}[s, j]


def test_firth_is_the_maximum_of_the_penalised_likelihood():
    rng = np.random.default_rng(1)
    for separated in (False, True):
        x = rng.normal(size=60)
        y = (x > 0).astype(float) if separated else (rng.random(60) < 1 / (1 + np.exp(-x))).astype(float)
        X = np.column_stack([x, np.ones(60)])

        def value(b):
            eta = X @ b  # noqa: B023
            p = 1 / (1 + np.exp(-eta))
            return (y * eta - np.logaddexp(0, eta)).sum() + np.linalg.slogdet((X * (p * (1 - p))[:, None]).T @ X)[1] / 2  # noqa: B023

        b, se = tails.firth(X, y, tol=1e-9, rounds=500)
        for k in range(2):
            h = np.eye(2)[k] * 1e-4
            assert abs(value(b + h) - value(b - h)) / 2e-4 < 1e-3 and value(b) >= value(b + 30 * h) and value(b) >= value(b - 30 * h)
        p = 1 / (1 + np.exp(-X @ b))
        assert np.allclose(se, np.sqrt(np.diag(np.linalg.inv((X * (p * (1 - p))[:, None]).T @ X))))


def efron_one_by_one(d, all_, dead):
    k = all_[1].shape[1]
    u, info = np.zeros(k), np.zeros((k, k))
    for i, n in enumerate(d):
        for m in range(int(n)):
            f = m / n
            s0, s1, s2 = (a[i] - f * b[i] for a, b in zip(all_, dead, strict=True))
            u, info = u + s1 / s0, info + s2 / s0 - np.outer(s1, s1) / s0**2
    return u, info


def test_efron_sums(monkeypatch):
    rng = np.random.default_rng(7)
    Z, r = rng.normal(size=(500, 3)), rng.uniform(0.2, 2, 500)
    group = np.sort(rng.integers(0, 20, 500))
    e = rng.random(500) < 0.5
    sums = lambda x, keep: np.stack([x[(group == g) & keep].sum(0) for g in range(20)])
    every = [r, r[:, None] * Z, r[:, None, None] * Z[:, :, None] * Z[:, None, :]]
    all_, dead = [np.cumsum(sums(x, True), 0) for x in every], [sums(x, e) for x in every]
    d = np.array([(e & (group == g)).sum() for g in range(20)], float)
    want = efron_one_by_one(d, all_, dead)
    for most in (nulls.TIED, 7):
        monkeypatch.setattr(nulls, "TIED", most)
        for got, w in zip(nulls.efron(d, all_, dead), want, strict=True):
            np.testing.assert_allclose(got, w, rtol=1e-9, atol=1e-9)
    u, info = nulls.efron(np.zeros(0), [x[:0] for x in all_], [x[:0] for x in dead])
    assert not u.any() and not info.any()


def test_cox_on_many_ties(spark):
    """A million rows on fifty times: every time has thousands of deaths."""
    people = spark.range(1_000_000).select(F.lit("ALL").alias("strata"), F.col("id").cast("string").alias("IID"), ((F.xxhash64("id") % 1000) / F.lit(1000.0)).alias("x"), ((F.xxhash64("id", F.lit(1)) % 1_000_000) / F.lit(1e6)).alias("u"))
    people = people.withColumn("u", F.greatest(F.abs("u"), F.lit(1e-6)))
    t = F.ceil(-F.log("u") / F.exp(0.7 * F.col("x")) * 20)
    people = people.withColumns({"t": F.least(t, F.lit(50)).cast("double"), "e": (t < 50).cast("double")})
    _, b = nulls.cox_null(people, "t", "e", ["x"])
    assert b["ALL"][0] == pytest.approx(0.7, abs=0.03)


def test_an_id_that_repeats_is_two_variants(spark):
    schema = "predictor string, stratum string, CHR string, POS long, effect_allele string, other_allele string, EAF double, beta double, SE double, P double, N long"
    one = [("rs1", "A", "1", 100, "A", "G", 0.3, 1.0, 0.5, 0.04, 100), ("rs1", "A", "1", 200, "A", "G", 0.3, 3.0, 0.5, 0.04, 100)]
    got = sorted(meta.meta_analysis(spark.createDataFrame(one, schema)).collect(), key=lambda r: r["POS"])
    assert [(r["POS"], r["n_studies"], r["N_total"], r["direction"], r["beta_FE"]) for r in got] == [(100, 1, 100, "+", 1.0), (200, 1, 100, "+", 3.0)]
    # over two strata: by position, alleles in either order; a third variant at one place; the last by their order
    more = [*one, ("rs1", "B", "1", 200, "G", "A", 0.7, -5.0, 0.5, 0.1, 50), ("rs1", "A", "1", 200, "A", "T", 0.1, 9.0, 1.0, 0.1, 10), ("rs2", "A", "1", 300, "A", "G", 0.2, 1.0, 1.0, 0.3, 10), ("rs2", "B", None, None, "A", "G", 0.2, 2.0, 1.0, 0.3, 10),
            ("rs3", "A", "2", 5, "A", "G", 0.2, 1.0, 1.0, 0.3, 10), ("rs3", "A", "2", 5, "A", "G", 0.2, 2.0, 1.0, 0.3, 10)]
    rows = meta.meta_analysis(spark.createDataFrame(more, schema)).collect()
    assert sorted((r["predictor"], r["POS"], r["n_studies"], r["beta_FE"]) for r in rows) == [("rs1", 100, 1, 1.0), ("rs1", 200, 1, 9.0), ("rs1", 200, 2, 4.0), ("rs2", 300, 2, 1.5), ("rs3", 5, 1, 1.0), ("rs3", 5, 1, 2.0)]
    assert len({r["bonferroni_threshold"] for r in rows}) == 1 and rows[0]["bonferroni_threshold"] == pytest.approx(0.05 / 6)
