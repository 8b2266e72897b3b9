"""Exact medians by counts, files through the session's file systems, and the check of runs against planted effects."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import report, selection, truth
from loomstat.plans import runner
from loomstat.sources import clinical, config, files, results


def test_medians_are_exact(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGES", 8)
    rng = np.random.default_rng(3)
    groups = {
        "odd": rng.normal(size=301).tolist(), "even": rng.chisquare(1, 300).tolist(), "ties": [1.0] * 200 + [2.0] * 200 + [5.0], "halves": [1.0] * 50 + [2.0] * 50, "one": [7.5], "two": [1.0, 4.0],
        "tail": [*rng.chisquare(1, 500).tolist(), 1e300, 1e12], "same": [0.25] * 90, "minus": (-rng.exponential(size=77)).tolist(), "tiny": [5e-324, 1e-320, 3e-310],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("odd", None), ("odd", math.nan), ("odd", math.inf), ("none", None)]
    got = {r["g"]: r for r in selection.medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g]["median"] == pytest.approx(statistics.median(xs), rel=1e-15, abs=0) and got[g]["n"] == len(xs)
    assert selection.medians(spark.createDataFrame([], "g string, x double"), ["g"], "x").count() == 0


def test_lambda_is_the_median(spark):
    df = spark.range(20_000).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run"), (F.abs(F.xxhash64("id") % 100_003) / F.lit(100_003.0) + F.lit(1e-9)).alias("P"))
    plain = df.withColumn("_x", report.chi2_1_quantile(F.col("P"))).groupBy("run").agg(F.median("_x").alias("m"), F.count("_x").alias("n"))
    want = {r["run"]: (r["m"] / report.CHI2_MEDIAN, r["n"]) for r in plain.collect()}
    got = {r["run"]: (r["lambda"], r["n"]) for r in report.lambda_gc(df, ["run"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_files_by_path_and_by_url(spark, tmp_path):
    for name in ("a-b-EUR-20260101_000000.csv", "a-b-EUR-20260201_000000.csv", "META_a-b-20260101_000000.csv", "x.txt"):
        (tmp_path / name).write_text("predictor,N\nv,1\n")
    for folder in (str(tmp_path), tmp_path.as_uri()):
        found = results.discover(spark, folder)
        assert list(found) == [("a-b", "EUR")] and found[("a-b", "EUR")].endswith("a-b-EUR-20260201_000000.csv") and found[("a-b", "EUR")].startswith(folder.split(":")[0])
        assert list(results.discover(spark, folder, meta=True)) == [("a-b",)]
        assert clinical.latest(spark, "*.txt", folder).endswith("x.txt")
    assert results.discover(spark, str(tmp_path / "absent")) == {}
    with pytest.raises(FileNotFoundError):
        clinical.latest(spark, "none*", str(tmp_path))


def test_one_csv_file_or_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1e-300, True), (2, None, None, False), (3, 'q"x', math.nan, None)], "k long, s string, x double, ok boolean")
    path = tmp_path / "deep" / "out.csv"
    files.made(spark, str(path.parent))
    files.write_csv(df.repartition(3), str(path))
    back = {r["k"]: r for r in spark.read.csv(str(path), header=True, nullValue="", escape="\\", schema="k long, s string, x double, ok string").collect()}
    assert (back[1]["s"], back[1]["x"], back[1]["ok"], back[2]["s"], back[2]["x"], back[2]["ok"]) == ("a,b", 1e-300, "True", None, None, "False")
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["out.csv"]
    files.write_csv(df.limit(0), str(path))  # replaced
    assert path.read_text().strip() == "k,s,x,ok"
    bad = df.withColumn("x", F.expr("raise_error('planted')").cast("double"))
    with pytest.raises(Exception, match="planted"):
        files.write_csv(bad, str(tmp_path / "bad.csv"))
    assert [p.name for p in tmp_path.iterdir()] == ["deep"]


def test_truth_check(spark):
    rng = np.random.default_rng(2)
    rows = [("a", f"v{i}", float(b), 1.0, 0.5) for i, b in enumerate(rng.normal(size=5))]
    rows = [("a", f"v{i}", 0.1, 1.0, float(p)) for i, p in enumerate((np.arange(1000) + 0.5) / 1000)] + [("b", f"v{i}", 0.1, 1.0, float(p) ** 3) for i, p in enumerate((np.arange(1000) + 0.5) / 1000)]
    rows += [("a", "x", 5.0, 1.0, 1e-9), ("a", "y", 9.1, 1.0, 0.5), ("a", "z", None, None, 1e-7), ("b", "x", 1.0, 0.1, 1e-20)]
    planted = [("a", "x", 2.0), ("a", "y", 5.0), ("a", "z", None), ("b", "x", 1.1), ("b", "gone", 1.0)]
    got = truth.truth_check(spark.createDataFrame(rows, "run string, predictor string, beta double, SE double, P double"), spark.createDataFrame(planted, "run string, predictor string, true_effect double"))
    a, b = sorted(got.collect())
    assert (a["planted"], a["found"], a["covered"], a["hits"], a["n"], a["fine"]) == (3, 3, 2, 2, 1000, False) and a["lambda"] == pytest.approx(1, abs=0.01)
    assert (b["planted"], b["found"], b["covered"], b["hits"], b["fine"]) == (2, 1, 1, 1, False) and b["lambda"] > 1.2


def test_all_six_models_cover_what_was_planted(spark, tmp_path):
    rng = np.random.default_rng(21)
    n, m = 400, 60
    G = rng.binomial(2, rng.uniform(0.2, 0.5, m), (n, m)).astype(float)
    y = 1 + 0.8 * G[:, 0] + rng.normal(size=n)
    case = (rng.random(n) < 1 / (1 + np.exp(-(-0.9 + 0.9 * G[:, 1])))).astype(int)
    t = rng.exponential(6 * np.exp(-0.7 * G[:, 2]))
    lines = ["\t".join(["IID", "visit", "years", "AGE", "y", "case", "tte", "event", "traj"])]
    for i in range(n):
        b0, b1 = rng.normal(size=2) * (1.0, 0.3)
        for v in range(4):
            at = v + 0.1 * (i % 3)
            traj = 1 + b0 + (0.5 + b1 + 0.4 * G[i, 3]) * at + rng.normal() * math.exp(0.5 * (G[i, 4] - 1))
            lines.append("\t".join(map(str, [f"{i:04d}", f"V{v}", f"{at:.3f}", 50 + i % 40, f"{y[i]:.6g}", case[i], f"{min(t[i], 9):.4g}", int(t[i] < 9), f"{traj:.6g}"])))
    (tmp_path / "clinical_1.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "geno.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{100 * (j + 1)}\trs{j}\tA\tG\n" for j in range(m)))
    (tmp_path / "geno.psam").write_text("#IID\tSEX\n" + "".join(f"{i:04d}\t1\n" for i in range(n)))
    spark.createDataFrame([(j, [float(x) for x in G[:, j]]) for j in range(m)], "variant_idx long, dosage array<float>").write.parquet(str(tmp_path / "geno.dosage.parquet"))
    runs = [
        {"name": "linear", "outcome": "y"}, {"name": "logistic", "model": "logistic", "outcome": "case"}, {"name": "cox", "model": "cox", "duration_col": "tte", "event_col": "event"},
        {"name": "slope", "model": "slope", "outcome": "traj"}, {"name": "gallop", "model": "gallop", "outcome": "traj"}, {"name": "trajgwas", "model": "trajgwas", "outcome": "traj", "report_term": "VAR"},
    ]
    got = runner.run_all(spark, config.parse({"defaults": {"genotype_prefix": "geno", "time_col": "years", "covariates": ["AGE"]}, "runs": runs}), str(tmp_path))
    every = None
    for name, df in got.items():
        one = df.withColumn("run", F.lit(name))
        every = one if every is None else every.unionByName(one)
    # effects of a linear score test on case status, of residuals and of spread stand on scales of their own: only their hits count
    planted = spark.createDataFrame([("linear", "rs0", 0.8), ("logistic", "rs1", 0.9), ("cox", "rs2", None), ("slope", "rs3", 0.4), ("gallop", "rs3", 0.4), ("trajgwas", "rs4", None)], "run string, predictor string, true_effect double")
    check = {r["run"]: r for r in truth.truth_check(every, planted, band=(0.5, 1.6)).collect()}
    assert set(check) == {r["name"] for r in runs}
    for name, r in check.items():
        assert r["planted"] == r["found"] == r["covered"] == r["hits"] == 1 and r["n"] >= 50 and r["fine"], (name, r)
