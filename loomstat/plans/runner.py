"""Runs of a configuration: clinical table and genotype set in, one result table per run with all strata."""

from __future__ import annotations

import datetime
import logging
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import chi2_p, norm_sf, normal_p
from ..operators import design, meta, nulls, report, scans, tails
from ..sources import binary, clinical, files, genotypes, results
from ..sources.config import GENOMEWIDE, Config, Run, load
from .stages import written

log = logging.getLogger(__name__)
REPEATED = ("slope", "gallop", "trajgwas")


@dataclass
class Genotypes:
    """A variant list, a sample list and dosages in packed form."""

    variants: DataFrame
    samples: DataFrame
    packed: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, prefix: str) -> Genotypes:
        """``prefix``.pvar, .psam and dosages: ``prefix``.dosage.parquet (variant_idx, dosage in sample order) if there is one,
        else ``prefix``.pgen, a binary file or a folder of them."""
        variants, samples = genotypes.read_variants(spark, f"{prefix}.pvar"), genotypes.read_samples(spark, f"{prefix}.psam")
        if genotypes.exists(spark, f"{prefix}.dosage.parquet"):
            out = cls(variants, samples, spark.read.parquet(f"{prefix}.dosage.parquet"))
            genotypes.check_counts(out.packed, out.variants, out.samples)
            return out
        stored, listed = binary.counts(f"{prefix}.pgen"), (variants.count(), samples.count())
        if stored != listed:
            raise ValueError(f"{prefix}.pgen has {stored[0]} variants of {stored[1]} samples; lists: {listed[0]} variants, {listed[1]} samples")
        return cls(variants, samples, binary.read_dosages(spark, f"{prefix}.pgen"))

    def values(self) -> genotypes.Packed:
        return genotypes.Packed(self.packed, self.samples)

    def of(self, ids: list[str]) -> DataFrame:
        """(IID, ID, dosage) of named variants: only their rows are unpacked."""
        some = genotypes.by_id(self.variants, ids)
        return genotypes.unpacked(self.packed.join(F.broadcast(some.select("variant_idx")), "variant_idx"), self.samples).join(F.broadcast(some.select("variant_idx", "ID")), "variant_idx")


@dataclass
class Study:
    spark: SparkSession
    table: DataFrame
    genotypes: Genotypes | None

    def frame(self, run: Run, columns: list[str], one_row: bool = True) -> DataFrame:
        """Filtered, stratified complete cases with IID; large enough strata only."""
        iid = run.get("sample_id_col")
        t = design.filtered(self.table, run.spec.get("sample_filter"))
        t = design.stratified(t, run.get("strata_col"), run.strata)
        design.require(t, [iid, *columns], run.name)
        design.require_numeric(t, columns)
        t = t.withColumn("IID", F.col(iid).cast("string"))
        if run.get("predictor_source") == "genetic":
            t = t.join(self.genotypes.samples.select("IID"), "IID", "left_semi")
        t = t.select("strata", "IID", clinical.ROW, *(F.col(c).cast("double").alias(c) for c in columns))
        t = design.complete(t, "IID", columns) if one_row else clinical.present(t, ["IID", *columns])
        return written(design.large_enough(t, int(run.get("min_n"))), "frame")

    def conditioned(self, run: Run, frame: DataFrame) -> tuple[DataFrame, list[str]]:
        """Conditioning variants as covariates, missing dosages at the stratum's mean; unknown ids are left out."""
        ids = list(run.spec.get("condition_snps") or [])
        if not ids:
            return frame, []
        found = self.genotypes.of(ids)
        names = []
        for i, v in enumerate(r["ID"] for r in found.select("ID").distinct().orderBy("ID").collect()):
            one = found.where(F.col("ID") == v).select("IID", F.col("dosage").alias("_d"))
            means = frame.join(one, "IID").groupBy("strata").agg(F.avg("_d").alias("_mean"))
            frame = frame.join(one, "IID", "left").join(F.broadcast(means), "strata").withColumn(f"_snp{i}", F.coalesce("_d", "_mean")).drop("_d", "_mean")
            names.append(f"_snp{i}")
        return frame, names


def identified(study: Study, run: Run, scan: DataFrame) -> DataFrame:
    """A genetic scan with the variants' identity and statistics, all from the scan's own sums; variants that fail
    quality control go."""
    maf = F.least(F.col("EAF"), 1 - F.col("EAF"))
    stats = scan.withColumns({"EAF": F.col("mu") / 2, "predictor_mean": F.col("mu"), "missing_rate": 1 - F.col("n_obs") / F.col("N")})
    stats = stats.withColumn("MAF", maf).withColumn("MAC", F.col("MAF") * 2 * F.col("n_obs"))
    limits = {k: float(run.defaults.get(k, d)) for k, d in (("maf_min", 0.01), ("mac_min", 20), ("missing_max", 0.05))}
    ids = study.genotypes.variants.select("variant_idx", "CHR", "POS", F.col("ID").alias("predictor"), F.col("ALT").alias("effect_allele"), F.col("REF").alias("other_allele"))
    return genotypes.passing(stats, **limits).drop("MAC", "mu").join(ids, "variant_idx").withColumn("zscored", F.lit(False))


def refine(run: Run, scan: DataFrame, values: genotypes.Packed, subjects: DataFrame, f, schema: str, p: str = "P") -> DataFrame:
    """Tail rows of every stratum (by column ``p``) through ``f`` (tail rows, subject table, values); their results replace
    the scan's. Values stay packed, as ``tails.refined`` says."""
    scan = written(scan, "scan")
    cut = tails.tail(scan, float(run.defaults.get("spa_p_cutoff", 0.01)), float(run.defaults.get("spa_maf_cutoff", 0.05)), p)
    new = tails.refined(cut, values, written(subjects, "subjects"), f, schema, on="variant_idx")
    names = [c for c in new.columns if c not in ("strata", "variant_idx")]
    met = scan.join(new.withColumnsRenamed({c: f"_new_{c}" for c in names}), ["strata", "variant_idx"], "left")
    return met.withColumns({c: F.coalesce(f"_new_{c}", c) for c in names}).drop(*(f"_new_{c}" for c in names))


def linear_run(study: Study, run: Run) -> DataFrame:
    y = run.spec["outcome"]
    frame, snps = study.conditioned(run, study.frame(run, [y, *run.covariates]))
    values, covariates = study.genotypes.values(), [*run.covariates, *snps]
    out = scans.linear_scan(values, scans.linear_null(frame, y, covariates), len(covariates), ["IID"], ["variant_idx"])
    return identified(study, run, out.withColumns({"test": F.lit("wald"), "model_type": F.lit("linear")}))


def logistic_run(study: Study, run: Run) -> DataFrame:
    y = run.spec["outcome"]
    frame, snps = study.conditioned(run, study.frame(run, [y, *run.covariates]))
    if frame.where(~F.col(y).isin(0.0, 1.0)).limit(1).count():
        raise ValueError(f"{run.name}: {y} must be 0 or 1")
    covariates = [*run.covariates, *snps]
    k = len(covariates) + 1
    null, _ = nulls.logistic_null(frame, y, covariates)
    values = study.genotypes.values()
    out = scans.logistic_scan(values, null, k, ["IID"], ["variant_idx"]).withColumns({"test": F.lit("score"), "model_type": F.lit("logistic")})
    out = identified(study, run, out)
    if not run.spec.get("spa", True):
        return out

    def f(rows: pd.DataFrame, people: pd.DataFrame, G: np.ndarray) -> pd.DataFrame:
        p, t = people["_p"].to_numpy(), people["_y"].to_numpy()
        Q = people[[f"_wq{j}" for j in range(k)]].to_numpy() / people[["_w"]].to_numpy()
        out = tails.spa_or_score(rows, tails.logistic_ps(G, p, Q, G @ (t - p))).assign(beta=np.nan, SE=np.nan)
        for i in np.flatnonzero(out["P"] < GENOMEWIDE):
            b, se = tails.firth(np.column_stack([G[i], Q]), t)
            if np.isfinite(b[0]) and se[0] > 0:
                out.loc[i, ["beta", "SE", "P", "test"]] = b[0], se[0], 2 * float(norm_sf(abs(b[0] / se[0]))), "firth"
        return out

    return refine(run, out, values, null, f, "P double, test string, beta double, SE double")


def cox_run(study: Study, run: Run) -> DataFrame:
    t, e = run.spec["duration_col"], run.spec["event_col"]
    frame, snps = study.conditioned(run, study.frame(run, [t, e, *run.covariates]))
    covariates = [*run.covariates, *snps]
    null, _ = nulls.cox_null(frame, t, e, covariates)
    null = written(null, "null")
    values = study.genotypes.values()
    lin = scans.linear_null(null.withColumnRenamed("_m", "m"), "m", covariates)
    out = scans.linear_scan(values, lin, len(covariates), ["IID"], ["variant_idx"])
    events = frame.groupBy("strata").agg(F.sum(e).cast("long").alias("n_events"))
    out = out.join(F.broadcast(events), "strata").withColumns({"test": F.lit("score"), "model_type": F.lit("cox")})
    out = identified(study, run, out)
    if not run.spec.get("spa", True):
        return out

    laws = tails.Empirical.of(null, "_m")

    def f(rows: pd.DataFrame, people: pd.DataFrame, G: np.ndarray) -> pd.DataFrame:
        (mean, law), m, X = laws[rows["strata"].iloc[0]], people["_m"].to_numpy(), people[covariates].to_numpy(float)
        Q = np.linalg.qr(np.column_stack([np.ones(len(m)), X]))[0]
        R = G - (G @ Q) @ Q.T
        out = tails.spa_or_score(rows, law.ps(R, R @ (m - mean))).assign(beta=np.nan, SE=np.nan, model_type=None)
        for i in np.flatnonzero(out["P"] < GENOMEWIDE):
            if fit := tails.cox_tiers(np.column_stack([G[i], X]), people[t].to_numpy(float), people[e].to_numpy(float)):
                out.loc[i, ["beta", "SE", "model_type", "P", "test"]] = fit[0], fit[1], fit[2], 2 * float(norm_sf(abs(fit[0] / fit[1]))), "full"
        return out

    return refine(run, out, values, null.select("strata", "IID", "_m", *dict.fromkeys([t, e, *covariates])), f, "P double, test string, beta double, SE double, model_type string")


def visits_of(study: Study, run: Run) -> tuple[DataFrame, str, str]:
    y, t = run.spec["outcome"], run.get("time_col")
    if not t:
        raise ValueError(f"{run.name}: {run.model} needs time_col")
    return study.frame(run, [y, t, *run.covariates], one_row=False), y, t


def slope_run(study: Study, run: Run, strata: list[str] | None = None) -> DataFrame:
    """Each subject's slope, then a linear scan of the slopes; of some strata only, if given."""
    visits, y, t = visits_of(study, run)
    if strata is not None:
        visits = visits.where(F.col("strata").isin(strata))
    slopes = design.subject_slopes(visits, "IID", y, t, ("strata",))
    at = F.struct(F.col(t), F.col(clinical.ROW))
    first = visits.groupBy("strata", "IID").agg(F.lit(1).alias("_one"), *(F.min_by(c, at).alias(c) for c in run.covariates)).drop("_one")
    frame = written(design.large_enough(slopes.join(first, ["strata", "IID"]), int(run.get("min_n"))), "slopes")
    values = study.genotypes.values()
    out = scans.linear_scan(values, scans.linear_null(frame, "slope", run.covariates), len(run.covariates), ["IID"], ["variant_idx"])
    n = frame.groupBy("strata").agg(F.sum("n_visits").alias("n_obs"))
    out = out.withColumns({"test": F.lit("wald"), "model_type": F.lit("slope"), **{f"{a}_SNPxTIME": F.col(a) for a in ("beta", "SE", "P")}})
    return identified(study, run, out).drop("n_obs").join(F.broadcast(n), "strata")  # one row a stratum


@dataclass
class MixedFit:
    """The null models of a run: those that were fitted, and the strata whose fit failed."""

    visits: DataFrame
    y: str
    t: str
    fits: dict[str, nulls.Mixed]
    failed: dict[str, str]
    null: DataFrame | None = None
    names: Column | None = None

    @classmethod
    def of(cls, study: Study, run: Run) -> MixedFit:
        visits, y, t = visits_of(study, run)
        p, failed = len(run.covariates) + 2, {}
        products = written(nulls.subject_products(visits, y, t, run.covariates, ["strata", "IID"]), "products")
        fits = nulls.fit_mixed(products, p, failed=failed)
        for s, why in failed.items():
            log.warning("%s %s: the mixed model failed (%s); slopes by subject instead", run.name, s, why)
        out = cls(visits.where(F.col("strata").isin(list(fits))), y, t, fits, failed)
        if fits:
            out.null = written(nulls.gallop_null(products.where(F.col("strata").isin(list(fits))), fits, p), "null")
            names = {s: run.model if f.converged else f"{run.model}_unconverged" for s, f in fits.items()}
            out.names = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("strata"))
        return out

    def scan(self, values: genotypes.Packed) -> DataFrame:
        """Main effects and effects on the slope; written, as what follows uses each of these columns many times."""
        return written(scans.gallop_scan(values, self.null, {s: f.a_inverse for s, f in self.fits.items()}, ["IID"], ["variant_idx"]), "scan")


def with_slopes(study: Study, run: Run, fit: MixedFit, scan) -> DataFrame:
    """``scan`` for the strata with a mixed model, the two-stage slope for those whose fit failed."""
    parts = ([scan(fit)] if fit.fits else []) + ([slope_run(study, run, list(fit.failed))] if fit.failed else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def gallop_run(study: Study, run: Run) -> DataFrame:
    def scan(fit: MixedFit) -> DataFrame:
        out = fit.scan(study.genotypes.values())
        term = "SNP" if str(run.spec.get("report_term", "SNPxTIME")).upper() == "SNP" else "SNPxTIME"
        n = fit.visits.groupBy("strata").agg(F.count(F.lit(1)).alias("n_obs"))
        out = out.withColumns({a: F.col(f"{a}_{term}") for a in ("beta", "SE", "P")})
        out = out.withColumns({"test": F.lit("wald"), "model_type": fit.names})
        return identified(study, run, out).drop("n_obs").join(F.broadcast(n), "strata")  # one row a stratum

    return with_slopes(study, run, MixedFit.of(study, run), scan)


def trajgwas_run(study: Study, run: Run) -> DataFrame:
    return with_slopes(study, run, MixedFit.of(study, run), lambda fit: trajgwas_scan(study, run, fit))


def trajgwas_scan(study: Study, run: Run, fit: MixedFit) -> DataFrame:
    """The mean axis from the mixed model, the variance axis from a scan of scaled excess dispersion, both together; tails
    of the variance axis are cut on its own P."""
    from .queries import dispersion

    visits, y, t, fits, null = fit.visits, fit.y, fit.t, fit.fits, fit.null
    values = study.genotypes.values()
    out = fit.scan(values)
    alpha = F.element_at(F.create_map(*(x for s, f in fits.items() for x in (F.lit(s), F.array(*map(F.lit, map(float, f.alpha)))))), F.col("strata"))
    k = len(run.covariates)
    line = alpha[0] + sum((alpha[i + 1] * F.col(c) for i, c in enumerate(run.covariates)), F.lit(0.0)) + (alpha[k + 1] + F.col("_b1")) * F.col(t) + F.col("_b0")
    excess = dispersion(visits.join(null.select("strata", "IID", "_b0", "_b1"), ["strata", "IID"]), F.col(y) - line, t)
    at = F.struct(F.col(t), F.col(clinical.ROW))
    first = visits.groupBy("strata", "IID").agg(F.lit(1).alias("_one"), *(F.min_by(c, at).alias(c) for c in run.covariates)).drop("_one")
    scaled = written(excess.withColumn("tau", F.col("excess") / F.sqrt(2.0 * F.col("n"))).join(first, ["strata", "IID"]), "scaled")
    tau = scans.linear_scan(values, scans.linear_null(scaled, "tau", run.covariates), k, ["IID"], ["variant_idx"])
    tau = written(tau, "scan").select("strata", "variant_idx", F.col("beta").alias("tau_var"), F.col("SE").alias("SE_var"), F.col("t").alias("_t"), normal_p(F.col("t")).alias("P_var"))
    out = out.join(tau, ["strata", "variant_idx"]).withColumns({f"{a}_mean": F.col(f"{a}_SNP") for a in ("beta", "SE", "P")})
    z = F.try_divide(F.col("beta_mean"), F.col("SE_mean"))
    out = out.withColumn("P_joint", chi2_p(z * z + F.col("_t") * F.col("_t"), F.lit(2.0)))
    term = str(run.spec.get("report_term", "JOINT")).upper()
    none = F.lit(None).cast("double")
    shown = {"MEAN": ("beta_mean", "SE_mean", "P_mean"), "VAR": ("tau_var", "SE_var", "P_var")}.get(term)
    picked = {a: F.col(c) for a, c in zip(("beta", "SE", "P"), shown, strict=True)} if shown else {"beta": none, "SE": none, "P": F.col("P_joint")}
    out = out.withColumns({**picked, "test": F.lit("score"), "model_type": fit.names})
    n = visits.groupBy("strata").agg(F.count(F.lit(1)).alias("n_obs"))
    out = identified(study, run, out.drop("beta_SNP", "SE_SNP", "P_SNP", "beta_SNPxTIME", "SE_SNPxTIME", "P_SNPxTIME")).drop("n_obs").join(F.broadcast(n), "strata")  # one row a stratum
    if not run.spec.get("spa", True):
        return out

    laws = tails.Empirical.of(scaled, "excess")

    def f(rows: pd.DataFrame, people: pd.DataFrame, G: np.ndarray) -> pd.DataFrame:
        mean, law = laws[rows["strata"].iloc[0]]
        v = people["excess"].to_numpy(float) - mean
        Q = np.linalg.qr(np.column_stack([np.ones(len(v)), people[run.covariates].to_numpy(float)]))[0]
        R = G - (G @ Q) @ Q.T
        p = law.ps(R, R @ v)
        return pd.DataFrame({"P_var": p, "P": p if term == "VAR" else np.nan, "test": np.where(np.isnan(p), None, "spa")})

    return refine(run, out, values, scaled.select("strata", "IID", "excess", *run.covariates), f, "P_var double, P double, test string", "P_var")


def tabular_run(study: Study, run: Run) -> DataFrame:
    """Linear or logistic over columns; other models are passed over with a warning."""
    y = run.spec["outcome"]
    predictors = [p for p in design.predictor_columns(study.table, run.get("predictors")) if p not in (y, *run.covariates)]
    iid = run.get("sample_id_col")
    t = design.stratified(design.filtered(study.table, run.spec.get("sample_filter")), run.get("strata_col"), run.strata)
    frame = written(design.large_enough(design.complete(t.withColumn("IID", F.col(iid).cast("string")), "IID", [y, *run.covariates]), int(run.get("min_n"))), "frame")
    flags = dict(every=bool(run.get("zscore_predictors")), binary=bool(run.get("zscore_binary")), dosage=bool(run.get("zscore_dosage")))
    long = design.z_scored(design.unpivoted(frame, ["strata", "IID"], predictors), ["strata", "predictor"], int(run.get("min_n")), **flags)
    facts = long.select("strata", "predictor", "zscored", "predictor_mean", F.col("predictor_sd").alias("_sd")).distinct()
    values = long.select("strata", "IID", "predictor", "value")
    numbers = frame.select("strata", "IID", *(F.col(c).cast("double").alias(c) for c in (y, *run.covariates)))
    k = len(run.covariates)
    if run.model == "linear":
        out = scans.linear_scan(values, scans.linear_null(numbers, y, run.covariates), k, ["strata", "IID"], ["predictor"]).withColumn("test", F.lit("wald"))
    else:
        null, _ = nulls.logistic_null(numbers, y, run.covariates)
        out = scans.logistic_scan(values, null, k + 1, ["strata", "IID"], ["predictor"]).withColumn("test", F.lit("score"))
    out = out.join(facts, ["strata", "predictor"]).withColumn("predictor_sd", F.col("_sd")).withColumn("missing_rate", 1 - F.col("n_obs") / F.col("N"))
    return out.withColumn("model_type", F.lit(run.model))


GENETIC = {"linear": linear_run, "logistic": logistic_run, "cox": cox_run, "slope": slope_run, "gallop": gallop_run, "trajgwas": trajgwas_run}


def result(study: Study, run: Run) -> DataFrame | None:
    """The result table of one run, all strata in it."""
    if run.get("predictor_source") == "tabular":
        if run.model not in ("linear", "logistic"):
            log.warning("%s: no tabular %s", run.name, run.model)
            return None
        scan = tabular_run(study, run)
    else:
        if study.genotypes is None:
            raise ValueError(f"{run.name} needs a genotype set")
        scan = GENETIC[run.model](study, run)
    ignored = run.model in REPEATED or run.get("predictor_source") == "tabular"
    if ignored and run.spec.get("condition_snps"):
        log.warning("%s: condition_snps has no effect on this model", run.name)
    conditioned = "" if ignored else ",".join(run.spec.get("condition_snps") or [])
    scan = scan.withColumns({"conditioned_on": F.lit(conditioned), "n_subjects": F.col("N")})
    # written, so that the filter on P below is not pushed into the formulas that P comes from
    scan = written(results.conform(scan).drop("bonferroni_threshold", "significant", "genomewide_sig"), "scan")
    return results.conform(scans.thresholds(scans.without_failures(scan), ["strata"]))


def run_all(spark: SparkSession, config: Config | str, folder: str = ".", only: list[str] | None = None) -> dict[str, DataFrame]:
    """All runs of a configuration; writes a CSV for each run and stratum, returns the tables by run."""
    config = load(config) if isinstance(config, str) else config
    base = config.runs[0] if config.runs else Run("", "linear", {}, config.defaults)
    table = clinical.read_clinical(spark, clinical.latest(spark, base.get("clinical_file"), folder), base.get("sample_id_col"))
    table = design.filtered(table, base.get("prefilter"))
    prefix = base.get("genotype_prefix")
    geno = Genotypes.read(spark, prefix if prefix.startswith("/") or "://" in prefix else files.joined(folder, prefix)) if prefix else None
    entries = base.get("derive") or {}
    snps = [m[1] for how in entries.values() if (m := design.SNP.match(how))]
    dosages = geno.of(snps) if geno and snps else None
    table = design.all_derived(table, entries, id_column=base.get("sample_id_col"), time_column=base.get("time_col"), dosages=dosages)
    study, out = Study(spark, written(table, "clinical"), geno), {}
    target = files.made(spark, files.joined(folder, base.get("output_dir")))
    stamp = datetime.datetime.now().strftime("%Y%m%d_%H%M%S")
    for run in config.runs:
        if only and run.name not in only:
            continue
        log.info("run %s", run.name)
        found = result(study, run)
        if found is None:
            continue
        found = written(found, f"result-{run.name}")
        for r in report.lambda_gc(found, ["strata"]).collect():
            log.info("%s %s: %d tests, lambda %.3f", run.name, r["strata"], r["n"], r["lambda"] or float("nan"))
            files.write_csv(found.where(F.col("strata") == r["strata"]), files.joined(target, f"{run.name}-{r['strata']}-{stamp}.csv"))
        out[run.name] = found
    return out


def meta_all(spark: SparkSession, folder: str, target: str, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Meta-analysis of every run with result files in ``folder``; writes META_ files. Runs without a usable file are
    passed over."""
    there, out = results.discover(spark, folder), {}
    files.made(spark, target)
    stamp = datetime.datetime.now().strftime("%Y%m%d_%H%M%S")
    for name in sorted({r for r, _ in there}):
        if only and name not in only:
            continue
        usable = results.usable(spark, {k: p for k, p in there.items() if k[0] == name})
        if usable:
            out[name] = meta_of(spark, usable, files.joined(target, f"META_{name}-{stamp}.csv"))
    return out


def meta_explicit(spark: SparkSession, paths: list[str], output: str) -> DataFrame:
    """Meta-analysis of the files given; a file's stratum is in its name, or is its name."""
    usable = results.usable(spark, results.named(paths))
    if not usable:
        raise ValueError("no file with predictor and N among the inputs")
    if "/" in output:
        files.made(spark, output.rsplit("/", 1)[0])
    return meta_of(spark, usable, output)


def meta_of(spark: SparkSession, paths: dict[tuple[str, str], str], output: str) -> DataFrame:
    found = written(meta.meta_analysis(results.read_results(spark, paths)), "meta")
    for p in ("P_FE", "P_RE"):
        for r in report.lambda_gc(found.withColumn("strata", F.lit("all")), ["strata"], p=p).collect():
            log.info("%s: lambda of %s %.4f over %d", os.path.basename(output), p, r["lambda"] or float("nan"), r["n"])
    files.write_csv(found, output)
    return found
