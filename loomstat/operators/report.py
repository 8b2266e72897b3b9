"""Calibration and report tables: lambda, QQ, Manhattan, volcano, coverage, hits, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import CHI2_MEDIAN, chi2_1_quantile
from ..sources.config import ALPHA, GENOMEWIDE
from ..plans.stages import written
from .running import ranged, running
from .selection import medians

#: Bands of minor allele frequency, and the fewest rows of a band that is shown.
BANDS = (("common", 0.05, 0.5001), ("low", 0.01, 0.05), ("rare", 0.0, 0.01))
LEAST_ROWS, LABELS, TOP_HITS, GAP = 20, 12, 50, 1.02


def usable_p(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c <= 1)


def lambda_gc(df: DataFrame, by: list[str], chi2: str | None = None, p: str = "P") -> DataFrame:
    """Exact median of chi-square values over the distribution's median; from ``chi2``, or from P-values. Found by refined
    counts, so no task holds a group's values."""
    value = F.col(chi2) if chi2 else chi2_1_quantile(F.col(p))
    rows = df if chi2 else df.where(usable_p(F.col(p)))
    found = medians(written(rows.select(*by, value.alias("_x")), "chi2"), by, "_x")
    return found.select(*by, (F.col("median") / CHI2_MEDIAN).alias("lambda"), "n")


def maf(df: DataFrame) -> Column:
    """MAF if the column is there with any value, else from EAF."""
    if "MAF" in df.columns and df.where(F.col("MAF").isNotNull()).limit(1).count():
        return F.col("MAF")
    return F.least(F.col("EAF"), 1 - F.col("EAF"))


def banded(df: DataFrame, frequency: Column) -> DataFrame:
    """Each row in the band ``all`` and in its own."""
    own = None
    for name, low, high in BANDS:
        hit = (frequency >= low) & (frequency < high)
        own = F.when(hit, name) if own is None else own.when(hit, name)
    return df.withColumn("band", F.explode(F.filter(F.array(F.lit("all"), own), lambda x: x.isNotNull())))


def lambda_by_band(df: DataFrame, by: list[str], chi2: str | None = None) -> DataFrame:
    return lambda_gc(banded(df, maf(df)), [*by, "band"], chi2).where(F.col("n") >= LEAST_ROWS)


def qq(df: DataFrame, by: list[str], p: str = "P") -> DataFrame:
    """Observed and expected -log10 P by rank; groups with too few rows are left out."""
    rows = df.where(usable_p(F.col(p))).withColumns({"_one": F.lit(1).cast("long"), "_p": F.col(p)})
    rows = ranged(rows, by, ["_p", "predictor"])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS)
    ranked = running(rows.join(sizes, by), by, ["_p", "predictor"], {"_one": "rank"})
    return ranked.withColumns({"observed": -F.log10("_p"), "expected": -F.log10((F.col("rank") - 0.5) / F.col("n"))}).drop("_one", "_p")


def chromosome_order() -> list[Column]:
    bare = F.regexp_replace("CHR", "(?i)^chr", "")
    return [bare.try_cast("int").asc_nulls_last(), bare.asc()]


def manhattan(df: DataFrame, p: str = "P") -> DataFrame:
    """x (position laid out by chromosome from its first one on), -log10 P, hit flags and the Bonferroni line over the plotted rows."""
    rows = df.where(usable_p(F.col(p)) & F.col("CHR").isNotNull() & F.col("POS").isNotNull())
    chromosomes = rows.groupBy("CHR").agg(F.min("POS").alias("_low"), F.when(F.count(F.lit(1)) > 1, F.max("POS") - F.min("POS")).otherwise(F.lit(1)).alias("_span"))  # few rows
    before = Window.orderBy(*chromosome_order()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chromosomes.select("CHR", (F.coalesce(F.sum(F.col("_span") * GAP + 1).over(before), F.lit(0.0)) - F.col("_low")).alias("_offset"))
    line = rows.agg((F.lit(ALPHA) / F.count(F.lit(1))).alias("bonferroni"))
    out = rows.join(F.broadcast(offsets), "CHR").crossJoin(F.broadcast(line))  # one row
    return out.withColumns({"x": F.col("POS") + F.col("_offset"), "mlogp": -F.log10(p), "hit": F.col(p) < GENOMEWIDE, "significant": F.col(p) < F.col("bonferroni")}).drop("_offset")


def volcano(df: DataFrame, beta: str = "beta", p: str = "P", key: tuple[str, ...] = ("predictor",)) -> DataFrame:
    """-log10 P against the effect; the rows with the smallest P-values below the Bonferroni line are labelled.

    ``key`` tells rows apart that tie. Each row comes once: labels are given by comparison with the last labelled row.
    """
    rows = df.where(usable_p(F.col(p)) & F.col(beta).isNotNull())
    line = rows.agg((F.lit(ALPHA) / F.count(F.lit(1))).alias("bonferroni"))
    out = rows.crossJoin(F.broadcast(line)).withColumns({"mlogp": -F.log10(p), "significant": F.col(p) < F.col("bonferroni")})  # one row
    place = F.struct(p, *key)
    last = out.where("significant").select(place.alias("_place")).orderBy("_place").limit(LABELS).agg(F.max("_place").alias("_last"))
    label = F.when(F.col("significant") & (place <= F.col("_last")), F.col("predictor"))
    return out.crossJoin(F.broadcast(last)).withColumn("label", label).drop("_last")  # one row


def pick(df: DataFrame) -> tuple[str, str]:
    """P and effect columns: the fixed-effects ones where the plain ones have no value."""
    has = lambda c: c in df.columns and bool(df.where(F.col(c).isNotNull()).limit(1).count())
    return ("P" if has("P") else "P_FE"), ("beta" if has("beta") else "beta_FE")


def is_genetic(df: DataFrame) -> bool:
    return {"CHR", "POS"} <= set(df.columns) and bool(df.agg((F.count("CHR") > 0) & (F.count("POS") > 0)).first()[0])


def coverage(results: DataFrame, by: list[str]) -> DataFrame:
    """Per run: model, range of N, tests and genome-wide hits."""
    return results.groupBy(*by).agg(
        F.min_by("model_type", "stratum").alias("model_type"), F.min("N").alias("n_min"), F.max("N").alias("n_max"), F.count(F.lit(1)).alias("tests"), F.count_if(F.col("P") < GENOMEWIDE).alias("hits")
    )


def top_hits(results: DataFrame, key: list[str], limit: int = TOP_HITS) -> DataFrame:
    """The best P of each key among genome-wide hits, smallest first."""
    best = Window.partitionBy(*key).orderBy("P", "stratum")
    hits = results.where(F.col("P") < GENOMEWIDE).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return hits.orderBy("P", *key).limit(limit)


def markdown(df: DataFrame, formats: dict[str, str] | None = None) -> str:
    """A small table as Markdown; missing values are a dash."""
    show = lambda c, v: "—" if v is None or v != v else format(v, (formats or {}).get(c, "")) if c in (formats or {}) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in df.collect())])


def calibration(results: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """lambda and rows by run and source: each stratum, and the fixed (FE) and random (RE) effects of ``meta``."""
    out = lambda_gc(results.withColumn("source", F.col("stratum")), ["run", "source"])
    for source in ("FE", "RE") if meta is not None else ():
        out = out.unionByName(lambda_gc(meta.withColumn("source", F.lit(source)), ["run", "source"], p=f"P_{source}"))
    return out


def united_hits(results: DataFrame, meta: DataFrame | None = None, limit: int = TOP_HITS) -> DataFrame:
    """Genome-wide hits of all strata and of the fixed effects: of each run and predictor the smallest P and its source."""
    rows = results.select("run", "predictor", F.col("stratum").alias("source"), "beta", "SE", "P")
    if meta is not None:
        rows = rows.unionByName(meta.select("run", "predictor", F.lit("FE").alias("source"), F.col("beta_FE").alias("beta"), F.col("SE_FE").alias("SE"), F.col("P_FE").alias("P")))
    hits = rows.where(F.col("P") < GENOMEWIDE).groupBy("run", "predictor").agg(F.min(F.struct("P", "source", "beta", "SE")).alias("_best"))
    return hits.select("run", "predictor", "_best.*").orderBy("P", "run", "predictor").limit(limit)


def primary_rows(results: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(run, P, EAF) that stand for each run: its fixed effects if it has a meta table, else its first stratum."""
    first = results.groupBy("run").agg(F.min("stratum").alias("stratum"))
    frequency = F.coalesce("MAF", F.least(F.col("EAF"), 1 - F.col("EAF"))) if "MAF" in results.columns else F.col("EAF")
    out = results.join(first, ["run", "stratum"], "left_semi").select("run", "P", frequency.alias("EAF"))
    if meta is None:
        return out
    return meta.select("run", F.col("P_FE").alias("P"), "EAF").unionByName(out.join(meta.select("run").distinct(), "run", "left_anti"))


def summary(results: DataFrame, meta: DataFrame | None = None) -> str:
    """The Markdown report: coverage, calibration by source and by allele frequency, hits."""
    three = {"lambda": ".3f"}
    primary = primary_rows(results, meta)
    parts = ["# Results", "", "## Coverage", "", markdown(coverage(results, ["run"]).orderBy("run")), "", "## Calibration", ""]
    parts += [markdown(calibration(results, meta).orderBy("run", "source"), three), "", markdown(lambda_by_band(primary, ["run"]).orderBy("run", "band"), three), "", "## Hits", ""]
    columns = ["run", "source", "predictor", "beta", "SE", "P"]
    return "\n".join([*parts, markdown(united_hits(results, meta).select(*columns), {"beta": "+.3g", "SE": ".3g", "P": ".2e"}), ""])
