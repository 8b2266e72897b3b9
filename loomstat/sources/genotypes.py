"""Genotype sets: variant and sample lists, dosages in packed or long form, per-variant statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the dosage format.
MISSING_DOSAGE, DOSAGE_STEPS = -9.0, 16384
_PVAR = ["CHROM", "POS", "ID", "REF", "ALT"]


@dataclass
class Packed:
    """Dosages with one row a variant (variant_idx, dosage: an array in sample order) and the sample list."""

    rows: DataFrame
    samples: DataFrame

    def of(self, variants: DataFrame) -> DataFrame:
        """(variant_idx, IID, value) of the variants listed: only their rows are unpacked."""
        return unpacked(self.rows.join(variants.select("variant_idx").distinct(), "variant_idx", "left_semi"), self.samples).withColumnRenamed("dosage", "value")


@dataclass
class BySubject:
    """Dosages with one row a subject (IID, values: an array in predictor order, null: missing) and the predictor list (at, predictor)."""

    rows: DataFrame
    predictors: DataFrame

    def long(self) -> DataFrame:
        """(IID, predictor, value): one row a cell."""
        cells = self.rows.select("IID", F.posexplode("values").alias("at", "value"))
        return cells.join(F.broadcast(self.predictors), "at").select("IID", "predictor", "value")  # few predictors

    def of(self, predictor: str) -> DataFrame:
        """The cells of one predictor."""
        one = self.rows.crossJoin(F.broadcast(self.predictors.where(F.col("predictor") == predictor)))  # one row
        return one.select("IID", "predictor", F.get("values", F.col("at")).alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system of its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines with their order; comment lines (##) are left out."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return lines.where(~F.col("value").startswith("##") & (F.trim("value") != ""))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Gapless row numbers in file order: a count per partition, then a number within it."""
    part = F.shiftright("_at", 33)
    sizes = df.groupBy(part.alias("_part")).count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return df.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within - 1).drop("_part", "_start", "_at")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """variant_idx, CHR, POS, ID, REF, ALT of a variant list, with or without a header; other columns are ignored."""
    lines = _lines(spark, path)
    head = lines.where(F.col("value").startswith("#")).orderBy("_at").first()
    names = head["value"].lstrip("#").split("\t") if head else _PVAR
    if absent := [c for c in _PVAR if c not in names]:
        raise ValueError(f"{path} lacks {absent}")
    cell = lambda c: F.split("value", "\t")[names.index(c)]
    rows = lines.where(~F.col("value").startswith("#")).select(
        "_at", cell("CHROM").alias("CHR"), cell("POS").try_cast("bigint").alias("POS"), cell("ID").alias("ID"), cell("REF").alias("REF"), cell("ALT").alias("ALT")
    )
    return numbered(rows, "variant_idx")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, IID of a sample list; without an IID column the first one counts."""
    lines = _lines(spark, path)
    head = lines.orderBy("_at").first()
    names = head["value"].lstrip("#").split("\t")
    at = names.index("IID") if "IID" in names else 0
    rows = lines.where(F.col("_at") != head["_at"]).select("_at", F.split("value", "\t")[at].alias("IID"))
    return numbered(rows, "sample_idx")


def check_counts(packed: DataFrame, variants: DataFrame, samples: DataFrame) -> None:
    """Dosages must have a row for each variant and a value for each sample."""
    row = packed.agg(F.count(F.lit(1)), F.min(F.size("dosage")), F.max(F.size("dosage"))).first()
    n_variants, n_samples = variants.count(), samples.count()
    if row[0] != n_variants or {row[1], row[2]} != {n_samples}:
        raise ValueError(f"dosages: {row[0]} rows of {row[1]} to {row[2]} values; lists: {n_variants} variants, {n_samples} samples")


def unpacked(packed: DataFrame, samples: DataFrame) -> DataFrame:
    """Long form (variant_idx, IID, dosage) of rows with a dosage array in sample order; the missing mark is null."""
    long = packed.select("variant_idx", F.posexplode("dosage").alias("sample_idx", "dosage"))
    value = F.when((F.col("dosage") != MISSING_DOSAGE) & ~F.isnan("dosage"), F.col("dosage").cast("double"))
    return long.withColumn("dosage", value).join(samples, "sample_idx").select("variant_idx", "IID", "dosage")


def packed(long: DataFrame, samples: DataFrame) -> DataFrame:
    """Packed form of long dosages: an array of floats in sample order for each variant, missing ones marked."""
    cells = long.join(samples, "IID").groupBy("variant_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", F.coalesce("dosage", F.lit(MISSING_DOSAGE)).alias("d")))).alias("c"))
    return cells.select("variant_idx", F.transform("c", lambda x: x["d"].cast("float")).alias("dosage"))


def quantised(dosage: Column) -> Column:
    """On the format's grid, within 0 and 2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.round(dosage * DOSAGE_STEPS) / DOSAGE_STEPS))


def by_id(variants: DataFrame, ids: list[str]) -> DataFrame:
    """The variants with these ids; unknown ids are left out, of repeated ones the last in file order counts."""
    last = Window.partitionBy("ID").orderBy(F.desc("variant_idx"))
    return variants.where(F.col("ID").isin(ids)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def statistics(long: DataFrame, n: Column | int, by: tuple[str, ...] = ("variant_idx",)) -> DataFrame:
    """n_obs, EAF, MAF, MAC, missing_rate, predictor_mean and predictor_sd of each variant; ``n`` counts all subjects."""
    out = long.groupBy(*by).agg(
        F.count("dosage").alias("n_obs"), (F.avg("dosage") / 2).alias("EAF"), F.avg("dosage").alias("predictor_mean"), F.stddev_samp("dosage").alias("predictor_sd")
    )
    n = F.lit(n) if isinstance(n, int) else n
    maf = F.least(F.col("EAF"), 1 - F.col("EAF"))
    return out.withColumns({"MAF": maf, "MAC": maf * 2 * F.col("n_obs"), "missing_rate": 1 - F.col("n_obs") / n})


def passing(stats: DataFrame, maf_min: float = 0.01, mac_min: float = 20, missing_max: float = 0.05) -> DataFrame:
    """Variants that pass quality control."""
    return stats.where((F.col("MAF") >= maf_min) & (F.col("MAC") >= mac_min) & (F.col("missing_rate") <= missing_max) & F.col("EAF").isNotNull())


def mean_imputed(long: DataFrame, by: tuple[str, ...] = ("variant_idx",)) -> DataFrame:
    """Missing dosages become the variant's mean: grouped sums with a map-side part, met again by a join."""
    means = long.groupBy(*by).agg(F.avg("dosage").alias("_mean"))
    return long.join(means, list(by)).withColumn("dosage", F.coalesce("dosage", "_mean")).drop("_mean")
