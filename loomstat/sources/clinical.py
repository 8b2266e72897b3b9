"""Clinical tables: tab-separated text, one row per subject and visit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

#: What counts as missing in a text table.
MISSING = ["", "#N/A", "#NA", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ROW = "_row"


def latest(spark: SparkSession, pattern: str, folder: str = ".") -> str:
    """The lexically last file that matches ``pattern``, in ``folder`` unless it is a whole path; none is an error."""
    whole = pattern.startswith("/") or "://" in pattern
    found = files.matching(spark, pattern if whole else files.joined(folder, pattern))
    if not found:
        raise FileNotFoundError(f"no file matches {pattern!r} in {folder!r}")
    return found[-1]


def with_row_order(df: DataFrame) -> DataFrame:
    """Adds ``_row``, increasing in file order: what first and last mean when rows tie."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def blanks_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating-point columns to null, so that filters, counts and extremes skip them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in kinds.items() if isinstance(k, (T.DoubleType, T.FloatType))})


def read_clinical(spark: SparkSession, path: str, id_column: str = "IID") -> DataFrame:
    """Reads a table; ids stay strings, other columns become long or double where every value allows it.

    Types are found in one pass over all rows: a column is numeric if no present value fails to cast.
    """
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    raw = with_row_order(raw.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns)))
    free = [c for c in raw.columns if c not in (id_column, ROW)]
    tests = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{k}{i}") for i, c in enumerate(free) for k in ("bigint", "double")]
    bad = raw.agg(*tests).first() if tests else None
    kinds = {c: "bigint" if not bad[f"bigint{i}"] else "double" if not bad[f"double{i}"] else "string" for i, c in enumerate(free)}
    return blanks_to_null(raw.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns)))


def write_clinical(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Writes a tab-separated table; doubles with six significant digits."""
    columns = columns or [c for c in df.columns if c != ROW]
    kinds = dict(df.dtypes)
    out = [F.format_string("%.6g", c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*out).write.csv(path, sep="\t", header=True, mode="overwrite")


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete cases."""
    return blanks_to_null(df).na.drop(subset=columns)


def first_per_subject(df: DataFrame, id_column: str) -> DataFrame:
    """The first row of each subject in input order (``_row``)."""
    rank = F.row_number().over(Window.partitionBy(id_column).orderBy(ROW))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")
