"""Result tables: their schema, their files, and which of several is the latest."""

from __future__ import annotations

import logging
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

log = logging.getLogger(__name__)

#: The columns of a result table, in order.
_STRINGS = {"predictor", "CHR", "effect_allele", "other_allele", "model_type", "test", "conditioned_on", "strata"}
_LONGS = {"POS", "N", "n_obs", "n_subjects", "n_events"}
_BOOLEANS = {"zscored", "genomewide_sig", "significant"}
RESULT_COLUMNS = [
    "predictor", "CHR", "POS", "effect_allele", "other_allele",
    "EAF", "MAF", "missing_rate", "predictor_mean", "predictor_sd", "zscored",
    "N", "n_obs", "n_subjects", "n_events", "beta", "SE", "P",
    "beta_SNP", "SE_SNP", "P_SNP", "beta_SNPxTIME", "SE_SNPxTIME", "P_SNPxTIME",
    "beta_mean", "SE_mean", "P_mean", "tau_var", "SE_var", "P_var", "P_joint",
    "model_type", "test", "genomewide_sig",
    "bonferroni_threshold", "significant", "conditioned_on", "strata",
]
#: File names are run, stratum, time stamp; a run may hold hyphens, a stratum can't.
STUDY = re.compile(r"^(?P<run>.+)-(?P<stratum>[^-]+)-(?P<stamp>\d{8}[_-]\d{6})\.csv$")
META = re.compile(r"^META_(?P<run>.+)-(?P<stamp>\d{8}[_-]\d{6})\.csv$")


def _kind(c: str) -> T.DataType:
    return T.StringType() if c in _STRINGS else T.LongType() if c in _LONGS else T.BooleanType() if c in _BOOLEANS else T.DoubleType()


RESULT_SCHEMA = T.StructType([T.StructField(c, _kind(c)) for c in RESULT_COLUMNS])


def conform(df: DataFrame) -> DataFrame:
    """Exactly the result columns: absent ones null, others dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields))


def discover(spark: SparkSession, folder: str, meta: bool = False) -> dict[tuple[str, ...], str]:
    """Latest file of each (run, stratum), or of each run for meta tables; files named otherwise are passed over."""
    pattern = META if meta else STUDY
    found: dict[tuple[str, ...], tuple[str, str]] = {}
    for path in files.in_folder(spark, folder):
        name = os.path.basename(path)
        m = pattern.match(name)
        if not m or (not meta and name.startswith("META_")):
            continue
        key = (m["run"],) if meta else (m["run"], m["stratum"])
        found[key] = max(found.get(key, ("", "")), (m["stamp"], path))
    return {k: p for k, (_, p) in sorted(found.items())}


def named(paths: list[str]) -> dict[tuple[str, str], str]:
    """Files given one by one under (run, stratum): by their names, or with the whole name as the stratum."""
    found = {p: STUDY.match(os.path.basename(p)) for p in paths}
    run = next((m["run"] for m in found.values() if m), "manual")
    return {(run, m["stratum"] if m else os.path.splitext(os.path.basename(p))[0]): p for p, m in found.items()}


def usable(spark: SparkSession, paths: dict[tuple[str, str], str]) -> dict[tuple[str, str], str]:
    """The files whose header has predictor and N; others are named in a warning and passed over."""
    out = {}
    for key, path in paths.items():
        if {"predictor", "N"} <= set(spark.read.csv(path, header=True).columns):
            out[key] = path
        else:
            log.warning("%s lacks predictor or N", path)
    return out


#: Columns of a meta table that reports need, with their types.
META_COLUMNS = "predictor string, CHR string, POS long, EAF double, N_total long, beta_FE double, SE_FE double, P_FE double, beta_RE double, SE_RE double, P_RE double"


def read_meta(spark: SparkSession, paths: dict[tuple[str, ...], str]) -> DataFrame | None:
    """Meta tables as one, with ``run``; None without files."""
    out = None
    for (run,), path in paths.items():
        table = spark.read.csv(path, header=True, nullValue="")
        kinds = [c.split() for c in META_COLUMNS.split(", ")]
        one = table.select(F.lit(run).alias("run"), *((F.col(c) if c in table.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds))
        out = one if out is None else out.unionByName(one)
    return out


def read_results(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """All files as one table, with ``run`` and ``stratum`` from the key."""
    out = None
    for (run, stratum), path in paths.items():
        one = conform(spark.read.csv(path, header=True, nullValue="")).withColumns({"run": F.lit(run), "stratum": F.lit(stratum)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise FileNotFoundError("no result files")
    return out


def write_results(df: DataFrame, folder: str) -> None:
    """Parquet, partitioned by run and stratum."""
    df.write.mode("append").partitionBy("run", "stratum").parquet(folder)
