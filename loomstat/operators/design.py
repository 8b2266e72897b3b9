"""From a clinical table to a design: filters, strata, derived columns, covariates, tested predictors."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import ExpressionError, column
from ..sources.clinical import ROW, blanks_to_null, first_per_subject, with_row_order

AGGREGATE = re.compile(r"^\s*(baseline_of|delta|slope_of)\s*\((.*)\)\s*$", re.DOTALL)
SNP = re.compile(r"^\s*snp\s*\(\s*['\"]?([^'\")]+?)['\"]?\s*\)\s*$")


def require(df: DataFrame, columns: Iterable[str], what: str = "design") -> None:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks columns {absent}")


def require_numeric(df: DataFrame, columns: Iterable[str]) -> None:
    """Text covariates are an error, not silently missing."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if text := [c for c in columns if not isinstance(kinds[c], (T.NumericType, T.BooleanType))]:
        raise ValueError(f"not numeric: {text}")


def filtered(df: DataFrame, expressions: str | Iterable[str] | None) -> DataFrame:
    """Rows for which all expressions hold."""
    for e in [expressions] if isinstance(expressions, str) else expressions or []:
        df = df.where(F.coalesce(column(e, df), F.lit(False)))
    return df


def as_stratum(df: DataFrame, name: str) -> Column:
    """A column as text for strata; whole doubles without their fraction read like integers."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def stratified(df: DataFrame, name: str | None, strata: Iterable[str | None]) -> DataFrame:
    """Adds ``strata``: rows of the wanted values, and all rows as ``ALL`` where None is wanted; one plan for all."""
    strata = list(strata)
    wanted = [str(s) for s in strata if s is not None]
    if wanted and not name:
        raise ValueError("strata need a column")
    labels = F.array(*([F.lit("ALL")] if None in strata else []), *([F.when(as_stratum(df, name).isin(wanted), as_stratum(df, name))] if wanted else []))
    return df.withColumn("strata", F.explode(F.filter(labels, lambda x: x.isNotNull())))


def derived(df: DataFrame, name: str, how: str, id_column: str = "IID", time_column: str | None = None, dosages: DataFrame | None = None) -> DataFrame:
    """Adds one derived column.

    ``baseline_of(y)``: y at the subject's earliest time (maybe missing). ``delta(y)``: last less first in time order,
    if at least two values are present and both ends are. ``slope_of(y ~ x)``: least-squares slope over rows with both,
    at least two of them and not all at one x. ``snp(id)``: a variant's dosage, missing ones at the mean over all
    genotyped subjects of the table; ``dosages`` has IID, ID and dosage. Anything else is an expression over columns.
    Rows without time stand last, ties by input order; rows without a subject get a missing value.
    """
    if m := SNP.match(how):
        return with_snp(df, name, m[1], id_column, dosages)
    m = AGGREGATE.match(how)
    if not m:
        return df.withColumn(name, column(how, df).cast("double"))
    kind, what = m[1], m[2].strip()
    own = Window.partitionBy(id_column)
    known = F.col(id_column).isNotNull()
    if kind == "slope_of":
        if "~" not in what:
            raise ExpressionError("slope_of needs y ~ x")
        y, x = (F.col(c.strip()).try_cast("double") for c in what.split("~", 1))
        x_both = F.when(y.isNotNull(), x)
        usable = (F.regr_count(y, x).over(own) >= 2) & (F.max(x_both).over(own) > F.min(x_both).over(own))
        return df.withColumn(name, F.when(known & usable, F.regr_slope(y, x).over(own)))
    require(df, [what], kind)
    df = with_row_order(df)
    order = ([F.col(time_column).asc_nulls_last()] if time_column else []) + [F.col(ROW)]
    whole = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y = F.col(what).try_cast("double")
    if kind == "baseline_of":
        return df.withColumn(name, F.when(known, F.first(y).over(whole)))
    return df.withColumn(name, F.when(known & (F.count(y).over(own) >= 2), F.last(y).over(whole) - F.first(y).over(whole)))


def with_snp(df: DataFrame, name: str, variant: str, id_column: str, dosages: DataFrame | None) -> DataFrame:
    if dosages is None:
        raise ValueError("snp() needs a genotype set")
    one = dosages.where(F.col("ID") == variant).select(F.col("IID").alias("_iid"), F.col("dosage").alias("_d"), F.lit(True).alias("_g"))
    if one.isEmpty():
        raise ValueError(f"no variant {variant!r}")
    met = df.join(one, F.col(id_column).cast("string") == F.col("_iid"), "left")
    subject = met.where("_g").select("_iid", "_d").distinct().agg(F.avg("_d").alias("_mean"))
    met = met.crossJoin(F.broadcast(subject))  # one row
    return met.withColumn(name, F.when(F.col("_g"), F.coalesce("_d", "_mean"))).drop("_iid", "_d", "_g", "_mean")


def all_derived(df: DataFrame, entries: dict[str, str], **more) -> DataFrame:
    """Derived columns in order; later ones may use earlier ones."""
    for name, how in (entries or {}).items():
        df = derived(df, name, how, **more)
    return df


def complete(df: DataFrame, id_column: str, columns: Iterable[str], by: str | None = "strata") -> DataFrame:
    """Complete cases, one row per subject: the first in input order (within a stratum)."""
    columns = list(columns)
    require(df, [id_column, *columns])
    df = blanks_to_null(with_row_order(df)).na.drop(subset=[id_column, *columns])
    if by and by in df.columns:
        rank = F.row_number().over(Window.partitionBy(by, id_column).orderBy(ROW))
        return df.withColumn("_n", rank).where("_n = 1").drop("_n")
    return first_per_subject(df, id_column)


def large_enough(df: DataFrame, min_n: int) -> DataFrame:
    """Strata with at least ``min_n`` rows."""
    sizes = df.groupBy("strata").count().where(F.col("count") >= min_n).select("strata")
    return df.join(F.broadcast(sizes), "strata", "left_semi")  # one row a stratum


def predictor_columns(df: DataFrame, spec: dict | list) -> list[str]:
    """Tested columns: a list as given, or numeric ones by prefix, suffix or pattern (the first of these that is set)."""
    if isinstance(spec, (list, tuple)):
        require(df, spec, "predictors")
        return list(spec)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != ROW]
    if "list" in spec:
        return predictor_columns(df, spec["list"])
    for key, fits in (("prefix", str.startswith), ("suffix", str.endswith), ("regex", lambda c, p: bool(re.search(p, c)))):
        if spec.get(key):
            found = [c for c in numeric if fits(c, spec[key])]
            break
    else:
        raise ValueError("predictors need a list, prefix, suffix or regex")
    if not found:
        raise ValueError(f"no numeric column for {spec}")
    return found


def unpivoted(df: DataFrame, keep: list[str], predictors: list[str]) -> DataFrame:
    """Long form: ``keep``, predictor, value."""
    doubles = df.select(*keep, *(F.col(c).try_cast("double").alias(c) for c in predictors))
    return doubles.unpivot(keep, predictors, "predictor", "value")


def kinds(long: DataFrame, by: list[str]) -> DataFrame:
    """Each predictor's kind: binary (values 0 and 1 only), dosage (0, 1, 2), other (also without values), and moments."""
    v = F.col("value")
    return long.groupBy(*by).agg(
        F.count(v).alias("n_obs"),
        F.count(F.lit(1)).alias("N"),
        F.avg(v).alias("predictor_mean"),
        F.stddev_samp(v).alias("predictor_sd"),
        F.stddev_pop(v).alias("sd_pop"),
        F.when(F.bool_and(v.isin(0.0, 1.0)), "binary").when(F.bool_and(v.isin(0.0, 1.0, 2.0)), "dosage").otherwise("other").alias("kind"),
    )


def z_scored(long: DataFrame, by: list[str], min_n: int = 30, every: bool = True, binary: bool = False, dosage: bool = False) -> DataFrame:
    """Predictors with enough values and spread, standardised by their kind's rule: ``value`` and ``zscored`` and moments."""
    flags = {"binary": binary, "dosage": dosage}
    z = F.lit(every) & F.when(F.col("kind") == "binary", flags["binary"]).when(F.col("kind") == "dosage", flags["dosage"]).otherwise(True)
    facts = kinds(long, by).where((F.col("n_obs") >= min_n) & (F.col("sd_pop") > 0)).withColumn("zscored", z)
    met = long.join(facts, by)
    return met.withColumn("value", F.when(F.col("zscored"), (F.col("value") - F.col("predictor_mean")) / F.col("predictor_sd")).otherwise(F.col("value")))


def baseline_values(df: DataFrame, id_column: str, time_column: str, columns: list[str]) -> DataFrame:
    """Per subject the earliest present value of each column."""
    at = F.struct(F.col(time_column), F.col(ROW))
    df = with_row_order(df)
    return df.groupBy(id_column).agg(*(F.min_by(c, F.when(F.col(c).isNotNull() & F.col(time_column).isNotNull(), at)).alias(c) for c in columns))


def baseline_rows(df: DataFrame, id_column: str, time_column: str) -> DataFrame:
    """Per subject the row of the earliest time."""
    order = Window.partitionBy(id_column).orderBy(F.col(time_column).asc_nulls_last(), ROW)
    return with_row_order(df).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def subject_slopes(df: DataFrame, id_column: str, y: str, t: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per subject the slope of y on t, its residual sum of squares and the visits used; two visits at least, not all at one time."""
    used = df.where(F.col(y).isNotNull() & F.col(t).isNotNull())
    yc, tc = F.col(y).cast("double"), F.col(t).cast("double")
    out = used.groupBy(*by, id_column).agg(
        F.regr_slope(yc, tc).alias("slope"), F.regr_sxx(yc, tc).alias("sxx"), F.regr_sxy(yc, tc).alias("sxy"), F.regr_syy(yc, tc).alias("syy"), F.count(F.lit(1)).alias("n_visits")
    )
    return out.where((F.col("n_visits") >= 2) & (F.col("sxx") > 1e-9)).withColumn("rss", F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)))
