"""Association scans: one grouped aggregation of predictor values against per-subject columns of a null model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_p, normal_p, t_p
from ..sources.config import ALPHA, GENOMEWIDE
from ..sources.genotypes import MISSING_DOSAGE, BySubject, Packed

#: A predictor this close to the covariates (share of its variation left) can't be told from them.
COLLINEAR, LEAST_INFORMATION = 1e-6, 1e-12
#: A null model's table goes to every task up to this many numbers; a larger one is cut into blocks of samples, which
#: meet groups of about GROUP variants.
SENT, BLOCK, GROUP = 8_000_000, 4096, 1024
#: Dosages that a task works on at once.
AT_ONCE = 1_000_000


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def imputed_sums(values: DataFrame | Packed | BySubject, subjects: DataFrame, on: list[str], by: list[str], xs: list[str], weights: list[str] = ()) -> DataFrame:
    """Sums over all subjects with missing predictor values at the predictor's mean, without making such rows.

    ``values`` has ``by``, ``on`` and value (null: missing); ``subjects`` has strata, ``on`` and per-subject columns.
    For x in ``xs``: S_x = sum of g * x; for w in ``weights``: W_w = sum of w * g * g; also n_obs, mu, N, SS = sum of
    (g - mu)^2 over observed values. Observed sums are partial on the map side; the rest needs totals by stratum.
    Packed values, and those by subject, stay so: no dosage becomes a row.
    """
    every = [*xs, *weights]
    keys = list(dict.fromkeys(["strata", *by]))
    totals = subjects.groupBy("strata").agg(F.count(F.lit(1)).alias("N"), *(F.sum(x).alias(f"_all_{x}") for x in every))
    if isinstance(values, Packed):
        seen = packed_sums(values, subjects, xs, list(weights))
    elif isinstance(values, BySubject):
        seen = subject_sums(values, subjects, xs, list(weights))
    else:
        seen = long_sums(values, subjects, on, keys, xs, list(weights))
    out = seen.where("n_obs > 0").join(F.broadcast(totals), "strata")  # one row a stratum
    rest = lambda x: F.col(f"_all_{x}") - F.col(f"_o_{x}")
    return out.select(
        *keys, "N", "n_obs", "mu", "predictor_sd", "SS",
        *((F.col(f"_g_{x}") + F.col("mu") * rest(x)).alias(f"S_{x}") for x in xs),
        *((F.col(f"_gg_{w}") + F.col("mu") * F.col("mu") * rest(w)).alias(f"W_{w}") for w in weights),
    )


def long_sums(values: DataFrame, subjects: DataFrame, on: list[str], keys: list[str], xs: list[str], weights: list[str]) -> DataFrame:
    """Per predictor and stratum n_obs, mu, predictor_sd, SS and the sums over observed values, from rows."""
    g = F.col("value")
    return (
        values.join(subjects, on)
        .groupBy(*keys)
        .agg(
            F.count(g).alias("n_obs"),
            F.avg(g).alias("mu"),
            F.stddev_samp(g).alias("predictor_sd"),
            (F.var_pop(g) * F.count(g)).alias("SS"),
            *(F.sum(g * F.col(x)).alias(f"_g_{x}") for x in xs),
            *(F.sum(g * g * F.col(w)).alias(f"_gg_{w}") for w in weights),
            *(F.sum(F.when(g.isNotNull(), F.col(x))).alias(f"_o_{x}") for x in [*xs, *weights]),
        )
    )


Columns = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_stratum(subjects: pd.DataFrame, xs: list[str], weights: list[str]) -> Columns:
    """For each stratum of ``subjects`` (strata, at, xs, weights) the columns of dosages it has, xs and weights, as arrays."""
    return {s: (rows["at"].to_numpy(), rows[xs].to_numpy(float), rows[weights].to_numpy(float)) for s, rows in subjects.groupby("strata")}


def block_products(dosages: np.ndarray, columns: Columns) -> Iterator[tuple[str, np.ndarray]]:
    """For each stratum a row of sums for each variant, over AT_ONCE dosages at a time."""
    step = max(1, AT_ONCE // max(len(dosages), 1))
    for stratum, (at, xs, ws) in columns.items():
        out = 0.0
        for k in range(0, len(at), step):
            g, x, w = dosages[:, at[k : k + step]].astype(float), xs[k : k + step], ws[k : k + step]
            seen = (g != MISSING_DOSAGE) & ~np.isnan(g)
            g = np.where(seen, g, 0.0)
            out = out + np.column_stack([seen.sum(1), g.sum(1), (g * g).sum(1), g @ x, (g * g) @ w, seen @ np.column_stack([x, w])])
        yield stratum, out


def sum_names(xs: list[str], weights: list[str]) -> list[str]:
    """What ``block_products`` sums, in its order."""
    return ["_n", "_g", "_gg", *(f"_g_{x}" for x in xs), *(f"_gg_{w}" for w in weights), *(f"_o_{x}" for x in [*xs, *weights])]


def with_facts(sums: DataFrame) -> DataFrame:
    """n_obs, mu, SS and predictor_sd from the sums of values and of their squares."""
    n = F.col("_n")
    spread = F.greatest(F.col("_gg") - F.col("_g") * F.col("_g") / n, F.lit(0.0))
    facts = {"n_obs": n.cast("long"), "mu": F.col("_g") / n, "SS": spread, "predictor_sd": F.sqrt(F.try_divide(spread, n - 1))}
    return sums.where("_n > 0").withColumns(facts).drop("_n", "_g", "_gg")


def subject_sums(values: BySubject, subjects: DataFrame, xs: list[str], weights: list[str]) -> DataFrame:
    """The same sums as ``long_sums`` from one row of values a subject: subjects are met before any value becomes a row, and
    a task adds up its matrix products, so that one row a task, stratum and predictor is shuffled."""
    sums = sum_names(xs, weights)
    schema = "strata string, at int" + "".join(f", {c} double" for c in sums)
    columns = list(dict.fromkeys([*xs, *weights]))
    met = values.rows.select("IID", "values").join(subjects.select("strata", "IID", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns)), "IID").drop("IID")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for s, p in block_products(np.stack(pdf["values"]).T, by_stratum(pdf.assign(at=np.arange(len(pdf))), xs, weights)):
                    total[s] = total[s] + p if s in total else p
        for s, p in total.items():
            yield pd.DataFrame(p, columns=sums).assign(strata=s, at=np.arange(len(p)))[["strata", "at", *sums]]

    out = met.mapInPandas(part, schema).groupBy("strata", "at").agg(*(F.sum(c).alias(c) for c in sums))
    return with_facts(out).join(F.broadcast(values.predictors), "at").drop("at")  # few predictors


def packed_sums(values: Packed, subjects: DataFrame, xs: list[str], weights: list[str]) -> DataFrame:
    """The same sums as ``long_sums`` by matrix products over packed rows.

    A null model's table of at most SENT numbers (counted) goes to every task, and nothing is shuffled. A larger one is
    cut into blocks of BLOCK samples; dosages are cut alike and shuffled once, as arrays, to groups of about GROUP
    variants by block, whose sums are added up. So neither a task nor the driver holds what grows with the subjects.
    """
    sums = sum_names(xs, weights)
    schema = "strata string, variant_idx long" + "".join(f", {c} double" for c in sums)
    placed = subjects.select("strata", "IID", *dict.fromkeys([*xs, *weights])).join(values.samples, "IID").drop("IID")
    rows = values.rows.select("variant_idx", "dosage")

    def of(pdf: pd.DataFrame, table: Columns) -> pd.DataFrame:
        g = np.stack(pdf["dosage"])
        parts = [pd.DataFrame(p, columns=sums).assign(strata=s, variant_idx=pdf["variant_idx"].to_numpy()) for s, p in block_products(g, table)]
        return pd.concat(parts)[["strata", "variant_idx", *sums]] if parts else pd.DataFrame(columns=["strata", "variant_idx", *sums])

    if subjects.count() * len(placed.columns) <= SENT:
        sent = rows.sparkSession.sparkContext.broadcast(by_stratum(placed.withColumnRenamed("sample_idx", "at").toPandas(), xs, list(weights)))

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                step = min(64, max(1, AT_ONCE // max(len(pdf["dosage"].iloc[0]), 1))) if len(pdf) else 1
                for i in range(0, len(pdf), step):
                    yield of(pdf.iloc[i : i + step], sent.value)

        out = rows.mapInPandas(whole, schema)
    else:
        groups = math.ceil(max(rows.count(), 1) / GROUP)
        cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("dosage") / BLOCK).cast("int") - 1), lambda b: F.slice("dosage", b * BLOCK + 1, F.lit(BLOCK)))
        slices = rows.select("variant_idx", F.posexplode(cuts).alias("block", "dosage")).withColumn("group", F.pmod(F.hash("variant_idx"), F.lit(groups)))
        tables = placed.withColumn("block", F.floor(F.col("sample_idx") / BLOCK).cast("int")).withColumn("at", F.col("sample_idx") % BLOCK).drop("sample_idx")
        tables = tables.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def part(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
            return of(pdf, by_stratum(table, xs, weights)) if len(pdf) and len(table) else pd.DataFrame(columns=["strata", "variant_idx", *sums])

        met = slices.groupBy("block", "group").cogroup(tables.groupBy("block", "group")).applyInPandas(part, schema)
        out = met.groupBy("strata", "variant_idx").agg(*(F.sum(c).alias(c) for c in sums))
    return with_facts(out)


def gram(design: DataFrame, columns: list[str], weight: Column | None = None) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per stratum: rows, weighted means, centred products of the columns. Two passes, k * k numbers a stratum."""
    w = F.lit(1.0) if weight is None else weight
    first = design.groupBy("strata").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(c) for c in columns)).collect()
    means = {r["strata"]: (r["n"], np.array([r[c] / r["w"] for c in columns])) for r in first}
    if not means:
        return {}
    centre = F.create_map(*(x for s, (_, m) in means.items() for x in (F.lit(s), F.array(*map(F.lit, m.tolist())))))
    d = [F.col(c) - F.element_at(centre, F.col("strata"))[i] for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    out = {}
    for r in design.groupBy("strata").agg(*(F.sum(w * d[i] * d[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect():
        C = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            C[i, j] = C[j, i] = r[f"p{i}_{j}"]
        out[r["strata"]] = (*means[r["strata"]], C)
    return out


def linear_null(design: DataFrame, y: str, covariates: list[str]) -> DataFrame:
    """Per subject: _y, what covariates leave of y, and _q1 ..., orthonormal covariates; per stratum _yty.

    The columns come from the eigenvectors of the covariates' centred products, so dependent ones do no harm.
    """
    columns = [*covariates, y]
    k = len(covariates)
    rows = []
    for s, (n, m, C) in gram(design, columns).items():
        values, vectors = np.linalg.eigh(C[:k, :k]) if k else (np.zeros(0), np.zeros((0, 0)))
        keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
        T = np.zeros((k, k))
        T[keep] = (vectors[:, keep] / np.sqrt(values[keep])).T
        b = T @ C[:k, k]
        rows.append((s, m.tolist(), T.ravel().tolist(), b.tolist(), float(C[k, k] - b @ b)))
    facts = design.sparkSession.createDataFrame(rows, "strata string, _m array<double>, _t array<double>, _b array<double>, _yty double")
    met = design.join(F.broadcast(facts), "strata")  # one row a stratum
    centred = [F.col(c) - F.col("_m")[i] for i, c in enumerate(columns)]
    met = met.withColumns({f"_q{j + 1}": total([F.col("_t")[j * k + i] * centred[i] for i in range(k)]) for j in range(k)})
    return met.withColumn("_y", centred[k] - total([F.col("_b")[j] * F.col(f"_q{j + 1}") for j in range(k)])).drop("_m", "_t", "_b")


def linear_scan(values: DataFrame | Packed | BySubject, null: DataFrame, covariates: int, on: list[str], by: list[str]) -> DataFrame:
    """beta, SE, t, dof and P of a linear model for every predictor and stratum; null where it can't be told apart."""
    qs = [f"_q{j + 1}" for j in range(covariates)]
    sums = imputed_sums(values, null.select("strata", *[c for c in on if c != "strata"], "_y", *qs), on, by, ["_y", *qs])
    yty = null.groupBy("strata").agg(F.first("_yty").alias("_yty"))
    return linear_statistics(sums.join(yty, "strata"), covariates)


def linear_statistics(sums: DataFrame, covariates: int) -> DataFrame:
    qs = [f"S__q{j + 1}" for j in range(covariates)]
    gg = F.col("SS") - total([F.col(q) * F.col(q) for q in qs])
    dof = (F.col("N") - (covariates + 1) - 1).cast("long")
    ok = (F.col("SS") > 0) & (F.col("_gg") > COLLINEAR * F.col("SS"))
    beta = F.when(ok, F.col("S__y") / F.col("_gg"))
    rss = F.greatest(F.col("_yty") - F.col("beta") * F.col("S__y"), F.lit(0.0))
    return (
        sums.withColumn("_gg", gg)
        .withColumn("dof", dof)
        .withColumn("beta", beta)
        .withColumn("SE", F.sqrt(rss / F.greatest(F.col("dof"), F.lit(1)) / F.col("_gg")))
        .withColumn("t", F.try_divide(F.col("beta"), F.col("SE")))
        .withColumn("P", t_p(F.col("t"), F.greatest(F.col("dof"), F.lit(1))))
        .drop("_gg", "_yty", "S__y", *qs)
    )


def logistic_scan(values: DataFrame | Packed | BySubject, null: DataFrame, columns: int, on: list[str], by: list[str]) -> DataFrame:
    """Score test: beta = U / V, SE = V^-1/2, P of U * U / V. ``null`` has _r, _w and _wq0 ... (weights times weighted-
    orthonormal design columns, the constant one included)."""
    qs = [f"_wq{j}" for j in range(columns)]
    sums = imputed_sums(values, null.select("strata", *[c for c in on if c != "strata"], "_r", "_w", *qs), on, by, ["_r", *qs], ["_w"])
    v = F.col("W__w") - total([F.col(f"S_{q}") * F.col(f"S_{q}") for q in qs])
    out = sums.withColumn("U", F.col("S__r")).withColumn("V", F.when(v > LEAST_INFORMATION, v))
    out = out.withColumn("beta", F.col("U") / F.col("V")).withColumn("SE", 1 / F.sqrt("V")).withColumn("chi2", F.col("U") * F.col("U") / F.col("V"))
    return out.withColumn("P", chi2_p(F.col("chi2"), F.lit(1.0))).drop("W__w", "S__r", *(f"S_{q}" for q in qs))


def gallop_scan(values: DataFrame | Packed | BySubject, null: DataFrame, a_inverse: dict[str, np.ndarray], on: list[str], by: list[str]) -> DataFrame:
    """Main effect and effect on the slope of every predictor in the mixed model.

    Per subject ``null`` has P (_p11, _p12, _p22), q (_q1, _q2) and M (_m1_j, _m2_j); ``a_inverse`` is the inverse
    information of the fixed effects by stratum. The two effects solve a 2 x 2 system in closed form.
    """
    p = next(iter(a_inverse.values())).shape[0]
    ms = [f"_m{r}_{j}" for r in (1, 2) for j in range(p)]
    ps = ["_p11", "_p12", "_p22"]
    sums = imputed_sums(values, null.select("strata", *[c for c in on if c != "strata"], *ps, "_q1", "_q2", *ms), on, by, ["_q1", "_q2", *ms], ps)
    inverse = F.create_map(*(x for s, a in a_inverse.items() for x in (F.lit(s), F.array(*map(F.lit, a.ravel().tolist())))))
    sums = sums.withColumn("_a", F.element_at(inverse, F.col("strata")))
    bab = lambda r, s: total([F.col(f"S__m{r}_{i}") * F.col("_a")[i * p + j] * F.col(f"S__m{s}_{j}") for i in range(p) for j in range(p)])
    out = sums.withColumns({"_i11": F.col("W__p11") - bab(1, 1), "_i12": F.col("W__p12") - bab(1, 2), "_i22": F.col("W__p22") - bab(2, 2)})
    det = F.col("_i11") * F.col("_i22") - F.col("_i12") * F.col("_i12")
    ok = (F.abs("_det") > 1e-12) & (F.col("_i22") / F.col("_det") > 0) & (F.col("_i11") / F.col("_det") > 0)
    out = out.withColumn("_det", det).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    b1 = (F.col("_i22") * F.col("S__q1") - F.col("_i12") * F.col("S__q2")) / F.col("_det")
    b2 = (F.col("_i11") * F.col("S__q2") - F.col("_i12") * F.col("S__q1")) / F.col("_det")
    out = out.withColumns(
        {
            "beta_SNP": F.when(F.col("_ok"), b1), "SE_SNP": F.when(F.col("_ok"), F.sqrt(F.col("_i22") / F.col("_det"))),
            "beta_SNPxTIME": F.when(F.col("_ok"), b2), "SE_SNPxTIME": F.when(F.col("_ok"), F.sqrt(F.col("_i11") / F.col("_det"))),
        }
    )
    out = out.withColumns({f"P_{t}": normal_p(F.try_divide(F.col(f"beta_{t}"), F.col(f"SE_{t}"))) for t in ("SNP", "SNPxTIME")})
    return out.select(*dict.fromkeys(["strata", *by]), "N", "n_obs", "mu", "predictor_sd", *(f"{k}_{t}" for t in ("SNP", "SNPxTIME") for k in ("beta", "SE", "P")))


def without_failures(df: DataFrame) -> DataFrame:
    """Rows with 0 < P <= 1 and, where beta is finite, a finite positive SE. A P that underflows to zero is left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    return df.where(finite("P") & (F.col("P") > 0) & (F.col("P") <= 1) & (~finite("beta") | (finite("SE") & (F.col("SE") > 0))))


def thresholds(df: DataFrame, by: list[str]) -> DataFrame:
    """bonferroni_threshold over the rows of ``by``, significant, genomewide_sig."""
    sizes = df.groupBy(*by).agg((F.lit(ALPHA) / F.count(F.lit(1))).alias("bonferroni_threshold"))
    out = df.join(F.broadcast(sizes), by)  # one row a run and stratum
    return out.withColumns({"significant": F.coalesce(F.col("P") < F.col("bonferroni_threshold"), F.lit(False)), "genomewide_sig": F.coalesce(F.col("P") < GENOMEWIDE, F.lit(False))})
