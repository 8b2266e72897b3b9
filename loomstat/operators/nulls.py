"""Null models: logistic, Cox and the random intercept and slope model, fitted by distributed sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import written
from .running import ranged, running


def summed(df: DataFrame, f: Callable[[str, pd.DataFrame], np.ndarray]) -> dict[str, np.ndarray]:
    """Per stratum the sum of ``f`` (a vector) over all rows: one vector a task and stratum reaches the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for s, rows in pdf.groupby("strata"):
                v = f(s, rows)
                sums[s] = sums[s] + v if s in sums else v
        if sums:
            yield pd.DataFrame({"strata": list(sums), "v": list(sums.values())})

    out: dict[str, np.ndarray] = {}
    for r in df.mapInPandas(part, "strata string, v array<double>").collect():
        v = np.array(r["v"])
        out[r["strata"]] = out[r["strata"]] + v if r["strata"] in out else v
    return out


def design_matrix(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), *(rows[c].to_numpy(float) for c in columns)])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic_null(design: DataFrame, y: str, covariates: list[str], rounds: int = 100) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(subjects with _p, _r, _w and _wq0 ..., coefficients by stratum): reweighted least squares until no coefficient
    moves by 1e-8. Probabilities are kept 1e-8 off 0 and 1; a singular step ends the fit."""
    k = len(covariates) + 1
    slim = design.select("strata", y, *covariates)
    b: dict[str, np.ndarray] = {}
    done: set[str] = set()
    information: dict[str, np.ndarray] = {}

    def step(s: str, rows: pd.DataFrame) -> np.ndarray:
        X, t = design_matrix(rows, covariates), rows[y].to_numpy(float)
        p = np.clip(logistic(X @ b.get(s, np.zeros(k))), 1e-8, 1 - 1e-8)
        w = p * (1 - p)
        return np.concatenate([(X.T @ (t - p)), ((X * w[:, None]).T @ X).ravel()])

    for _ in range(rounds):
        for s, v in summed(slim, step).items():
            information[s] = v[k:].reshape(k, k)
            if s in done:
                continue
            try:
                move = np.linalg.solve(information[s], v[:k])
            except np.linalg.LinAlgError:
                done.add(s)
                continue
            b[s] = b.get(s, np.zeros(k)) + move
            if np.abs(move).max() < 1e-8:
                done.add(s)
        if len(done) == len(information):
            break
    information = {s: v[k:].reshape(k, k) for s, v in summed(slim, step).items()}
    # columns that are orthonormal under the weights: X times the inverse root of the information
    turn = {}
    for s, info in information.items():
        values, vectors = np.linalg.eigh(info)
        turn[s] = vectors / np.sqrt(np.maximum(values, 1e-300))
    coefficients = {s: b.get(s, np.zeros(k)) for s in information}
    schema = design.select("strata", "IID").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for s, rows in pdf.groupby("strata"):
                X = design_matrix(rows, covariates)
                p = np.clip(logistic(X @ coefficients[s]), 1e-8, 1 - 1e-8)
                w = p * (1 - p)
                WQ = (X * w[:, None]) @ turn[s]
                parts.append(rows[["strata", "IID"]].assign(_y=rows[y].astype(float), _p=p, _r=rows[y] - p, _w=w, **{f"_wq{j}": WQ[:, j] for j in range(k)}))
            if parts:
                yield pd.concat(parts)

    out = design.select("strata", "IID", y, *covariates).mapInPandas(apply, f"{schema}, _y double, _p double, _r double, _w double" + "".join(f", _wq{j} double" for j in range(k)))
    return out, coefficients


#: Deaths whose terms stand in memory at once.
TIED = 1_000_000


def efron(d: np.ndarray, all_: list[np.ndarray], dead: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What risk sets take from the score, and the information, by Efron's rule for ties, of many event times at once.

    At a time with ``d`` deaths the m-th of them faces the risk set's sums (of r, r x and r x x') less m / d of the
    deaths' own. All these terms are linear or quadratic in m / d, so five sums of inverse powers a time are enough:
    no term has a vector of its own.
    """
    (c0, c1, c2), (d0, d1, d2) = all_, dead
    d = d.astype(np.int64)
    A = np.zeros((5, len(d)))
    ends = np.cumsum(d)
    for start in range(0, int(ends[-1]) if len(d) else 0, TIED):
        at = np.arange(start, min(start + TIED, int(ends[-1])))
        time = np.searchsorted(ends, at, side="right")
        f = (at - (ends[time] - d[time])) / d[time]
        s = 1 / (c0[time] - f * d0[time])
        A += np.stack([np.bincount(time, x, len(d)) for x in (s, f * s, s * s, f * s * s, f * f * s * s)])
    one, f1, sq, f_sq, f2_sq = A
    u = one @ c1 - f1 @ d1
    cross = np.einsum("n,ni,nj->ij", f_sq, c1, d1)
    outer = np.einsum("n,ni,nj->ij", sq, c1, c1) - cross - cross.T + np.einsum("n,ni,nj->ij", f2_sq, d1, d1)
    return u, np.tensordot(one, c2, 1) - np.tensordot(f1, d2, 1) - outer


def cox_null(design: DataFrame, duration: str, event: str, covariates: list[str], rounds: int = 50) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(subjects with _m, the martingale residual, and _events by stratum; coefficients).

    Newton steps on the partial likelihood with Efron's rule for ties. Sums over risk sets are running sums over times
    from the last; the baseline hazard is Breslow's at the fit. Without covariates the residuals are event less
    cumulative hazard.
    """
    k = len(covariates)
    means = {s: m for s, (_, m, _) in _gram(design, covariates).items()} if k else {}
    strata = [r["strata"] for r in design.select("strata").distinct().collect()]  # one row a stratum
    b = {s: np.zeros(k) for s in strata}

    def risk() -> "F.Column":
        if not k:
            return F.lit(1.0)
        lit = lambda d: F.create_map(*(x for s in strata for x in (F.lit(s), F.array(*map(F.lit, np.asarray(d[s], float).tolist())))))
        beta, mean = F.element_at(lit(b), F.col("strata")), F.element_at(lit(means), F.col("strata"))
        return F.exp(sum((beta[i] * (F.col(c) - mean[i]) for i, c in enumerate(covariates)), F.lit(0.0)))

    t, e = F.col(duration).cast("double"), F.col(event).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # times don't move from round to round, so neither do their ranges
    base = written(design.withColumns({"_t": t, "_e": e}), "survival")
    times = ranged(base.select("strata", "_t").distinct(), ["strata"], ["_t"])
    base = written(base.join(times.drop("_row"), ["strata", "_t"]), "survival")

    def by_time() -> DataFrame:
        r = F.col("_risk")
        columns = {"r": r, **{f"r{i}": r * F.col(c) for i, c in enumerate(covariates)}, **{f"r{i}_{j}": r * F.col(covariates[i]) * F.col(covariates[j]) for i, j in pairs}}
        sums = [F.sum(v).alias(f"_s_{n}") for n, v in columns.items()] + [F.sum(v * F.col("_e")).alias(f"_d_{n}") for n, v in columns.items()]
        sums += [F.sum("_e").alias("_d")] + [F.sum(F.col("_e") * F.col(c)).alias(f"_x{i}") for i, c in enumerate(covariates)]
        return base.withColumn("_risk", risk()).groupBy("strata", "_t", "_range").agg(*sums)

    def at_risk() -> DataFrame:
        sums = by_time()
        names = [c for c in sums.columns if c.startswith("_s_")]
        return running(sums, ["strata"], [F.desc("_t")], {c: "_c_" + c[3:] for c in names}, backwards=True)

    def step(s: str, rows: pd.DataFrame) -> np.ndarray:
        rows = rows[rows["_d"] > 0]
        column = lambda c: rows[c].to_numpy(float)

        def sums(kind: str) -> list[np.ndarray]:
            two = np.empty((len(rows), k, k))
            for i, j in pairs:
                two[:, i, j] = two[:, j, i] = column(f"{kind}_r{i}_{j}")
            return [column(f"{kind}_r"), np.stack([column(f"{kind}_r{i}") for i in range(k)], 1), two]

        u, info = efron(column("_d"), sums("_c"), sums("_d"))
        return np.concatenate([np.stack([column(f"_x{i}").sum() for i in range(k)]) - u, info.ravel()])

    for _ in range(rounds if k else 0):
        largest = 0.0
        for s, v in summed(at_risk(), step).items():
            move = np.linalg.solve(v[k:].reshape(k, k) + 1e-12 * np.eye(k), v[:k])
            b[s] = b[s] + move
            largest = max(largest, float(np.abs(move).max()))
        if largest < 1e-8:
            break
    jumps = at_risk().withColumn("_h", F.col("_d") / F.col("_c_r")).join(times.drop("_row"), ["strata", "_t"])
    hazard = running(jumps, ["strata"], ["_t"], {"_h": "_cum"}).select("strata", "_t", "_cum")
    out = base.withColumn("_risk", risk()).join(hazard, ["strata", "_t"]).withColumn("_m", F.col("_e") - F.col("_risk") * F.col("_cum"))
    return out.drop("_t", "_e", "_risk", "_cum", "_range"), b


def _gram(design: DataFrame, columns: list[str]):
    from .scans import gram

    return gram(design, columns)


@dataclass
class Mixed:
    """A fitted random intercept and slope model of one stratum."""

    alpha: np.ndarray
    D: np.ndarray
    sigma2: float
    converged: bool
    rounds: int
    a_inverse: np.ndarray | None = None


def subject_products(visits: DataFrame, y: str, t: str, covariates: list[str], by: list[str]) -> DataFrame:
    """Per subject all that the mixed model needs of its visits: products of Z = [1, t], X = [1, covariates, t] and y."""
    x = ["_one", *covariates, t]
    v = visits.withColumn("_one", F.lit(1.0))
    col = lambda c: F.col(c).cast("double")
    sums = {"n": F.count(F.lit(1)).cast("double"), "yy": F.sum(col(y) * col(y))}
    for i, z in enumerate(("_one", t)):
        sums[f"zy{i}"] = F.sum(col(z) * col(y))
        sums |= {f"zx{i}_{j}": F.sum(col(z) * col(c)) for j, c in enumerate(x)}
    sums["tt"] = F.sum(col(t) * col(t))
    sums |= {f"xy{j}": F.sum(col(c) * col(y)) for j, c in enumerate(x)}
    sums |= {f"xx{i}_{j}": F.sum(col(x[i]) * col(x[j])) for i in range(len(x)) for j in range(i, len(x))}
    return v.groupBy(*by).agg(*(f.alias(n) for n, f in sums.items()))


class Products:
    """A batch of subjects' products as arrays."""

    def __init__(self, rows: pd.DataFrame, p: int):
        g = lambda c: rows[c].to_numpy(float)
        self.n, self.yy, N = g("n"), g("yy"), len(rows)
        self.zz = np.empty((N, 2, 2))
        self.zz[:, 0, 0], self.zz[:, 0, 1], self.zz[:, 1, 0], self.zz[:, 1, 1] = self.n, g(f"zx0_{p - 1}"), g(f"zx0_{p - 1}"), g("tt")
        self.zy = np.stack([g("zy0"), g("zy1")], 1)
        self.zx = np.stack([np.stack([g(f"zx{i}_{j}") for j in range(p)], 1) for i in range(2)], 1)
        self.xy = np.stack([g(f"xy{j}") for j in range(p)], 1)
        self.xx = np.empty((N, p, p))
        for i in range(p):
            for j in range(i, p):
                self.xx[:, i, j] = self.xx[:, j, i] = g(f"xx{i}_{j}")

    def inverse(self, D: np.ndarray, s2: float) -> np.ndarray:
        """K with V^-1 = (I - Z K Z') / s2 for every subject: K = (s2 D^-1 + Z'Z)^-1 = D (s2 I + Z'Z D)^-1, also for a singular D."""
        return D @ two_by_two_inverse(s2 * np.eye(2) + self.zz @ D)[0]

    def weighted(self, left: np.ndarray, middle: np.ndarray, right: np.ndarray, K: np.ndarray, s2: float) -> np.ndarray:
        """A' V^-1 B from A'Z, A'B and Z'B."""
        return (middle - left @ K @ right) / s2


#: How the covariance of subjects changes with D's three entries.
_ENTRIES = np.array([[[1.0, 0.0], [0.0, 0.0]], [[0.0, 1.0], [1.0, 0.0]], [[0.0, 0.0], [0.0, 1.0]]])


def two_by_two_inverse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and determinants of many 2 x 2 matrices, without a call for each."""
    det = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
    if not det.all():
        raise np.linalg.LinAlgError("Singular matrix")
    out = np.empty_like(a)
    out[:, 0, 0], out[:, 0, 1], out[:, 1, 0], out[:, 1, 1] = a[:, 1, 1], -a[:, 0, 1], -a[:, 1, 0], a[:, 0, 0]
    return out / det[:, None, None], det


def mixed_sums(q: Products, D: np.ndarray, s2: float, p: int) -> np.ndarray:
    """All that a round needs of a batch of subjects, summed: products under V^-1 and V^-2, and their traces."""
    K = q.inverse(D, s2)
    K2 = 2 * K - K @ q.zz @ K  # V^-2 = (I - Z K2 Z') / s2^2
    xz, zy, xy = q.zx.transpose(0, 2, 1), q.zy[..., None], q.xy[..., None]
    trace = lambda k: np.einsum("nij,nji->n", k, q.zz)
    P, u, M = q.weighted(q.zz, q.zz, q.zz, K, s2), q.weighted(q.zz, zy, zy, K, s2)[..., 0], q.weighted(q.zz, q.zx, q.zx, K, s2)
    yy = q.yy[:, None, None]
    determinant = q.n * np.log(s2) + np.log(two_by_two_inverse(np.eye(2) + q.zz @ D / s2)[1])
    flat = lambda x: x.reshape(len(x), -1)
    summed_outer = lambda a, b: (flat(a).T @ flat(b))[None]  # noqa: E731  # no product by subject is kept
    parts = [
        q.weighted(xz, q.xx, q.zx, K, s2), q.weighted(xz, xy, zy, K, s2), q.weighted(zy.transpose(0, 2, 1), yy, zy, K, s2), determinant,
        summed_outer(u, u), summed_outer(u, M), summed_outer(M, M),
        q.weighted(zy.transpose(0, 2, 1), yy, zy, K2, s2 * s2), q.weighted(xz, xy, zy, K2, s2 * s2), q.weighted(xz, q.xx, q.zx, K2, s2 * s2),
        (q.n - trace(K)) / s2, (q.n - trace(K2)) / s2**2, P, summed_outer(P, P), q.weighted(q.zz, q.zz, q.zz, K2, s2 * s2),
    ]
    return np.concatenate([x.sum(0).ravel() for x in parts])


@dataclass
class Round:
    """The profile likelihood at some components, and where to go from there: by Fisher scoring, and by EM."""

    alpha: np.ndarray
    a_inverse: np.ndarray
    likelihood: float
    scoring: tuple[np.ndarray, float]
    em: tuple[np.ndarray, float]

    @classmethod
    def of(cls, v: np.ndarray, D: np.ndarray, s2: float, p: int, n: float, subjects: float) -> Round:
        shapes = [(p, p), (p,), (), (), (2, 2), (2, 2, p), (2, p, 2, p), (), (p,), (p, p), (), (), (2, 2), (2, 2, 2, 2), (2, 2)]
        at = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
        if not np.isfinite(v).all():
            raise ArithmeticError("sums that are not finite")
        A, b, yy, determinant, uu, um, mm, yy2, xy2, xx2, t1, t2, P, PP, Z2 = (v[i:j].reshape(x) for i, j, x in zip(at, at[1:], shapes, strict=False))
        inverse = np.linalg.inv(A)
        a = inverse @ b
        cross = um @ a
        ww = uu - cross - cross.T + np.einsum("ijkl,j,l->ik", mm, a, a)  # of Z'V^-1 r
        rr2 = yy2 - 2 * xy2 @ a + a @ xx2 @ a
        score = np.append(np.einsum("kij,ji->k", _ENTRIES, ww - P), rr2 - t1) / 2
        info = np.empty((4, 4))
        info[:3, :3] = np.einsum("jab,bcda,kcd->jk", _ENTRIES, PP, _ENTRIES) / 2
        info[:3, 3] = info[3, :3] = np.einsum("kij,ji->k", _ENTRIES, Z2) / 2
        info[3, 3] = t2 / 2
        step = np.linalg.lstsq(info, score, rcond=None)[0]
        move, part = np.einsum("k,kij->ij", step[:3], _ENTRIES), 1.0
        while part > 1e-9 and (np.linalg.eigvalsh(D + part * move)[0] <= 1e-3 * np.linalg.eigvalsh(D)[0] or s2 + part * step[3] <= s2 / 10):
            part /= 2  # components stay positive; one that belongs at zero gets there by halves
        em = D + D @ (ww - P) @ D / subjects
        em = (em + em.T) / 2, max(s2 + s2 * s2 / n * float(rr2 - t1), 1e-8)
        return cls(a, inverse, -float(determinant + yy - b @ a) / 2, (D + part * move, max(float(s2 + part * step[3]), 1e-8)), em)


def fit_mixed(products: DataFrame, p: int, rounds: int = 500, tol: float = 1e-5, failed: dict[str, str] | None = None) -> dict[str, Mixed]:
    """Maximum likelihood for every stratum at once; each round is one pass over subjects' products, one vector a task.

    Starts: least squares for the fixed effects; per subject a ridge (1e-6) fit of the residuals on [1, t] gives D, as
    the covariance of its coefficients plus 1e-4, and the error variance over subjects with more than two visits.
    A round solves the fixed effects at the current components and moves D and the error variance by Fisher scoring,
    or, where that lowered the likelihood, by an EM step, which never does. It ends when no component moves by ``tol``
    times the larger of itself and one. So a fit takes some ten passes where EM alone takes hundreds.

    A stratum whose fit fails numerically is an error, or, with ``failed``, is left out and stands there with the reason.
    """
    lost: dict[str, str] = {} if failed is None else failed

    def tried(s: str, f: Callable, *args):
        try:
            return f(*args)
        except (np.linalg.LinAlgError, ArithmeticError) as e:
            if failed is None:
                raise
            lost[s] = str(e)
            return None

    first = summed(products, lambda s, r: (lambda q: np.concatenate([q.xx.sum(0).ravel(), q.xy.sum(0), [q.yy.sum(), q.n.sum(), len(r)]]))(Products(r, p)))
    alpha = {s: np.linalg.lstsq(v[: p * p].reshape(p, p), v[p * p : p * p + p], rcond=None)[0] for s, v in first.items()}
    size = {s: (v[-2], v[-1]) for s, v in first.items()}

    def start(s: str, rows: pd.DataFrame) -> np.ndarray:
        q, a = Products(rows, p), alpha[s]
        zr = q.zy - q.zx @ a
        rr = q.yy - 2 * q.xy @ a + np.einsum("i,nij,j->n", a, q.xx, a)
        c = np.linalg.solve(q.zz + 1e-6 * np.eye(2), zr[..., None])[..., 0]
        left = np.maximum(rr - 2 * (c * zr).sum(1) + np.einsum("ni,nij,nj->n", c, q.zz, c), 0)
        many = q.n > 2
        variance = left[many] / np.maximum(q.n[many] - 2, 1)
        return np.concatenate([c.sum(0), (c[:, :, None] * c[:, None, :]).sum(0).ravel(), [variance.sum(), many.sum(), rr.sum()]])

    D, s2 = {}, {}
    for s, v in summed(products, start).items():
        n = size[s][1]
        m = v[:2] / n
        D[s] = (v[2:6].reshape(2, 2) - n * np.outer(m, m)) / max(n - 1, 1) + 1e-4 * np.eye(2)
        s2[s] = max(v[6] / v[7], 1e-8) if v[7] else max(0.5 * v[8] / size[s][0], 1e-4)
    took, done = dict.fromkeys(D, 0), set()

    def sums(s: str, rows: pd.DataFrame) -> np.ndarray:
        return mixed_sums(Products(rows, p), D[s], s2[s], p)

    before: dict[str, Round] = {}
    for _ in range(rounds):
        over = [*done, *lost]
        active = products.where(~F.col("strata").isin(over)) if over else products
        for s, v in summed(active, sums).items():
            now, was = tried(s, Round.of, v, D[s], s2[s], p, *size[s]), before.pop(s, None)
            if now is None:
                continue
            if was is not None and now.likelihood < was.likelihood - 1e-9 * abs(was.likelihood):
                D[s], s2[s] = was.em
                continue
            old = np.append(D[s].ravel(), s2[s])
            D[s], s2[s] = now.scoring
            before[s], took[s] = now, took[s] + 1
            new = np.append(D[s].ravel(), s2[s])
            if (np.abs(new - old) < tol * np.maximum(1, np.abs(old).max())).all():
                done.add(s)
        if len(done) + len(lost) == len(D):
            break
    kept = products.where(~F.col("strata").isin(list(lost))) if lost else products
    final = {s: tried(s, Round.of, v, D[s], s2[s], p, *size[s]) for s, v in summed(kept, sums).items()}
    return {s: Mixed(f.alpha, D[s], s2[s], s in done, took[s], f.a_inverse) for s, f in final.items() if f is not None}


def gallop_null(products: DataFrame, fits: dict[str, Mixed], p: int) -> DataFrame:
    """Per subject P = Z'V^-1 Z, q = Z'V^-1 r and M = Z'V^-1 X, and the random effects' predictions _b0, _b1."""
    schema = "strata string, IID string, _n double, _p11 double, _p12 double, _p22 double, _q1 double, _q2 double, _b0 double, _b1 double" + "".join(f", _m{r}_{j} double" for r in (1, 2) for j in range(p))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, rows in pdf.groupby("strata"):
                f, q = fits[s], Products(rows, p)
                K = q.inverse(f.D, f.sigma2)
                P = q.weighted(q.zz, q.zz, q.zz, K, f.sigma2)
                zr = q.zy - q.zx @ f.alpha
                v = q.weighted(q.zz, zr[..., None], zr[..., None], K, f.sigma2)[..., 0]
                M = q.weighted(q.zz, q.zx, q.zx, K, f.sigma2)
                b = np.einsum("nij,nj->ni", K, zr)
                out = {"strata": s, "IID": rows["IID"].astype(str), "_n": q.n, "_p11": P[:, 0, 0], "_p12": P[:, 0, 1], "_p22": P[:, 1, 1], "_q1": v[:, 0], "_q2": v[:, 1], "_b0": b[:, 0], "_b1": b[:, 1]}
                yield pd.DataFrame({**out, **{f"_m{r}_{j}": M[:, r - 1, j] for r in (1, 2) for j in range(p)}})

    return products.mapInPandas(apply, schema)
