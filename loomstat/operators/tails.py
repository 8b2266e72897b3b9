"""Second looks at the tail of a scan: saddlepoint P-values, penalised logistic refits, Cox refits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_sf
from ..sources.genotypes import MISSING_DOSAGE, Packed
from .nulls import efron, logistic, summed

#: Where the saddlepoint is sought, and how near is near enough.
BRACKET, SADDLE_TOL, SADDLE_ROUNDS = 100.0, 1e-8, 60


def saddlepoints(k1: Callable, k2: Callable, s: np.ndarray) -> np.ndarray:
    """For each row the t with K'(t) = s inside the bracket, NaN where it is outside: Newton steps of all rows together,
    halving where one leaves its interval. ``k1`` and ``k2`` take t and the rows that are still sought."""
    every = np.arange(len(s))
    low, high = np.full(len(s), -BRACKET), np.full(len(s), BRACKET)
    t = np.where((k1(low, every) <= s) & (s <= k1(high, every)), 0.0, np.nan)
    left = np.flatnonzero(~np.isnan(t))
    for _ in range(SADDLE_ROUNDS):
        gap = k1(t[left], left) - s[left]
        going = np.abs(gap) >= SADDLE_TOL
        left, gap = left[going], gap[going]
        if not len(left):
            break
        above = gap > 0
        high[left[above]], low[left[~above]] = t[left[above]], t[left[~above]]
        slope = k2(t[left], left)
        step = t[left] - np.divide(gap, slope, out=np.full(len(left), np.nan), where=slope > 0)
        t[left] = np.where((low[left] < step) & (step < high[left]), step, (low[left] + high[left]) / 2)
    return t


def tail_ps(t: np.ndarray, s: np.ndarray, k0: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Lugannani and Rice's tail, doubled; NaN where the formula has no value, so that the score P stays."""
    with np.errstate(all="ignore"):
        square = 2 * (t * s - k0)
        w, v = np.sign(t) * np.sqrt(square), t * np.sqrt(k2)
        upper = norm_sf(w) + np.exp(-w * w / 2) / np.sqrt(2 * np.pi) * (1 / v - 1 / w)
        fine = (np.abs(t) >= 1e-7) & (k2 > 0) & (square > 0) & (np.abs(w) >= 1e-7) & (upper > 0) & (upper < 1)
        return np.where(fine, 2 * np.minimum(upper, 1 - upper), np.nan)


def logistic_ps(G: np.ndarray, p: np.ndarray, Q: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Saddlepoint P of logistic scores, one for each row of ``G``: the exact generating function of Bernoulli sums, rows
    residualised under the weights."""
    w = p * (1 - p)
    R = G - (Q @ np.linalg.lstsq((Q * w[:, None]).T @ Q, (Q * w[:, None]).T @ G.T, rcond=None)[0]).T
    odds = np.log(p) - np.log1p(-p)
    tilted = lambda t, at: logistic(odds + R[at] * t[:, None])

    def k1(t: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (R[at] * (tilted(t, at) - p)).sum(1)

    def k2(t: np.ndarray, at: np.ndarray) -> np.ndarray:
        q = tilted(t, at)
        return (R[at] ** 2 * q * (1 - q)).sum(1)

    t, every = saddlepoints(k1, k2, scores), np.arange(len(G))
    x = R * np.nan_to_num(t)[:, None]
    k0 = (np.logaddexp(np.log1p(-p), np.log(p) + x) - x * p).sum(1)
    return tail_ps(t, scores, k0, k2(np.nan_to_num(t), every))


def spa_logistic(g: np.ndarray, p: np.ndarray, Q: np.ndarray, score: float) -> float:
    """``logistic_ps`` of one predictor."""
    return float(logistic_ps(g[None], p, Q, np.array([score]))[0])


#: How far the grid of an empirical generating function reaches, its points, and residuals met at once.
REACH, POINTS, RESIDUALS = 30.0, 4001, 256


class Empirical:
    """The cumulant generating function of centred residuals on a grid, read by linear interpolation, flat beyond it."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray, k2: np.ndarray):
        self.grid, self.k0, self.k1, self.k2 = np.linspace(-REACH, REACH, POINTS), k0, k1, k2

    @classmethod
    def of(cls, subjects: DataFrame, residual: str) -> dict[str, tuple[float, Empirical]]:
        """(mean residual, law) of each stratum. Sums over all subjects by partition; POINTS numbers of them are returned."""
        facts = {r["strata"]: r for r in subjects.groupBy("strata").agg(F.count(residual).alias("n"), F.avg(residual).alias("m"), F.min(residual).alias("low"), F.max(residual).alias("high")).collect()}
        grid = np.linspace(-REACH, REACH, POINTS)
        top = {s: np.maximum(grid * (r["low"] - r["m"]), grid * (r["high"] - r["m"])) for s, r in facts.items()}
        centre = {s: r["m"] for s, r in facts.items()}

        def part(s: str, rows: pd.DataFrame) -> np.ndarray:
            out = np.zeros((3, POINTS))
            every = rows[residual].dropna().to_numpy(float) - centre[s]
            for i in range(0, len(every), RESIDUALS):
                m = every[i : i + RESIDUALS]
                e = np.exp(np.outer(grid, m) - top[s][:, None])
                out += e.sum(1), e @ m, e @ (m * m)
            return out.ravel()

        laws = {}
        for s, v in summed(subjects.select("strata", residual), part).items():
            zero, one, two = v.reshape(3, POINTS)
            laws[s] = (centre[s], cls(np.log(zero / facts[s]["n"]) + top[s], one / zero, two / zero - (one / zero) ** 2))
        return laws

    def sums(self, G: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What the subjects of ``G`` (residualised) add to K, K' and K'' of each row's score at its ``t``."""
        x = t[:, None] * G
        k0, k1, k2 = (np.interp(x, self.grid, table) for table in (self.k0, self.k1, self.k2))
        return np.stack([k0.sum(1), (G * k1).sum(1), (G * G * k2).sum(1)])

    def ps(self, G: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Saddlepoint P of scores, one for each row of ``G`` (residualised)."""
        at = lambda table, t, rows: np.interp(t[:, None] * G[rows], self.grid, table)
        second = lambda t, rows: (G[rows] ** 2 * at(self.k2, t, rows)).sum(1)
        t, every = saddlepoints(lambda t, rows: (G[rows] * at(self.k1, t, rows)).sum(1), second, scores), np.arange(len(G))
        known = np.nan_to_num(t)
        return tail_ps(t, scores, at(self.k0, known, every).sum(1), second(known, every))

    def p(self, g: np.ndarray, score: float) -> float:
        return float(self.ps(g[None], np.array([score]))[0])


def firth(X: np.ndarray, y: np.ndarray, rounds: int = 50, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, standard errors) of logistic regression with Jeffreys' penalty; errors from the plain information.

    With W^1/2 X = Q R the information is R'R: hat diagonals are row norms of Q, half its log determinant, the penalty,
    is the sum of R's logarithms, and a step is a least-squares fit of the working residual. A step that lowers the
    penalised likelihood is halved.
    """

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        eta = X @ b
        p = logistic(eta)
        root = np.sqrt(np.maximum(p * (1 - p), 1e-300))
        Q, R = np.linalg.qr(X * root[:, None])
        diagonal = np.abs(np.diag(R))
        value = float((y * eta - np.logaddexp(0, eta)).sum() + np.log(np.maximum(diagonal, 1e-300)).sum())
        return value, Q, R, (y - p + (Q * Q).sum(1) * (0.5 - p)) / root

    b = np.zeros(X.shape[1])
    value, Q, R, working = at(b)
    for _ in range(rounds):
        step = np.linalg.lstsq(R, Q.T @ working, rcond=None)[0]
        for part in 0.5 ** np.arange(12):
            then = at(b + part * step)
            if then[0] >= value - 1e-10 * abs(value):
                break
        b, (value, Q, R, working) = b + part * step, then
        if np.abs(part * step).max() < tol:
            break
    inverse = np.linalg.pinv(R)
    return b, np.sqrt((inverse * inverse).sum(1))


def cox_fit(X: np.ndarray, t: np.ndarray, e: np.ndarray, penalty: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Cox regression with Efron's ties and a ridge on standardised columns; raises if it doesn't converge."""
    sd = X.std(0, ddof=1)
    if (sd <= 0).any():
        raise ValueError("a constant column")
    Z = (X - X.mean(0)) / sd
    order = np.argsort(-t, kind="stable")
    Z, t, e = Z[order], t[order], e[order]
    n, k = Z.shape
    b = np.zeros(k)
    group = np.cumsum(np.r_[False, t[1:] != t[:-1]])  # equal times
    last = np.flatnonzero(np.r_[t[1:] != t[:-1], True])
    died = e > 0
    d = np.bincount(group, died, len(last))
    by_time = lambda x: np.add.reduceat(x * died.reshape(-1, *[1] * (x.ndim - 1)), np.r_[0, last[:-1] + 1])
    deaths = Z[died].sum(0)
    for _ in range(rounds):
        r = np.exp(Z @ b)
        r1 = r[:, None] * Z
        r2 = r1[:, :, None] * Z[:, None, :]
        u, info = efron(d, [np.cumsum(x, 0)[last] for x in (r, r1, r2)], [by_time(x) for x in (r, r1, r2)])
        u, info = deaths - u - penalty * n * b, info + penalty * n * np.eye(k)
        step = np.linalg.solve(info, u)
        b = b + step
        if not np.isfinite(b).all() or np.abs(b).max() > 50:
            break
        if np.abs(step).max() < 1e-8:
            return b / sd, np.sqrt(np.diag(np.linalg.inv(info))) / sd
    raise ValueError("no convergence")


def cox_tiers(X: np.ndarray, t: np.ndarray, e: np.ndarray) -> tuple[float, float, str] | None:
    """(beta, SE, model) of the first column, with the smallest of three penalties that converges."""
    for penalty, name in ((0.0, "cox"), (0.01, "cox_ridge0.01"), (0.1, "cox_ridge0.1")):
        try:
            b, se = cox_fit(X, t, e, penalty)
        except (ValueError, np.linalg.LinAlgError):
            continue
        if np.isfinite(b[0]) and np.isfinite(se[0]) and se[0] > 0:
            return float(b[0]), float(se[0]), name
    return None


def tail(scan: DataFrame, p_cutoff: float = 0.01, maf_cutoff: float = 0.05, p: str = "P") -> DataFrame:
    """Rows whose score P (column ``p``) gets a second look: a small one, or a rare variant. Cut before any Python runs."""
    return scan.where(F.col(p).isNotNull() & ((F.col(p) < p_cutoff) | (F.col("MAF") <= maf_cutoff)))


#: Numbers of a null model's table that every task holds at most, tail rows that are broadcast at most, and dosages of
#: tail variants that a task works on at once.
SENT, BROADCAST_TAIL, AT_ONCE = 8_000_000, 1_000_000, 1_000_000


def refined(rows: DataFrame, values: DataFrame | Packed, subjects: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, on: str = "predictor") -> DataFrame:
    """Applies ``f`` (tail rows, subject table, their values as a row each) to the tail rows (strata, ``on``, P).

    Packed values stay packed where the subjects' table has at most SENT numbers (counted): every task holds it, tail rows
    are met by a broadcast (counted; beyond its bound by one shuffle of the arrays), and many variants of a stratum are
    worked on at once. No dosage becomes a row. A larger table is joined with the unpacked values of tail predictors; a
    group is then one predictor and stratum, with as many rows as the stratum has subjects. Missing values stand at the
    predictor's mean. ``f`` returns its rows without strata and ``on``, in order.
    """
    names = [c for c in subjects.columns if c not in ("strata", "IID")]
    schema = f"strata string, {on} {dict(rows.dtypes)[on]}, {schema}"
    columns = [c.split()[0] for c in schema.split(", ")]

    def of(tail_rows: pd.DataFrame, people: pd.DataFrame, G: np.ndarray) -> pd.DataFrame:
        seen = (G != MISSING_DOSAGE) & ~np.isnan(G)
        G = np.where(seen, G, (np.where(seen, G, 0).sum(1) / np.maximum(seen.sum(1), 1))[:, None])
        return f(tail_rows, people, G).assign(**{c: tail_rows[c].to_numpy() for c in ("strata", on)})[columns]

    if isinstance(values, Packed) and subjects.count() * (len(names) + 2) <= SENT:
        table = subjects.join(values.samples, "IID").orderBy("strata", "sample_idx").toPandas()
        spark = rows.sparkSession
        sent = spark.sparkContext.broadcast({s: (t["sample_idx"].to_numpy(), t[names].reset_index(drop=True)) for s, t in table.groupby("strata")})
        asked = rows.groupBy(on).agg(F.collect_list(F.struct("strata", "P")).alias("_asked"))  # one a stratum
        few = asked.limit(BROADCAST_TAIL + 1).count() <= BROADCAST_TAIL
        met = values.rows.select(on, "dosage").join(F.broadcast(asked) if few else asked, on)

        def batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                wide = max((len(at) for at, _ in sent.value.values()), default=1)
                step = max(1, AT_ONCE // wide)
                for k in range(0, len(pdf), step):
                    part = pdf.iloc[k : k + step]
                    G = np.stack(part["dosage"])
                    flat = [(i, a["strata"], a["P"]) for i, asked_of in enumerate(part["_asked"]) for a in asked_of]
                    for s, (at, people) in sent.value.items():
                        mine = [(i, p) for i, own, p in flat if own == s]
                        if mine:
                            which = [i for i, _ in mine]
                            tail_rows = pd.DataFrame({"strata": s, on: part[on].to_numpy()[which], "P": [p for _, p in mine]})
                            yield of(tail_rows, people, G[which][:, at].astype(float))

        return met.mapInPandas(batch, schema)

    if isinstance(values, Packed):
        values = values.of(rows)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("IID", ignore_index=True)
        return of(pdf.iloc[:1][["strata", on, "P"]], pdf[names], pdf["value"].to_numpy(float)[None])

    met = values.select("IID", on, "value").join(rows.select("strata", on, "P"), on).join(subjects, ["strata", "IID"])
    return met.groupBy("strata", on).applyInPandas(one, schema)


def spa_or_score(rows: pd.DataFrame, p: np.ndarray) -> pd.DataFrame:
    """P and test: the saddlepoint's where it has a value, else the score's."""
    none = np.isnan(p)
    return pd.DataFrame({"P": np.where(none, rows["P"], p), "test": np.where(none, "score", "spa")})
