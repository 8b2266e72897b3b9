"""A quality classifier by positive-unlabelled learning: non-negative unbiased risk."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .learning import logistic, training_ids

#: Shapes of words, hashed to so many features: runs of capitals, small letters, digits and of one other character.
SHAPES = 64
STATISTICS = 16
_RUNS = re.compile(r"([A-Z]+)|([a-zß-￿]+)|([0-9]+)|(.)\4*", re.DOTALL)


def shape(word: str) -> int:
    """A feature number for how a word is written."""
    import zlib

    kinds = "".join("A" if a else "a" if b else "0" if c else d * min(len(m), 3) for m in _RUNS.finditer(word) for a, b, c, d in [m.groups()] for m in [m[0]])
    return zlib.crc32(kinds[:12].encode()) % SHAPES


class Features:
    """A text's features: how its words are written, how often they repeat, how lines and characters are spread."""

    def __init__(self) -> None:
        self.shapes: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        n, known = len(words), self.shapes
        out = np.zeros(SHAPES + STATISTICS, np.float32)
        if not n:
            out[SHAPES] = 1
            return out
        try:
            codes = [known[w] for w in words]
        except KeyError:
            if len(known) > 120_000:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = shape(w)
            codes = [known[w] for w in words]
        out[:SHAPES] = np.bincount(codes, minlength=SHAPES) / n
        chars = max(1, len(text))
        lines = text.split("\n")
        kinds = len(set(words))
        data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        out[SHAPES + 1 :] = [
            sum(map(str.__eq__, words, words[1:])) / n,
            kinds / n,
            kinds / n**0.7 / 3,
            len(set(lines)) / len(lines),
            np.log1p(n) / 10,
            chars / n / 10,
            len(lines) / n,
            data[65:91].sum() / chars,
            data[48:58].sum() / chars,
            (data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum()) / chars,
            data[128:].sum() / chars,
            sum(map(str.isupper, words)) / n,
            min(1.0, 5 / n),
            data.max() / chars,
            max(map(len, words)) / chars,
        ]
        return out


WIDE = SHAPES + STATISTICS


def stacked(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, WIDE).astype(float)


@dataclass
class Model:
    weights: np.ndarray  # the last is the shift
    middle: np.ndarray
    scale: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, cut at 8 deviations, and a one."""
        return np.column_stack([np.clip((x - self.middle) / self.scale, -8, 8), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.raw(x))


def featured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` and ``_x``, the features of its whole text; read once, and written."""

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Features()
        for texts in batches:
            yield pd.Series([make(t).tobytes() for t in texts], dtype=object)

    return common.written(docs.select(*columns, features(F.coalesce("text", F.lit(""))).alias("_x")), "quality-features")


#: Tasks' sums are added up in so many parts before the driver adds those.
PARTS = 16


def summed(rows: DataFrame, sums, size: int) -> np.ndarray:
    """What ``sums`` gives for each batch of (_x, positive), an array of ``size`` places, summed over all rows: one array a
    task, PARTS arrays to the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += sums(stacked(pdf["_x"]), pdf["positive"].to_numpy(bool))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % PARTS], "total": [total.tobytes()]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"total": [np.sum([np.frombuffer(t) for t in pdf["total"]], axis=0).tobytes()]})

    found = rows.mapInPandas(add, "part int, total binary").groupBy("part").applyInPandas(together, "total binary")
    return np.sum([np.frombuffer(r["total"]) for r in found.collect()] or [np.zeros(size)], axis=0)


def risk_sums(Z: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of unlabelled rows: how many, l(-f), its gradient and Hessian; of positives: how many, l(f), l(-f), the inputs."""
    P, U = Z[positive], Z[~positive]
    fp, fu = P @ w, U @ w
    s = logistic(fu)
    return np.concatenate([[len(U), np.logaddexp(0, fu).sum()], s @ U, ((U * (s * (1 - s))[:, None]).T @ U).ravel(), [len(P), np.logaddexp(0, -fp).sum(), np.logaddexp(0, fp).sum()], P.sum(0)])


@dataclass
class Risk:
    """The unbiased PU risk of a linear model f, prior * E_P[l(f)] + E_U[l(-f)] - prior * E_P[l(-f)], with logistic loss l.

    As l(f) - l(-f) = -f it is E_U[l(-f)] - prior * E_P[f]: convex, with the derivatives below. ``negative`` is the
    part that estimates the negatives' risk, and may not fall below zero.
    """

    value: float
    negative: float
    gradient: np.ndarray
    hessian: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, w: np.ndarray, prior: float, decay: float) -> Risk:
        k = len(w)
        (n_u, lu), gu, H = np.maximum(sums[:2], [1, 0]), sums[2 : 2 + k], sums[2 + k : 2 + k + k * k].reshape(k, k)
        (n_p, lp, lp_minus), xp = np.maximum(sums[2 + k + k * k : 5 + k + k * k], [1, 0, 0]), sums[5 + k + k * k :]
        flat = np.append(np.full(k - 1, decay), 1e-9)  # the shift is not held back
        negative = lu / n_u - prior * lp_minus / n_p
        return cls(prior * lp / n_p + negative + (flat * w * w).sum() / 2, negative, gu / n_u - prior * xp / n_p + flat * w, H / n_u + np.diag(flat + 1e-9))


def fit(sums_at, k: int, prior: float, w: np.ndarray | None = None, rounds: int = 30, decay: float = 1e-2) -> np.ndarray:
    """Newton's way to the least non-negative PU risk; ``sums_at`` gives ``risk_sums`` over all rows for some weights.

    A step that would bring the estimate of the negatives' risk below zero is taken only in part, as far as it stays
    above, and the way ends where no part of it does: what is beyond would only overfit.
    """
    w = np.zeros(k) if w is None else w
    now = Risk.of(sums_at(w), w, prior, decay)
    if now.negative < 0:  # the start itself is overfitted for this prior
        w = np.zeros(k)
        now = Risk.of(sums_at(w), w, prior, decay)
    for _ in range(rounds):
        step = -np.linalg.solve(now.hessian, now.gradient)
        part = 1.0
        while part > 1e-3:
            then = Risk.of(sums_at(w + part * step), w + part * step, prior, decay)
            if then.negative >= 0 and then.value <= now.value:
                break
            part /= 4
        else:
            break
        gained, w, now = now.value - then.value, w + part * step, then
        if gained < 1e-6:
            break
    return w


def class_prior(u: np.ndarray, p: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives in unlabelled text, from counts of unlabelled and positive rows by falling score.

    In a top bin that holds positives only, the share of unlabelled rows in it is the prior times that of positives; in
    others it is more. So the prior is at most the ratio of both shares, plus a confidence bound for their sampling
    errors: the least of these upper bounds over all top bins is taken. The rows must not have been fitted on.
    """
    if not u.sum() or not p.sum():
        return 0.5
    qu, qp = np.cumsum(u) / u.sum(), np.cumsum(p) / p.sum()
    error = np.sqrt(np.log(4 / delta) / 2 / u.sum()) + np.sqrt(np.log(4 / delta) / 2 / p.sum())
    at = np.flatnonzero(qp > 0)
    return float(np.clip(((qu[at] + (1 + gamma) * error) / qp[at]).min(), 0.02, 0.98))


#: Chosen by the labels of a fold of the rows that may be learned from, on sf0.1.
RIDGE = 1e-2
#: Bins of the model's values in which the prior is estimated, each a fiftieth wide.
BINS, WIDTH = 4001, 0.02


def train(rows: DataFrame, labels: DataFrame, column: str = "quality", decay: float = RIDGE) -> Model:
    """Fits the model on ``rows`` of ``featured`` (doc_id, _x): every trusted positive and every unlabelled row counts.

    Positives are documents labelled 1 that may be learned from; all others, held-out ones and labelled negatives too,
    are unlabelled text as it comes. The prior is estimated twice, each time on one half of the rows (by hash) from a
    model of the other half, first fitted with a prior of one half; the last fit takes all rows. A round is one pass
    over the stored features.
    """
    k = WIDE + 1
    known = training_ids(rows, labels, column).where("label = 1")
    met = rows.select("doc_id", "_x").join(known, "doc_id", "left")
    half = (F.pmod(F.xxhash64("doc_id", "_x"), F.lit(2)) == 1).alias("half")
    met = common.written(met.select("_x", F.col("label").isNotNull().alias("positive"), half), "quality-training")
    moments = summed(met, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * WIDE)
    n, n_p = moments[:2]
    if not n_p or n == n_p:  # without positives or unlabelled rows nothing can be told apart
        return Model(np.zeros(k), np.zeros(WIDE), np.ones(WIDE), 0.5)
    middle = moments[2 : 2 + WIDE] / n
    model = Model(np.zeros(k), middle, np.sqrt(np.maximum(moments[2 + WIDE :] / n - middle**2, 0)) + 1e-3, 0.5)

    def fitted(part: DataFrame) -> np.ndarray:
        def sums_at(w: np.ndarray) -> np.ndarray:
            return summed(part, lambda x, p: risk_sums(model.inputs(x), p, w), 5 + 2 * k + k * k)

        return fit(sums_at, k, model.prior, model.weights, decay=decay)

    def binned(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = BINS // 2 - np.clip(np.round(model.raw(x) / WIDTH), -(BINS // 2), BINS // 2).astype(int)
        return np.concatenate([np.bincount(at[~p], minlength=BINS), np.bincount(at[p], minlength=BINS)]).astype(float)

    for _ in range(2):
        model.weights = fitted(met.where("half"))
        counts = summed(met.where("not half"), binned, 2 * BINS)
        model.prior = class_prior(counts[:BINS], counts[BINS:])
    model.weights = fitted(met)
    return model


def probability(model: Model):
    """A column function: the model's probability of label 1, from features."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(stacked(x)), dtype="float64")

    return score


def scored(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    """``rows`` of ``featured`` with ``score`` and ``predicted`` instead of features."""
    return rows.withColumn("score", probability(model)("_x")).drop("_x").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Whole texts are read once. Null and empty texts are scored like any other; a null doc_id is unlabelled text; of
    repeated labels the largest counts, null ones do not; without any positive label, or without unlabelled rows, all
    scores are 0.5. Repeated rows stay, and each counts as a row; other columns are not read.
    """
    rows = featured(docs, ["doc_id"])
    return scored(rows, train(rows, labels), threshold).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; odd rows as ``classify`` says."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
