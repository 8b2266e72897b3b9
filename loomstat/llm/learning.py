"""What the two text classifiers share: who may be learned from, and one-dimensional calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def training_ids(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the documents whose labels may be learned from: labelled and not held out."""
    return common.one_label(labels, column).where(~common.held_out(F.col("doc_id")))


#: Labels that are broadcast at most, about 50 MB of them; more meet their documents by a shuffle.
BROADCAST_LABELS = 1_000_000


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents of ``known`` with their label."""
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibration(z: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, shift) of the logistic curve that best gives label ``y`` from score ``z``, ``n`` times each; the slope is not negative.

    Newton steps on the log likelihood, halved while they do not raise it; labels are softened by one example each way,
    so clear cuts stay finite.
    """
    if not n.sum():
        return 1.0, 0.0
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    X, w = np.column_stack([z, np.ones(len(z))]), np.zeros(2)

    def loss(w: np.ndarray) -> float:
        f = X @ w
        return float((n * (np.logaddexp(0, f) - t * f)).sum() + ridge * w[0] ** 2 / 2)

    now = loss(w)
    for _ in range(100):
        p = logistic(X @ w)
        step = np.linalg.solve((X * (n * p * (1 - p))[:, None]).T @ X + ridge * np.eye(2), X.T @ (n * (t - p)) - ridge * w * [1, 0])
        part = 1.0
        while (then := loss(w + part * step)) > now and part > 1e-6:
            part /= 2
        if then > now:
            break
        w, gained, now = w + part * step, now - then, then
        if gained < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])
