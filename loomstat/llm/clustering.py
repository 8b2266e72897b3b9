"""Exact k-means over integer vectors with ns-bounds: bounds loosen by the norm of a centroid's total displacement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import usable

#: Relative slack of bounds held in floating point: far above their rounding, far below what would cost rescans.
SLACK = 1e-9

STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, met int, lower binary, seen binary, rescanned int"


def squares(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, as whole numbers."""
    D = X - C
    return np.einsum("nd,nd->n", D, D)


class History:
    """All centroids of all rounds so far: round, centroid, component."""

    def __init__(self, rounds: list[np.ndarray]):
        self.C = np.stack(rounds)
        self.now = len(rounds) - 1
        back = (self.C[-1][None] - self.C).astype(float)
        #: how far each centroid stands now from where it stood in each round: the norm of the sum, not a sum of norms
        self.moved = np.sqrt((back * back).sum(2)) * (1 + SLACK)

    def start(self, X: np.ndarray) -> dict[str, np.ndarray]:
        """Every distance, measured once; of equally near centroids the smaller number."""
        whole = np.stack([squares(X, c[None]) for c in self.C[-1]], 1) if len(X) else np.zeros((0, self.C.shape[1]), np.int64)
        cluster = whole.argmin(1) if len(X) else np.zeros(0, int)
        distance = whole[np.arange(len(X)), cluster]
        lower = np.sqrt(whole.astype(float)) * (1 - SLACK)
        return {
            "cluster": cluster,
            "distance": distance,
            "upper": np.sqrt(distance.astype(float)) * (1 + SLACK),
            "met": np.full(len(X), self.now),
            "lower": lower.astype(np.float32) * np.float32(1 - 1e-6),
            "seen": np.full(whole.shape, self.now, np.int16),
            "rescanned": np.full(len(X), whole.shape[1]),
        }

    def assign(self, X: np.ndarray, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The assignment to the present centroids.

        A stored lower bound of a distance, measured in round T, loosens by how far that centroid has come since T, and
        so does the upper bound. Where a loosened lower bound does not clear the upper one, the upper bound is measured
        anew; centroids that still may be as near are rescanned exactly.
        """
        k = np.arange(self.C.shape[1])
        cluster, upper, met, lower, seen = (s[c].copy() for c in ("cluster", "upper", "met", "lower", "seen"))
        loose = lower - self.moved[seen, k[None]]
        loose[np.arange(len(X)), cluster] = np.inf  # its own centroid
        doubt = np.flatnonzero(loose.min(1, initial=np.inf) <= upper + self.moved[met, cluster])
        rescanned = np.zeros(len(X), int)
        if len(doubt):
            exact = squares(X[doubt], self.C[-1][cluster[doubt]])
            upper[doubt], met[doubt] = np.sqrt(exact.astype(float)) * (1 + SLACK), self.now
            row, j = np.nonzero(loose[doubt] <= upper[doubt][:, None])
            far = squares(X[doubt[row]], self.C[-1][j])
            lower[doubt[row], j] = (np.sqrt(far.astype(float)) * (1 - SLACK)).astype(np.float32) * np.float32(1 - 1e-6)
            seen[doubt[row], j] = self.now
            # what a row leaves behind gets its measured distance as a lower bound too
            own = cluster[doubt]
            lower[doubt, own] = (upper[doubt] * (1 - 3 * SLACK)).astype(np.float32) * np.float32(1 - 1e-6)
            seen[doubt, own] = self.now
            by = np.lexsort((np.concatenate([own, j]), np.concatenate([exact, far]), np.concatenate([np.arange(len(doubt)), row])))
            who = np.concatenate([np.arange(len(doubt)), row])[by]
            first = by[np.searchsorted(who, np.arange(len(doubt)))]
            cluster[doubt] = np.concatenate([own, j])[first]
            best = np.concatenate([exact, far])[first]
            upper[doubt] = np.sqrt(best.astype(float)) * (1 + SLACK)
            rescanned[doubt] = np.bincount(row, minlength=len(doubt)) + 1
        distance = squares(X, self.C[-1][cluster])
        return {"cluster": cluster, "distance": distance, "upper": upper, "met": met, "lower": lower, "seen": seen, "rescanned": rescanned}


def assigned(rows: DataFrame, history: History) -> DataFrame:
    """One round over ``rows``: vec_id and v alone in the first, the state of the round before later. Nothing is shuffled."""
    first = "cluster" not in rows.columns
    k = history.C.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.stack(pdf["v"]).astype(np.int64)
            if first:
                s = history.start(X)
            else:
                s = {c: pdf[c].to_numpy() for c in ("cluster", "upper", "met")}
                s["lower"] = np.frombuffer(b"".join(pdf["lower"]), np.float32).reshape(-1, k)
                s["seen"] = np.frombuffer(b"".join(pdf["seen"]), np.int16).reshape(-1, k)
                s = history.assign(X, s)
            flat = {c: [r.tobytes() for r in s.pop(c)] for c in ("lower", "seen")}
            yield pdf[["vec_id", "v"]].assign(**s, **flat)

    return rows.mapInPandas(run, STATE)


def moved(state: DataFrame, C: np.ndarray) -> np.ndarray:
    """Each centroid with rows becomes their componentwise floor(sum / count); an empty one stays.

    Sums are partial sums by task; k rows for each component come to the driver.
    """
    sums = state.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    C = C.copy()
    for r in sums.collect():
        C[r["cluster"], r["i"]] = r["s"] // r["n"]
    return C


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector kept of ``vectors`` (vec_id, embedding).

    Kept are vectors of exactly ``size`` components, none null, NaN or infinite; component x becomes floor(scale * x).
    Centroids start as the ``k`` kept vectors whose ``seed:vec_id`` has the smallest sha256 (of a repeated id the rows in
    the order of their vectors; rows without an id never start one), all kept vectors if there are fewer. Each round
    assigns every vector to the nearest centroid (ties: the smaller number) and moves centroids to the componentwise
    floor of the mean; then vectors are assigned once more.

    A row keeps one lower bound for each centroid with the round in which it was measured, and one upper bound. The
    driver keeps every round's centroids (rounds * k * size numbers, all parameters), so a bound is loosened by the norm
    of the total displacement since its own round. What bounds can't decide is rescanned in whole numbers, so the
    result is that of a full scan. Distances are exact below 2 ** 63, which components below 2 ** 27 in size keep.

    Each round is one pass over the stored state of the one before, written to the shared folder; the state of the
    round before is then removed. Repeated rows stay and weigh each; other columns are not read; an empty table, or one
    without such vectors, gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = vectors.where(usable(F.col("embedding"))).where(F.size("embedding") == size)
    rows = common.written(good.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "cluster-rows")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    some = rows.where("vec_id is not null").select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not some:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history = [np.array([r["v"] for r in some], np.int64)]
    state = common.written(assigned(rows, History(history)), "cluster-state")
    for _ in range(rounds):
        history.append(moved(state, history[-1]))
        before, state = state, common.written(assigned(state, History(history)), "cluster-state")
        common.erase(before)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    facts = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of all embeddings after five rounds; odd rows as ``clusters`` says."""
    return clusters(common.table(spark, sf_dir, "embeddings"))


def sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, without bounds."""
    nearest = """
a{t} AS (
  SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN m{t})
  GROUP BY vec_id, v)"""
    means = """
s{t} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{b}) GROUP BY c, i),
m{t} AS (
  SELECT m.c, coalesce(n.m, m.m) AS m FROM m{b} m
  LEFT JOIN (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS m FROM s{t} GROUP BY c) n ON n.c = m.c)"""
    steps = [nearest.format(t=0)]
    for t in range(1, rounds + 1):
        steps += [means.format(t=t, b=t - 1), nearest.format(t=t)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v AS m FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h LIMIT {k})),
{",".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c
"""
