"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket that one task compares with each other; larger buckets are compared block by block.
BLOCK = 2048
#: Rows that a task gets, about.
TASK_ROWS = 4096


def usable(embedding: Column) -> Column:
    """True for vectors that are not null and hold no null, NaN or infinite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite, F.lit(False))


def usual_length(df: DataFrame, embedding: str = "embedding") -> int:
    """The most common length of the vectors (of several, the largest); vectors of other lengths take no part."""
    row = df.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def unit(X: np.ndarray) -> np.ndarray:
    """Rows of length one; first divided by their largest component, so that squares neither over- nor underflow."""
    X = X / np.abs(X).max(axis=1, keepdims=True)
    return X / np.sqrt((X * X).sum(1, keepdims=True))


class Codes:
    """Binary codes of unit vectors: PCA, then rotations learned so that signs lose least, cut at the median of each bit.

    ``rotations`` of them, each from another random start, give codes longer than the vectors.
    """

    def __init__(self, sample: np.ndarray, bits: int, seed: int = 5, rounds: int = 25):
        rng = np.random.default_rng(seed)
        sample = unit(sample)
        self.middle = sample.mean(0)
        centred = sample - self.middle
        _, _, axes = np.linalg.svd(centred, full_matrices=True)
        V, d = centred @ axes.T, sample.shape[1]
        turned = []
        for _ in range(max(1, math.ceil(bits / d))):
            R = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):
                U, _, W = np.linalg.svd(np.where(V @ R >= 0, 1.0, -1.0).T @ V)
                R = (U @ W).T
            turned.append(axes.T @ R)
        self.turn = np.concatenate(turned, axis=1)[:, :bits]
        self.cut = np.median(centred @ self.turn, axis=0)

    def __call__(self, X: np.ndarray) -> np.ndarray:
        return (unit(X) - self.middle) @ self.turn >= self.cut


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a table's key, number of tables): keys about as many as rows, tables so many that a pair at ``threshold``
    agrees in none of them with probability ``miss`` at most, if its angle is the one seen from where codes are cut."""
    b = max(8, math.ceil(math.log2(max(n, 2) / 64)))
    same = (1 - math.acos(threshold) / math.pi) ** b
    return b, math.ceil(math.log(miss) / math.log(1 - same))


def pairs_at(sample: np.ndarray, threshold: float, count: int, seed: int = 11) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of ``count`` pairs in all whose cosine is ``threshold``: a row of ``sample``, and that row moved away at a right angle.

    Every other batch moves in any direction alike, the rest in that of another row, as data do that fill few dimensions.
    """
    rng = np.random.default_rng(seed)
    sample = unit(sample)
    for k in range(math.ceil(count / 1000)):
        X = sample[rng.integers(len(sample), size=1000)]
        away = rng.normal(size=X.shape)
        if k % 2:
            other = sample[rng.integers(len(sample), size=1000)] - X
            other -= (other * X).sum(1, keepdims=True) * X
            away = np.where(np.linalg.norm(other, axis=1, keepdims=True) > 1e-6, other, away)
        away -= (away * X).sum(1, keepdims=True) * X
        yield X, threshold * X + math.sqrt(1 - threshold**2) * away / np.linalg.norm(away, axis=1, keepdims=True)


def missed(coder: Codes, sample: np.ndarray, b: int, m: int, threshold: float, miss: float, count: int = 20_000) -> float:
    """The share of pairs at the threshold that agree in none of the tables, as ``pairs_at`` builds them; for a ``miss``
    below what so many pairs show, what their mean agreement in a table gives if that is more."""
    none, same = [0, 0], [0, 0]
    for k, (X, Y) in enumerate(pairs_at(sample, threshold, count)):
        agree = (coder(X).reshape(-1, m, b) == coder(Y).reshape(-1, m, b)).all(2)
        none[k % 2] += (~agree.any(1)).sum()
        same[k % 2] += agree.sum()
    share = max(none) * 2 / count
    return max(share, max((1 - x * 2 / count / m) ** m for x in same)) if miss < 20 / count else share


def fitted(sample: np.ndarray, n: int, threshold: float, miss: float) -> tuple[Codes, int, int]:
    """Codes, bits of a key and number of tables for ``n`` vectors like ``sample``.

    Codes are cut at the middle of the data, so that buckets are even; seen from there a pair may be further apart than
    from the origin, for which ``plan`` counts. So tables are added until the pairs of ``missed`` meet. If they would
    cost more than comparing all with all, one table has everything in one bucket, and nothing is missed.
    """
    b, m = plan(n, threshold, miss)
    coder = Codes(sample, b * m)
    if sample.shape[1] < 2 or threshold >= 1:
        return coder, b, m
    while (lost := missed(coder, sample, b, m, threshold, miss)) > miss:
        m = max(m + 1, math.ceil(m * min(4.0, 1.05 * math.log(miss) / math.log(min(lost, 0.999)))))
        if m * (64 + n / 2**b) >= n:
            return Codes(sample, 0), 0, 1
        coder = Codes(sample, b * m)
    return coder, b, m


def bucket_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Per class and bucket: the rows it is linked with, and one class that its links reach in the bucket.

    A pair counts in the first table in which its codes agree, so it counts once. In a pair of blocks only pairs
    across are compared.
    """
    out = []
    pdf = pdf.sort_values(["label", "t", "key", "i", "j", "cls"], ignore_index=True)
    segment = pdf.groupby(["label", "t", "key", "i", "j"], sort=False).ngroup().to_numpy()
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    X = unit(np.stack(pdf["embedding"]).astype(np.float64))
    codes = np.stack(pdf["codes"])
    cls, times, table, own = (pdf[c].to_numpy() for c in ("cls", "times", "t", "own"))
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    for a, b in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
        if b - a < 2:
            continue
        s = slice(a, b)
        near = X[s] @ X[s].T >= threshold
        np.fill_diagonal(near, False)
        if i[a] != j[a]:
            near &= own[s, None] != own[None, s]
        x, y = np.nonzero(near)
        first = (codes[s][x] == codes[s][y]).argmax(axis=1) == table[a]
        x, y = x[first], y[first]
        if not len(x):
            continue
        add = np.bincount(x, weights=times[s][y], minlength=b - a).astype(np.int64)
        label = np.arange(b - a)
        while True:
            new = label.copy()
            np.minimum.at(new, x, label[y])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = add > 0
        out.append(pd.DataFrame({"cls": cls[s][some], "other": cls[s][label][some], "add": add[some]}))
    return pd.concat(out) if out else pd.DataFrame({"cls": [], "other": [], "add": []}).astype("int64")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, sample: int = 5000, miss: float = 1e-3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows are compared only within a label, and linked if the cosine of their vectors is at least ``threshold``.
    Equal vectors of a label form one class with its number of rows, so copies are never paired. Codes are fitted on
    at most ``sample`` classes, those with the smallest hash; every class is indexed. The m tables hold m parts of the
    codes: two codes at a Hamming distance below m agree in a part for certain, and others mostly do; parts are added
    until of pairs built at the threshold around sampled rows the share ``miss`` at most is missed. Pairs that agree in
    a part are checked on the original vectors. Tasks return a row for each class and bucket, not pairs: how many rows
    it is linked with there, and one class it is joined to.

    Null, zero, non-finite vectors, vectors of an unusual length and rows without a label are linked with nothing.
    n_links counts rows, also repeated ones and such without vec_id; component_id is the smallest vec_id of the rows
    that links reach (null only if none has one).
    """
    spark = vectors.sparkSession
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    d = usual_length(vectors.where(good))
    able = F.coalesce(good & (F.size("embedding") == d), F.lit(False))
    plus = F.transform("embedding", lambda x: x + F.lit(0).cast("byte"))  # minus zero is zero
    marked = vectors.select("vec_id", plus.alias("embedding"), "label", able.alias("able")).withColumn("hash", F.xxhash64("label", "embedding"))
    grouped = marked.where("able").groupBy("hash", "label", "embedding").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first"))
    classes = common.written(grouped.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    few = [r["embedding"] for r in classes.orderBy("hash", "embedding").limit(sample).select("embedding").collect()]
    if not few:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    coder, b, m = fitted(np.array(few, float), n, threshold, miss)
    powers = 1 << np.arange(b, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            bits = coder(np.stack(v).astype(float)) if len(v) else np.zeros((0, b * m), bool)
            yield pd.Series(list(bits.reshape(len(v), m, b) @ powers))

    coded = common.written(classes.select("cls", "label", "embedding", "times", keys("embedding").alias("codes")), "vector-codes")
    slots = coded.select("cls", "label", F.posexplode("codes").alias("t", "key"))
    sizes = slots.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    pair = lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))
    met = slots.join(sizes, ["label", "t", "key"]).withColumn("own", own)
    met = met.select("cls", "label", "t", "key", "own", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), pair)).alias("p"))
    tasks = max(1, math.ceil(n * m / TASK_ROWS))
    met = met.select("cls", "t", "key", "own", "p.i", "p.j", F.pmod(F.xxhash64("label", "t", "key", "p.i", "p.j"), F.lit(tasks)).alias("task"))
    found = common.written(
        met.join(coded, "cls").groupBy("task").applyInPandas(lambda pdf: bucket_links(pdf, threshold), "cls long, other long, add long"), "vector-links"
    )
    links = found.select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct()
    nodes = classes.select(F.col("cls").alias("node"), "first", "times")
    placed = common.written(common.components(nodes, links), "vector-components")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    counts = found.groupBy(F.col("cls").alias("node")).agg(F.sum("add").alias("add"))
    facts = placed.join(least, "component").join(counts, "node", "left")
    facts = facts.select(F.col("node").alias("cls"), (F.col("times") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id")
    facts = common.written(classes.select("cls", "hash", "label", "embedding").join(facts, "cls").drop("cls"), "vector-facts")
    alone = marked.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = marked.where("able").join(facts, ["hash", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among all embeddings; odd rows as ``near_vectors`` says."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


SQL_NEAR = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS kept
FROM embeddings e
"""
