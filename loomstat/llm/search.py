"""Exact top-k inner-product search by two cover trees walked together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import usable, usual_length

#: Queries and rows of a block at most: what a task holds at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Children of a node of the tree over blocks, about; levels after which a node is cut by hash instead.
FAN, DEPTH = 16, 12
#: Data blocks that a task visits in turn, and how many times more of them each pass takes than the one before.
CHAIN, WIDER = 4, 8
#: Rows that a task deals out to the children of a node at once.
DEALT = 8192


@dataclass
class CoverTree:
    """A cover tree in arrays; nodes stand level by level, the points of a node are ``start`` to ``stop`` in ``X``.

    With R the radius of a node (how far its points lie from its centre at most), its children's centres are more than
    R / 2 apart (separation), every point lies within R / 2 of its child's centre (covering), and the node's centre is
    the centre of its first child (nesting). Nodes of radius 0 are leaves: equal points, by id.
    """

    ids: np.ndarray
    floor: np.ndarray
    X: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def grown(cls, ids: np.ndarray, floor: np.ndarray, X: np.ndarray) -> CoverTree:
        by_id = np.argsort(ids, kind="stable")
        ids, floor, X = ids[by_id], floor[by_id], X[by_id]
        square = (X * X).sum(1)
        D = X @ X.T
        D *= -2
        D += square[:, None]
        D += square[None, :]
        np.sqrt(np.maximum(D, 0, out=D), out=D)
        centre = int(((X - X.mean(0)) ** 2).sum(1).argmin())
        nodes, todo = [], [(np.arange(len(X)), centre)]  # breadth first: (points, centre); then what is known of each
        order = {}
        while todo:
            coming = []
            for points, c in todo:
                radius = float(D[c, points].max())
                facts = [c, radius, len(points), 0, 0]
                if radius > 0:
                    own = D if len(points) == len(X) else D[np.ix_(points, points)]
                    at = int(np.flatnonzero(points == c)[0])
                    far, picked = own > radius / 2, [at]
                    free = far[at].copy()
                    while free[at := int(free.argmax())]:
                        picked.append(at)
                        free &= far[at]
                    nearest, picks = np.full(len(points), -1), points[picked].tolist()
                    nearest[picked] = np.arange(len(picked))
                    rest = np.flatnonzero(nearest < 0)
                    nearest[rest] = own[np.ix_(rest, picked)].argmin(1)
                    by = np.argsort(nearest, kind="stable")
                    ends = np.searchsorted(nearest[by], np.arange(len(picks) + 1))
                    facts[3], facts[4] = len(nodes) + 1, len(picks)
                    coming.append((len(nodes), [(points[by[i:j]], p) for p, i, j in zip(picks, ends, ends[1:], strict=False)]))
                else:
                    order[len(nodes)] = points
                nodes.append(facts)
            todo, first = [], len(nodes)
            for parent, kids in coming:
                nodes[parent][3] = first + len(todo)
                todo += kids
        # places: children share out their parent's range
        start = np.zeros(len(nodes), int)
        for n, (_, _, _, child, children) in enumerate(nodes):
            at = start[n]
            for k in range(child, child + children):
                start[k] = at
                at += nodes[k][2]
        facts = np.array(nodes, float).reshape(len(nodes), 5)
        stop = start + facts[:, 2].astype(int)
        place = np.empty(len(X), int)
        for n, points in order.items():
            place[start[n] : stop[n]] = points
        whole = lambda k: facts[:, k].astype(int)
        return cls(ids[place], floor[place], X[place], X[whole(0)], facts[:, 1], start, stop, whole(3), whole(4))

    def stored(self) -> dict[str, bytes]:
        return {k: v.tobytes() for k, v in vars(self).items()}

    @classmethod
    def read(cls, row: dict, d: int) -> CoverTree:
        kinds = dict.fromkeys(("floor", "X", "centre", "radius"), float)
        arrays = {k: np.frombuffer(row[k], kinds.get(k, np.int64)) for k in cls.__dataclass_fields__}
        return cls(**arrays | {k: arrays[k].reshape(-1, d) for k in ("X", "centre")})


#: A stored tree, as columns.
STORED = ", ".join(f"{k} binary" for k in CoverTree.__dataclass_fields__)


class Best:
    """The k highest scores of each query of a tree so far; ties go to the smaller id."""

    def __init__(self, tree: CoverTree, k: int):
        self.tree, self.k = tree, k
        self.least = tree.floor.copy()  # a proven lower bound of each query's kth score
        none = np.zeros(0, np.int64)
        self.q, self.id, self.score = none, none, np.zeros(0)

    def take(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        by = np.lexsort((ids, -score, q))
        q = q[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        by, full = by[rank < self.k], by[rank == self.k - 1]
        self.q, self.id, self.score = q[rank < self.k], ids[by], score[by]
        at = q[rank == self.k - 1]
        self.least[at] = np.maximum(self.least[at], score[full])

    def lift(self, a: np.ndarray, least: np.ndarray) -> None:
        n = self.tree.stop[a] - self.tree.start[a]
        q = np.repeat(self.tree.start[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.least[q] = np.maximum(self.least[q], np.repeat(least, n))

    def walk(self, data: CoverTree) -> None:
        """Both trees from the top, level by level. All pairs of nodes that are left meet in one matrix product; a pair
        goes if its highest possible product is below the worst kth score of the node's queries. Pairs of leaves give
        scores, the others are opened on both sides."""
        mine = self.tree
        a, b = np.zeros(1, int), np.zeros(1, int)
        alive = np.ones((1, 1), bool)
        ids_alike = np.unique(data.ids, return_counts=True)[1].max() if len(data.ids) else 0
        while len(a) and len(b):
            A, B = mine.centre[a], data.centre[b]
            top = A @ B.T
            ra, rb = mine.radius[a], data.radius[b]
            if ra.any() or rb.any():
                la, lb = np.linalg.norm(A, axis=1), np.linalg.norm(B, axis=1)
                top += np.outer(la + ra, rb) + np.outer(ra, lb)
                top += 1e-9 * (np.abs(top) + 1)
            worst = np.array([self.least[mine.start[n] : mine.stop[n]].min() for n in a])
            alive &= top >= worst[:, None]
            leaf_a, leaf_b = mine.children[a] == 0, data.children[b] == 0
            if leaf_a.any() and leaf_b.any():
                both = alive & leaf_a[:, None] & leaf_b[None, :]
                most = self.k + ids_alike
                if both.sum() > 4 * most * leaf_a.sum():  # many scores: so many leaves prove a bound, whatever a query's own rows are
                    proved = -np.partition(np.where(both, -top, np.inf), most - 1, axis=1)[:, most - 1]
                    proved -= 2e-9 * (np.abs(proved) + 1)
                    self.lift(a, proved)
                    both &= top >= proved[:, None]
                i, j = np.nonzero(both)
                if len(i):
                    self.meet(a[i], data, b[j], (A[i] * B[j]).sum(1), most)
                alive[np.ix_(leaf_a, leaf_b)] = False
            rows, columns = alive.any(1), alive.any(0)
            a, b, alive = a[rows], b[columns], alive[np.ix_(rows, columns)]
            (a, at_a), (b, at_b) = opened(mine, a), opened(data, b)
            alive = alive[np.ix_(at_a, at_b)]

    def meet(self, a: np.ndarray, data: CoverTree, b: np.ndarray, score: np.ndarray, most: int) -> None:
        """Pairs of leaves: every query of ``a`` with the points of ``b``, of which the ``most`` with the smallest ids suffice."""
        mine = self.tree
        n_b = np.minimum(data.stop[b] - data.start[b], most)
        n_a = mine.stop[a] - mine.start[a]
        pair = np.repeat(np.arange(len(a)), n_a * n_b)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
        q = mine.start[a][pair] + within // n_b[pair]
        x = data.start[b][pair] + within % n_b[pair]
        keep = (mine.ids[q] != data.ids[x]) & (score[pair] >= self.least[q])
        if keep.any():
            self.take(q[keep], data.ids[x[keep]], score[pair][keep])


def opened(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' children (a leaf stays), and which of ``nodes`` each comes from."""
    n = np.maximum(tree.children[nodes], 1)
    at = np.repeat(np.arange(len(nodes)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return np.where(tree.children[nodes] > 0, tree.child[nodes], nodes)[at] + within, at


ROWS = "vec_id long, v array<long>, floor double, h long, node string, gap double"


def dealt(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each row to its node's nearest pivot, or, where the pivots are alike, to a child by hash."""
    if not len(rows):
        return pd.DataFrame({k: [] for k in ("vec_id", "v", "floor", "h", "node", "gap")})
    one = pivots.iloc[0]
    P, X = np.stack(one["pivots"]).astype(float), np.stack(rows["v"]).astype(float)
    if one["cuts"]:
        at, near = rows["h"].to_numpy() % one["cuts"], P[0]
    else:
        at = ((X * X).sum(1)[:, None] - 2 * X @ P.T + (P * P).sum(1)[None, :]).argmin(1)
        near = P[at]
    gap = np.sqrt(((X - near) ** 2).sum(1))
    return rows[["vec_id", "v", "floor", "h"]].assign(node=[f"{one['node']}.{k}" for k in at], gap=gap)


def block_tree(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """A tree over blocks of at most about ``size`` near vectors: the rows (vec_id, v, floor) with their block (``node``),
    and the tree's nodes (node, parent, c, radius, floor, n, leaf); its root's parent is the empty string.

    A node with more rows is opened: its rows go to the nearest of some pivots, which are its centre, the rows with the
    smallest hash of so many groups, and its farthest row. Nodes of equal vectors, or deeper than DEPTH, are cut by
    hash; that changes what can be pruned, never the result. All nodes of a level are opened together, and the number
    of levels grows with the logarithm of the rows.
    """
    spark = rows.sparkSession
    level = rows.withColumns({"h": F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 1), "node": F.lit("")})
    n, centre = level.agg(F.count(F.lit(1)), F.min_by("v", "h")).first()
    pivots = spark.createDataFrame([("", [centre], 0, n // DEALT + 1)], "node string, pivots array<array<long>>, cuts long, slots long")
    done, nodes, depth = [], [], 0
    while True:
        left = level.join(pivots.select("node", "slots"), "node") if depth else level.withColumn("slots", F.lit(n // DEALT + 1))
        left = left.withColumn("slot", F.concat_ws("/", "node", F.pmod("h", "slots"))).drop("slots")
        right = pivots.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).withColumn("slot", F.concat_ws("/", "node", "_s"))
        level = common.written(left.groupBy("slot").cogroup(right.groupBy("slot")).applyInPandas(dealt, ROWS), "search-level")
        at = F.when(F.col("cuts") > 0, F.lit(0)).otherwise(F.substring_index("node", ".", -1).cast("int"))
        seen = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.min("floor").alias("floor"))
        seen = seen.withColumn("parent", F.regexp_extract("node", r"^(.*)\.[0-9]+$", 1)).join(pivots.select(F.col("node").alias("parent"), "pivots", "cuts"), "parent")
        seen = seen.select("node", "parent", F.get("pivots", at).alias("c"), "radius", "floor", "n", ((F.col("n") <= size) | (F.col("cuts") > 0)).alias("leaf"))
        seen = common.written(seen, "search-nodes")
        nodes.append(seen)
        done.append(level.join(seen.where("leaf").select("node"), "node", "left_semi"))
        large = seen.where("not leaf")
        if not large.limit(1).count():
            break
        depth += 1
        alike = (F.col("radius") == 0) | F.lit(depth > DEPTH)
        facts = large.select("node", "c", "n", alike.alias("alike"), F.least(F.lit(FAN), F.ceil(F.col("n") * 2 / size)).alias("fan"))
        level = level.join(facts.select("node", "fan"), "node")
        some = level.groupBy("node", F.pmod(F.xxhash64("h", F.lit(depth)), "fan")).agg(F.min_by("v", "h").alias("v"), F.max_by("v", F.struct("gap", "h")).alias("far"), F.max("gap").alias("gap"))
        some = some.groupBy("node").agg(F.collect_list("v").alias("v"), F.max_by("far", "gap").alias("far"))  # FAN at most
        every = F.array_distinct(F.concat(F.array("c"), F.array_sort("v"), F.array("far")))
        cuts = F.when(F.col("alike"), F.ceil(F.col("n") / size)).otherwise(F.lit(0)).cast("long")
        pivots = some.join(facts, "node").select("node", F.when(F.col("alike"), F.array("c")).otherwise(every).alias("pivots"), cuts.alias("cuts"), (F.col("n") / DEALT + 1).cast("long").alias("slots"))
        pivots, level = common.written(pivots, "search-pivots"), level.drop("fan")
    return reduce(DataFrame.unionByName, done), common.written(reduce(DataFrame.unionByName, nodes), "search-tree")


def block_pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(qb, db, n, top): pairs of leaves of two trees over blocks whose highest possible product reaches the query block's floor.

    Both trees are walked from the root, all pairs of a level together, by equal joins with the nodes' children.
    """

    def below(tree: DataFrame, x: str) -> DataFrame:
        kids = tree.select(F.col("parent").alias(f"{x}p"), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "c", "radius", "floor", "n", "leaf")))
        return kids.unionByName(kids.where(f"{x}_leaf").withColumn(f"{x}p", F.col(f"{x}_node")))  # a leaf is its own child

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t), F.lit(0.0), lambda s, t: s + t)
    length = lambda x: F.sqrt(dot(x, x))
    qc, dc, qr, dr = (F.col(c) for c in ("q_c", "d_c", "q_radius", "d_radius"))
    top = dot(qc, dc) + qr * length(dc) + dr * length(qc) + qr * dr
    pairs = queries.sparkSession.createDataFrame([("", "")], "qp string, dp string")
    while True:
        met = pairs.join(below(queries, "q"), "qp").join(below(data, "d"), "dp").withColumn("top", top)
        met = met.where(F.col("top") + F.abs("top") * 1e-9 + 1e-6 >= F.col("q_floor"))
        met = common.written(met.select("q_node", "d_node", "q_n", "top", (F.col("q_leaf") & F.col("d_leaf")).alias("leaves")), "search-pairs")
        if not met.where("not leaves").limit(1).count():
            return met.select(F.col("q_node").alias("qb"), F.col("d_node").alias("db"), F.col("q_n").alias("n"), "top")
        pairs = met.select(F.col("q_node").alias("qp"), F.col("d_node").alias("dp"))


def trees(rows: DataFrame) -> DataFrame:
    """One cover tree for each block, built once and stored: the block and the tree's arrays."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree.grown(pdf["vec_id"].to_numpy(), pdf["floor"].to_numpy(float), np.stack(pdf["v"]).astype(float))
        return pd.DataFrame([{"block": key[0], **tree.stored()}])

    return common.written(rows.groupBy("node").applyInPandas(build, f"block string, {STORED}"), "search-trees")


def bounds(rows: DataFrame, ids: np.ndarray, S: np.ndarray, k: int) -> DataFrame:
    """Adds ``floor``: the kth score of each row among the rows ``S`` of a sample, but those of its own id."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            floor = np.full(len(pdf), -np.inf)
            if len(pdf) and len(S) >= k:
                got = np.stack(pdf["v"]).astype(float) @ S.T
                got[pdf["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                floor = -np.partition(-got, k - 1, axis=1)[:, k - 1]
            yield pdf.assign(floor=floor)

    return rows.mapInPandas(add, "vec_id long, v array<long>, floor double")


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, sample: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query over all other rows.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but those with the query's own vec_id. Ties go to the smaller vec_id. Scores are exact below 2 ** 53.

    1. Queries and rows are dealt out to blocks of near vectors by ``block_tree``; a bounded ``sample`` of rows (by
       hash) gives each query a lower bound of its kth score. Each block's cover tree is built once and stored.
    2. Both trees over blocks are walked together; a pair of nodes goes if it cannot reach the queries' worst kth score.
    3. Each query block visits what is left in passes, the most promising data blocks first. A task walks its cover
       tree with those of some data blocks in turn and carries the kth scores on; a pass leaves out what the kth scores
       of those before it rule out. A task returns k rows for a query at most.

    Rows that share a vec_id are candidates each; a query_id on several rows gets the best of all their scores. Null
    vectors, vectors with null or non-finite components or of an unusual length (they have no inner product with the
    others), and null vec_ids take no part. An empty table, or one without queries or other rows, gives no rows.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    d = usual_length(good)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = common.written(good.where(F.size("embedding") == d).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "search-rows")
    asking = rows.where(F.col("vec_id") % every == 0)
    if not d or not asking.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect()
    q_rows, q_nodes = block_tree(bounds(asking, np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some], float), k), QUERY_BLOCK)
    d_rows, d_nodes = block_tree(rows.withColumn("floor", F.lit(None).cast("double")), ROW_BLOCK)
    q_trees, d_trees = trees(q_rows), trees(d_rows)
    rank = F.row_number().over(Window.partitionBy("qb").orderBy(F.desc("top"), "db")) - 1
    pairs = common.written(block_pairs(q_nodes, d_nodes).withColumn("rank", rank), "search-pairs")

    def search(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        best = Best(CoverTree.read(q.iloc[0], d), k)
        for r in q["kth"].iloc[0]:
            best.least[r["pos"]] = max(best.least[r["pos"]], r["score"])
        for _, row in x.sort_values("rank").iterrows():  # CHAIN trees at most
            best.walk(CoverTree.read(row, d))
        return pd.DataFrame({"qb": key[0], "pos": best.q, "query_id": best.tree.ids[best.q], "vec_id": best.id, "score": best.score.astype(np.int64)})

    schema = "qb string, pos long, query_id long, vec_id long, score long"
    best, low, high = spark.createDataFrame([], schema), 0, CHAIN
    last = pairs.agg(F.max("rank")).first()[0]
    while last is not None and low <= last:
        kth = best.groupBy("qb", "pos").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("score")).where(F.col("c") == k)
        kth = kth.groupBy("qb").agg(F.count(F.lit(1)).alias("full"), F.min("score").alias("worst"), F.collect_list(F.struct("pos", "score")).alias("kth"))  # QUERY_BLOCK at most
        now = pairs.where((F.col("rank") >= low) & (F.col("rank") < high)).join(kth, "qb", "left")
        now = now.where(F.col("full").isNull() | (F.col("full") < F.col("n")) | (F.col("top") + F.abs("top") * 1e-9 + 1e-6 >= F.col("worst")))
        none = F.array().cast("array<struct<pos:bigint,score:bigint>>")
        now = common.written(now.select("qb", "db", "rank", F.floor((F.col("rank") - low) / CHAIN).alias("chain"), F.coalesce("kth", none).alias("kth")), "search-pass")
        left = now.groupBy("qb", "chain").agg(F.first("kth").alias("kth")).join(q_trees, F.col("qb") == F.col("block")).drop("block")
        right = now.select(F.col("qb").alias("_qb"), F.col("chain").alias("_chain"), "db", "rank").join(d_trees, F.col("db") == F.col("block")).drop("block", "db")
        found = left.groupBy("qb", "chain").cogroup(right.groupBy("_qb", "_chain")).applyInPandas(search, schema)
        place = F.row_number().over(Window.partitionBy("qb", "pos").orderBy(F.desc("score"), "vec_id"))
        best = common.written(best.unionByName(found).withColumn("_p", place).where(F.col("_p") <= k).drop("_p"), "search-best")
        low, high = high, high * WIDER
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of each query over all embeddings; odd rows as ``top_k`` says."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


SQL_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
