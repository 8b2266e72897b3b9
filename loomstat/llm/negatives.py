"""Hard negatives: candidate blocks along a Hilbert curve, chosen for each anchor's windows by interval arithmetic on zone maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import usable, usual_length

#: Rows of a candidate block and anchors of an anchor block at most.
ROWS, ANCHORS = 4096, 512
#: Components that the curve runs through (those that vary most) and bits of each.
AXES, BITS = 8, 7
#: Blocks under a node of the zone maps' tree, as a power of two.
FAN = 6
#: Blocks that the first pass reads for each anchor block, how many times more each later pass does, anchor blocks of a task.
FIRST, WIDER, TOGETHER = 4, 8, 8

BLOCK = "block long, label long, n int, lo array<long>, hi array<long>, width int, ids binary, X binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (whole numbers below 2 ** bits) along the Hilbert curve of its dimensions.

    Skilling's way: undo each level's exchange and inversion from the highest bit down, then a Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(len(x)):
            there = (x[i] & level) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for row in x:
            place = (place << 1) | ((row >> b) & 1)
    return place


def on_curve(rows: DataFrame) -> DataFrame:
    """Adds ``h``: each vector's place on the curve through the components that vary most, cut at three deviations."""
    seen = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).toPandas()  # a row for each component
    seen = seen.sort_values(["sd", "i"], ascending=[False, True]).head(AXES)
    axes, low, step = seen["i"].to_numpy(), (seen["mean"] - 3 * seen["sd"]).to_numpy(), (6 * seen["sd"] / (1 << BITS)).to_numpy() + 1e-12

    @F.pandas_udf("long")
    def place(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int64")
        cells = np.clip((np.stack(vectors)[:, axes] - low) / step, 0, (1 << BITS) - 1)
        return pd.Series(hilbert(cells, BITS))

    return rows.withColumn("h", place("v"))


def packed(label: int, rows: list[tuple[int, np.ndarray]], number: int) -> dict:
    """A block in the order of ids, with its zone map: the least and greatest value of each component."""
    ids = np.array([i for i, _ in rows], np.int64)
    by = np.argsort(ids, kind="stable")
    X = np.stack([v for _, v in rows])[by].astype(np.int64)
    lo, hi = X.min(0), X.max(0)
    width = next(w for w in (2, 4, 8) if max(-int(lo.min()), int(hi.max()) + 1) <= 1 << (8 * w - 1))
    return {"block": number, "label": label, "n": len(ids), "lo": lo, "hi": hi, "width": width, "ids": ids[by].tobytes(), "X": X.astype(f"i{width}").tobytes()}


def in_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` (vec_id, label, v, h) as stored blocks of one label, at most ``size`` rows near each other on the curve.

    Rows are range-sorted by label, place and id, rows equal in all of them by their place in the stored table, so that
    no number of copies has to stand in one range.
    """
    parts = max(1, -(-rows.count() // (size * 8)))
    order = ["label", "h", "vec_id", "_m"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, held, number = None, [], TaskContext.get().partitionId() << 24
        for pdf in batches:
            out = []
            for i, own, v in zip(pdf["vec_id"], pdf["label"], pdf["v"], strict=True):
                if held and (own != label or len(held) == size):
                    out.append(packed(label, held, number))
                    held, number = [], number + 1
                label = own
                held.append((i, v))
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([packed(label, held, number)])

    sorted_rows = rows.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.written(sorted_rows.select("vec_id", "label", "v").mapInPandas(pack, BLOCK), name)


def zone_tree(blocks: DataFrame) -> list[DataFrame]:
    """Levels of zone maps (node, parent, first and last label, lo, hi), the widest first: runs of blocks, at last the blocks.

    Blocks are numbered along the curve without gaps (their ids are partition and place in it); the parents of the
    first level are one root.
    """
    ids = blocks.select("block", F.shiftright("block", 24).alias("part"))
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = ids.join(starts, "part").select("block", (F.col("start") + F.col("block").bitwiseAND(F.lit((1 << 24) - 1))).alias("at"))
    up = blocks.select("block", F.col("label").alias("first"), F.col("label").alias("last"), "lo", "hi").join(at, "block").withColumnRenamed("block", "node")
    levels, last = [], blocks.count() - 1
    while True:
        levels.append(common.written(up.withColumn("parent", F.shiftright("at", FAN)), "zone-maps"))
        last >>= FAN
        if last <= 0:
            return levels[::-1]
        under = levels[-1]
        some = under.groupBy("parent").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        box = under.select("parent", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "z")).groupBy("parent", "i").agg(F.min("z.lo").alias("l"), F.max("z.hi").alias("u"))
        box = box.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("i", "l", "u"))).alias("b"))  # a row for each component
        up = some.join(box, "parent").select(F.col("parent").alias("node"), F.col("parent").alias("at"), "first", "last", F.col("b.l").alias("lo"), F.col("b.u").alias("hi"))


def product_range(*boxes: str):
    """Columns low and high: between what the inner product of a vector in one box and one in another must lie."""

    @F.pandas_udf("low double, high double")
    def bound(alo: pd.Series, ahi: pd.Series, blo: pd.Series, bhi: pd.Series) -> pd.DataFrame:
        if not len(alo):
            return pd.DataFrame({"low": [], "high": []}, dtype=float)
        a, A, b, B = (np.stack(s).astype(float) for s in (alo, ahi, blo, bhi))
        corners = np.stack([a * b, a * B, A * b, A * B])
        slack = 1e-9 * np.abs(corners).max(0).sum(1) + 1e-6
        return pd.DataFrame({"low": corners.min(0).sum(1) - slack, "high": corners.max(0).sum(1) + slack})

    return bound(*boxes)


def chosen(asking: DataFrame, levels: list[DataFrame], alike: bool) -> DataFrame:
    """(ab, block, high): the blocks that anchor blocks must read.

    ``asking`` has each anchor block's label, zone map, and the scores between which its windows lie (need, cap). The
    tree of zone maps is walked from its root by joins with the children; a node goes if it holds no row with the label
    wanted (``alike``: the anchors' own, else another), or if interval arithmetic puts all its scores outside.
    """
    pairs = asking.select("ab", F.lit(0).cast("long").alias("parent"))
    ours = asking.select("ab", "label", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), "need", "cap")
    inside = F.col("label").between(F.col("first"), F.col("last"))
    pure = (F.col("first") == F.col("label")) & (F.col("last") == F.col("label"))
    for nodes in levels:
        met = pairs.join(nodes, "parent").join(ours, "ab").where(inside if alike else ~pure)
        met = met.withColumn("r", product_range("alo", "ahi", "lo", "hi")).where((F.col("r.high") >= F.col("need")) & (F.col("r.low") <= F.col("cap")))
        pairs = common.written(met.select("ab", F.col("node").alias("parent"), F.col("r.high").alias("high")), "zone-pairs")
    return pairs.withColumnRenamed("parent", "block")


class Anchors:
    """An anchor block with its windows, and the best rows found for each: at most k of the scores from low to high."""

    def __init__(self, row: dict, d: int, k: int):
        self.ids, self.X = matrix(row, d)
        self.slot = np.array([w["slot"] for w in row["windows"]], np.int64)
        self.at = np.array([w["pos"] for w in row["windows"]], np.int64)
        self.low = np.array([w["low"] for w in row["windows"]], np.int64)
        self.high = np.array([w["high"] for w in row["windows"]], np.int64)
        self.k = k
        self.floor = self.low.copy()  # below it nothing can be among a window's best any more
        for w in row["full"]:
            at = np.flatnonzero((self.slot == w["slot"]) & (self.at == w["pos"]))
            self.floor[at] = np.maximum(self.floor[at], w["score"])
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)  # window, id, score

    def read(self, block: dict, d: int) -> None:
        """One candidate block: an anchor's windows read it only if the block's box allows a score in one of them."""
        lo, hi = np.array(block["lo"], float), np.array(block["hi"], float)
        up, down = np.maximum(self.X, 0).astype(float), np.minimum(self.X, 0).astype(float)
        top, bottom = up @ hi + down @ lo, up @ lo + down @ hi
        slack = 1e-9 * (np.abs(up) @ np.maximum(np.abs(hi), np.abs(lo)) + np.abs(down) @ np.maximum(np.abs(hi), np.abs(lo))) + 1e-6
        may = np.flatnonzero((top + slack)[self.at] >= self.floor)
        may = may[(bottom - slack)[self.at[may]] <= self.high[may]]
        if not len(may):
            return
        ids, X = matrix(block, d)
        rows, place = np.unique(self.at[may], return_inverse=True)
        S = products(self.X[rows], X)
        other = self.ids[rows][:, None] != ids[None, :]
        for slot in np.unique(self.slot[may]):  # a window of each anchor at a time
            w = np.flatnonzero(self.slot[may] == slot)
            at, mine = place[w], may[w]
            T = S[at]
            fit = other[at] & (T >= self.floor[mine][:, None]) & (T <= self.high[mine][:, None])
            if fit.sum() > 4 * self.k * len(w) and T.shape[1] > self.k:
                least = np.iinfo(np.int64).min
                kth = np.partition(np.where(fit, T, least), -self.k, axis=1)[:, -self.k]
                fit &= kth[:, None] <= T
                self.floor[mine] = np.maximum(self.floor[mine], kth)
            i, j = np.nonzero(fit)
            if len(i):
                self.take(mine[i], ids[j], T[i, j])

    def take(self, window: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        window, ids, score = (np.concatenate(x) for x in zip(self.found, (window, ids, score), strict=True))
        by = np.lexsort((ids, -score, window))
        window = window[by]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        kept = by[rank < self.k]
        last = by[rank == self.k - 1]
        full = window[rank == self.k - 1]
        self.found = (window[rank < self.k], ids[kept], score[kept])
        self.floor[full] = np.maximum(self.floor[full], score[last])

    def rows(self, ab: int) -> pd.DataFrame:
        w, ids, score = self.found
        return pd.DataFrame({"ab": ab, "slot": self.slot[w], "pos": self.at[w], "vec_id": ids, "score": score})


FOUND = "ab long, slot long, pos long, vec_id long, score long"


def matrix(block: dict, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["X"], f"i{block['width']}").reshape(-1, d).astype(np.int64)


def products(A: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Whole inner products: by floating point where that is exact, else by whole numbers."""
    if float(np.abs(A).max(initial=0)) * float(np.abs(X).max(initial=0)) * A.shape[1] < 2**53:
        return (A.astype(float) @ X.T.astype(float)).astype(np.int64)
    return A @ X.T


def best_of(asking: DataFrame, pairs: DataFrame, blocks: DataFrame, d: int, k: int) -> DataFrame:
    """(ab, slot, pos, vec_id, score): for each window of each anchor of ``asking`` the ``k`` best rows of the blocks in ``pairs``.

    Anchor blocks read the most promising blocks first, more of them in each pass; a pass leaves out the blocks whose
    bound is below the worst kth score of all windows so far. Anchors go to blocks, some anchor blocks at a time.
    """
    spark = asking.sparkSession
    rank = F.row_number().over(Window.partitionBy("ab").orderBy(F.desc(F.least("high", "cap")), "block")) - 1
    pairs = common.written(pairs.join(asking.select("ab", "cap", F.size("windows").alias("all")), "ab").withColumn("rank", rank), "negative-pairs")
    last = pairs.agg(F.max("rank")).first()[0]
    best, low, high = spark.createDataFrame([], FOUND), 0, FIRST

    def search(key: tuple, anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block):
            one = block.iloc[0]
            for _, row in anchors.iterrows():  # some TOGETHER
                held = Anchors(row, d, k)
                held.read(one, d)
                out.append(held.rows(row["ab"]))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}, dtype="int64")

    while last is not None and low <= last:
        kth = best.groupBy("ab", "slot", "pos").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("score")).where(F.col("c") == k)
        kth = kth.groupBy("ab").agg(F.count(F.lit(1)).alias("filled"), F.min("score").alias("worst"), F.collect_list(F.struct("slot", "pos", "score")).alias("full"))  # windows of a block at most
        now = pairs.where((F.col("rank") >= low) & (F.col("rank") < high)).join(kth.select("ab", "filled", "worst"), "ab", "left")
        now = now.where(F.col("filled").isNull() | (F.col("filled") < F.col("all")) | (F.col("high") >= F.col("worst"))).select("ab", "block")
        deals = now.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("deals"))
        now = common.written(now.join(deals, "block").withColumn("deal", F.pmod(F.xxhash64("ab"), "deals")).drop("deals"), "negative-pass")
        none = F.array().cast("array<struct<slot:bigint,pos:bigint,score:bigint>>")
        left = now.join(asking.select("ab", "width", "ids", "X", "windows"), "ab").join(kth.select("ab", "full"), "ab", "left").withColumn("full", F.coalesce("full", none))
        right = now.select(F.col("block").alias("_block"), F.col("deal").alias("_deal")).distinct().join(blocks, F.col("_block") == F.col("block")).drop("block")
        found = left.groupBy("block", "deal").cogroup(right.groupBy("_block", "_deal")).applyInPandas(search, FOUND)
        place = F.row_number().over(Window.partitionBy("ab", "slot", "pos").orderBy(F.desc("score"), "vec_id"))
        best = common.written(best.unionByName(found).withColumn("_p", place).where(F.col("_p") <= k).drop("_p"), "negative-best")
        low, high = high, high * WIDER
    return best


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from (vec_id, embedding, label).

    Components become floor(scale * x), scores are whole inner products. Anchors are the rows whose vec_id is divisible
    by ``every``; an anchor's positives are the ``positives`` best other rows of its label; for each of them the
    ``negatives`` best rows of other labels are returned whose score is from ``low`` to ``high`` percent of the
    positive's (so a negative positive score has none). Better is the higher score, then the smaller vec_id.

    1. Rows are stored as blocks of one label along a Hilbert curve; each block has a zone map, its components' least
       and greatest values, and a tree of zone maps stands above them.
    2. The positives' window is open; then each positive gives one window. Interval arithmetic on zone maps chooses the
       blocks that anchor blocks must read, and again, with what was found so far, which anchors read a block.

    Rows with a null label or vec_id, a null vector, one with null or non-finite components, or of an unusual length
    (without an inner product) take no part. Rows that share an anchor's vec_id are not its positives or negatives;
    rows that share another vec_id each count; an anchor's vec_id on several rows gives the results of each. An empty
    table, or one without anchors, gives no rows. Scores are exact below 2 ** 63 / 100.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    good = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    d = usual_length(good)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = good.where(F.size("embedding") == d).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    rows = common.written(rows, "negative-rows")
    if not d or not rows.where(F.col("vec_id") % every == 0).limit(1).count():
        return spark.createDataFrame([], out)
    rows = common.written(on_curve(rows), "negative-rows")
    blocks = in_blocks(rows, ROWS, "negative-blocks")
    anchors = in_blocks(rows.where(F.col("vec_id") % every == 0), ANCHORS, "anchor-blocks").withColumnRenamed("block", "ab")
    levels = zone_tree(blocks)
    far = np.iinfo(np.int64).max

    window = lambda pos, slot, low, high: F.struct(pos.alias("pos"), slot.alias("slot"), low.alias("low"), high.alias("high"))
    long = lambda x: F.lit(x).cast("long")
    open_windows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: window(i, long(0), long(-far), long(far)))
    asking = common.written(anchors.withColumns({"windows": open_windows, "need": F.lit(float("-inf")), "cap": F.lit(float("inf"))}), "asking")
    near = best_of(asking, chosen(asking, levels, True), blocks, d, positives)

    rank = F.row_number().over(Window.partitionBy("ab", "pos").orderBy(F.desc("score"), "vec_id"))
    near = near.select("ab", "pos", F.col("vec_id").alias("positive_id"), F.col("score").alias("p"), (rank - 1).cast("long").alias("slot"))
    near = near.withColumns({"low": F.expr(f"-((-p * {low}) div 100) + IF(-p * {low} % 100 < 0, 1, 0)"), "high": F.expr(f"(p * {high}) div 100 - IF(p * {high} % 100 < 0, 1, 0)")})
    near = common.written(near, "positives")
    windows = near.where("low <= high").groupBy("ab").agg(F.collect_list(window(*(F.col(c) for c in ("pos", "slot", "low", "high")))).alias("windows"), F.min("low").cast("double").alias("need"), F.max("high").cast("double").alias("cap"))
    asking = common.written(anchors.join(windows, "ab"), "asking")  # of each anchor so many windows as positives at most
    hard = best_of(asking, chosen(asking, levels, False), blocks, d, negatives)

    rank = F.row_number().over(Window.partitionBy("ab", "pos", "slot").orderBy(F.desc("score"), "vec_id")).cast("int")
    hard = hard.select("ab", "pos", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), rank.alias("rank"))

    names = anchors.select("ab", F.posexplode(unpacked("ids")).alias("pos", "anchor_id"))
    met = hard.join(near, ["ab", "pos", "slot"]).join(names.withColumn("pos", F.col("pos").cast("long")), ["ab", "pos"])
    return met.select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score")


def unpacked(ids: str):
    @F.pandas_udf("array<long>")
    def numbers(packed_ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(i, np.int64) for i in packed_ids], dtype=object)

    return numbers(ids)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings, where labels of ids divisible by seven are moved on; odd rows as ``hard_negatives`` says."""
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""
