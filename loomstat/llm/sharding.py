"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A place on an axis is a cell of GRID steps, then a hash that settles ties: equal values can be cut through.
GRID, TIES = 1 << 12, 1 << 32
#: Bins in which the weight along an axis is counted at once; a cut is refined bin by bin.
BINS = 4096
#: Groups of equal texts from this part of a shard on are known to the driver (at most its inverse a shard), which
#: places them whole; those beyond a whole shard are dealt out in chunks of this part.
HEAVY = 1 / 64


def ordinal(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the rank of the value among the distinct ones, by code point, scaled to [0, 1]; null stands first, at 0."""
    values = common.ranked(df.select(column).where(F.col(column).isNotNull()).distinct(), column, "_rank")
    top = max(1, (values.agg(F.max("_rank")).first()[0] or 0) + 1)
    met = df.join(values.select(F.col(column).alias("_value"), "_rank"), F.col(column) == F.col("_value"), "left")
    return met.withColumn(out, F.coalesce((F.col("_rank") + 1) / F.lit(float(top)), F.lit(0.0))).drop("_value", "_rank")


def scaled(df: DataFrame, column: str, value: Column) -> DataFrame:
    low, high = df.agg(F.min(value), F.max(value)).first()
    place = F.lit(0.0) if low is None or low == high else F.coalesce((value - low) / (high - low), F.lit(0.0))
    return df.withColumn(column, place)


def key_at(axes: Sequence[str], axis: Column) -> Column:
    """A unit's place on an axis: its cell of the grid, then a hash."""
    place = F.element_at(F.array(*axes), axis + 1)
    return F.least(F.floor(place * GRID), F.lit(GRID - 1)).cast("long") * TIES + F.pmod(F.col("unit"), F.lit(TIES))


@dataclass
class Heavy:
    """A group of equal texts that is not cut: where it lies, what it weighs, and the node it has come to."""

    unit: int
    weight: int
    places: list[float]
    node: int = 0

    def key(self, axis: int) -> int:
        return min(math.floor(self.places[axis] * GRID), GRID - 1) * TIES + self.unit % TIES


def split_keys(units: DataFrame, spark: SparkSession, axes: Sequence[str], nodes: dict[int, int], goals: dict[int, float], tolerance: float) -> dict[int, int]:
    """For every node, the key along its axis below which its goal of the weight lies.

    All nodes are counted together, BINS bins each. The bin with the goal is counted again, finer, until what is left
    in it weighs at most ``tolerance`` or is one key; one row per node comes to the driver each time.
    """
    low, width = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, math.ceil(GRID * TIES / BINS))
    below = dict.fromkeys(nodes, 0.0)
    found: dict[int, int] = {n: 0 for n in nodes if goals[n] <= 0}
    while open_ := [n for n in nodes if n not in found]:
        cut = spark.createDataFrame([(n, nodes[n], low[n], width[n], float(goals[n] - below[n])) for n in open_], "node long, axis int, low long, width long, want double")
        rows = units.join(F.broadcast(cut), "node").withColumn("_key", key_at(axes, F.col("axis")))  # one row a node
        bins = (
            rows.where((F.col("_key") >= F.col("low")) & (F.col("_key") < F.col("low") + F.col("width") * BINS))
            .groupBy("node", "want", F.expr("(_key - low) div width").alias("bin"))
            .agg(F.sum("weight").alias("weight"))
        )
        per_node = bins.groupBy("node", "want").agg(F.array_sort(F.collect_list(F.struct("bin", "weight"))).alias("bins"))  # at most BINS each
        walk = F.aggregate(
            "bins",
            F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0.0).alias("before"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("in_it")),
            lambda a, x: F.when((a["sum"] >= F.col("want")) & (a["bin"] >= 0), a).otherwise(
                F.struct(x["bin"].alias("bin"), a["sum"].alias("before"), (a["sum"] + x["weight"]).alias("sum"), x["weight"].cast("double").alias("in_it"))
            ),
        )
        seen = {r["node"]: r["at"] for r in per_node.select("node", walk.alias("at")).collect()}
        for n in open_:
            at = seen.get(n)
            if at is None:
                found[n] = low[n]
                continue
            start = low[n] + at["bin"] * width[n]
            if at["in_it"] <= tolerance or width[n] == 1:
                # the nearer edge of the bin
                left, right = goals[n] - below[n] - at["before"], below[n] + at["sum"] - goals[n]
                found[n] = start if left < right else start + width[n]
            else:
                below[n] += at["before"]
                low[n], width[n] = start, math.ceil(width[n] / BINS)
    return found


def divided(heavy: list[Heavy], axis: int, left: int, right: int, goal: float, rest: float) -> float:
    """Sends a node's heavy groups to the left or right child, in the order of their places, and returns the weight on the left.

    The cut between them is where light units, spread evenly along the axis, would reach the goal; it moves, as little
    as possible, where the light units could not make up for the groups' weight.
    """
    heavy = sorted(heavy, key=lambda h: (h.key(axis), h.unit))
    sums = [0.0, *accumulate(h.weight for h in heavy)]
    middle = sum(at + rest * h.key(axis) / (GRID * TIES) + h.weight / 2 <= goal for at, h in zip(sums, heavy, strict=False))
    n = min(range(len(sums)), key=lambda n: (max(sums[n] - goal, goal - sums[n] - rest, 0.0), abs(n - middle)))
    for k, h in enumerate(heavy):
        h.node = left if k < n else right
    return sums[n]


def tree(units: DataFrame, heavy: list[Heavy], shards: int) -> tuple[DataFrame, DataFrame]:
    """(unit, shard) of ``units`` (unit, weight, axis0, axis1, ... in [0, 1]) and of the heavy groups.

    A node that holds m > 1 shards is cut along the axis on which its units spread widest, at the weighted quantile
    that gives each half its share of shards (m // 2 of m), until every leaf is one shard. Heavy groups go to one side
    whole; the cut through the others makes up for their weight. Each level is written, so none is computed again;
    to the driver come a row per node and, ``heavy``, at most 1 / HEAVY groups a shard.
    """
    spark = units.sparkSession
    axes = [c for c in units.columns if c.startswith("axis")]
    parts, first = {0: shards}, {0: 0}
    placed = units.withColumn("node", F.lit(0).cast("long"))
    fresh, total = 1, 0.0
    done: list[tuple[int, int]] = [] if shards > 1 else [(0, 0)]
    while parts and shards > 1:
        rows = placed.groupBy("node").agg(F.sum("weight").alias("w"), *(x for a in axes for x in (F.min(a).alias(f"{a}_low"), F.max(a).alias(f"{a}_high")))).collect()
        mine, light = {n: [h for h in heavy if h.node == n] for n in parts}, dict.fromkeys(parts, 0)
        places = {n: [[h.places[k] for h in mine[n]] for k in range(len(axes))] for n in parts}
        for r in rows:
            if (n := r["node"]) in parts:
                light[n] = r["w"]
                for k, a in enumerate(axes):
                    places[n][k] += [r[f"{a}_low"], r[f"{a}_high"]]
        axis = {n: max(range(len(axes)), key=lambda k: max(places[n][k], default=0) - min(places[n][k], default=0)) for n in parts}
        weight = {n: light[n] + sum(h.weight for h in mine[n]) for n in parts}
        total = total or sum(weight.values())  # of the root
        cuts, nodes, goals = [], {}, {}
        for n, m in parts.items():
            left, right, fresh = fresh, fresh + 1, fresh + 2
            goal = weight[n] * (m // 2) / m
            goals[n] = min(max(goal - divided(mine[n], axis[n], left, right, goal, light[n]), 0.0), light[n])
            cuts.append((n, left, right))
            for child, count, base in ((left, m // 2, first[n]), (right, m - m // 2, first[n] + m // 2)):
                first[child] = base
                if count > 1:
                    nodes[child] = count
                else:
                    done.append((child, base))
        keys = split_keys(placed, spark, axes, axis, goals, total / shards / 2000)
        cut = spark.createDataFrame([(n, axis[n], keys[n], left, right) for n, left, right in cuts], "node long, axis int, key long, left long, right long")
        placed = placed.join(F.broadcast(cut), "node", "left")  # one row a node
        side = F.when(F.col("key").isNull(), F.col("node")).when(key_at(axes, F.col("axis")) < F.col("key"), F.col("left")).otherwise(F.col("right"))
        placed = common.written(placed.withColumn("node", side).drop("axis", "key", "left", "right"), "shard-level")
        parts = nodes
    shard = dict(done)
    leaves = placed.join(F.broadcast(spark.createDataFrame(done, "node long, shard int")), "node").select("unit", "shard")
    return leaves, spark.createDataFrame([(h.unit, shard[h.node]) for h in heavy], "unit long, shard int")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Puts documents into shards of nearly equal bytes (law ``bytes``): give their number, or the bytes of one.

    A row's size is its text's UTF-8 bytes plus 8; a null text has none, and checksum 0. The axes are source,
    language (ranks of the distinct values), logarithm of the size, and doc_id. Equal texts form a unit that lies at
    its smallest source, language and id and stays in one shard, unless it outweighs a whole shard: then its rows are
    dealt by hash to chunks of a sixty-fourth of a shard, which are units.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard, by hash of id and text) and
    grown_shard (null). Null ids, sources and languages stand first on their axes; repeated rows are rows of their
    own; missing axis columns count as null; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    rows = common.written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
            common.unit_hash(F.col("doc_id").cast("string"), text).alias("_order"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    target = max(1.0, total / shards)
    groups = rows.groupBy("_text", "size").agg(F.sum("size").alias("_all"))
    too_large = F.broadcast(groups.where(F.col("_all") > target))  # fewer than shards
    chunk = F.pmod(F.xxhash64("doc_id", "_row"), F.ceil(F.col("_all") / F.lit(target * HEAVY)))
    rows = rows.join(too_large, ["_text", "size"], "left").withColumn("_chunk", F.coalesce(chunk, F.lit(-1)).cast("long"))
    rows = rows.withColumn("unit", F.shiftrightunsigned(F.xxhash64("_text", "size", "_chunk"), 1)).drop("_all")
    units = rows.groupBy("unit").agg(
        F.sum("size").alias("weight"),
        F.min("source").alias("source"),
        F.min("lang").alias("lang"),
        F.min("doc_id").cast("double").alias("id"),
        F.log2(F.max("size")).alias("log"),
        F.max("_chunk").alias("chunk"),
    )
    units = common.written(units, "shard-units")
    for c, v in (("axis2", F.col("log")), ("axis3", F.col("id"))):
        units = scaled(units, c, v)
    units = ordinal(ordinal(units, "source", "axis0"), "lang", "axis1")
    axes = ["axis0", "axis1", "axis2", "axis3"]
    units = common.written(units.select("unit", "weight", (F.coalesce("chunk", F.lit(-1)) >= 0).alias("chunk"), *axes), "shard-axes")
    is_heavy = ~F.col("chunk") & (F.col("weight") > target * HEAVY)
    heavy = [Heavy(r["unit"], r["weight"], [r[a] for a in axes]) for r in units.where(is_heavy).orderBy("unit").collect()]  # fewer than shards / HEAVY
    leaves, whole = tree(units.where(~is_heavy).drop("chunk"), heavy, shards)
    leaves = common.written(leaves.unionByName(whole), "shard-leaves")
    placed = rows.join(leaves, "unit").select("doc_id", "size", "text_crc32", "shard", "_order", F.lit(1).cast("long").alias("_one"))
    return common.prefix_sums(placed, "shard", "_order", ["doc_id", "size"], "_one", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards; odd rows as ``shard_documents`` says."""
    return shard_documents(common.table(spark, sf_dir, "documents"), shards=24)
