"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as the mixing and near-duplicate contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that one task numbers in one go.
COPIES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; without it a cluster's executors could not read what others wrote,
    so that is an error. Only with a local master (tests) a temporary folder of this machine is used instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomstat-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: its lineage ends there.

    A lost executor costs nothing but the tasks it was running, and later plans see real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` gave and that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the third of documents whose labels are never learned from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled document: (doc_id, label). Null labels are left out; of repeated ones the largest counts."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the row's place, from 0, in the order of ``column``, whose values are distinct.

    A distributed sort; the only rows that meet are one for each partition of it.
    """
    at = written(df.orderBy(column).withColumn("_m", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_m", 33).alias("_part")
    sizes = at.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_part", part).join(starts, "_part").withColumn(out, F.col("_start") + within).drop("_m", "_part", "_start")


def prefix_sums(df: DataFrame, group: str, order: str, ties: Iterable[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its ``group``.

    Rows stand in the order of ``order`` (a double, spread evenly over [0, 1) for different rows, such as a hash of
    them), then ``ties``. ``group`` must not be null. Rows equal in all columns are counted first, before anything is
    shuffled, take one place together, and are dealt out again at last, many of them in blocks: so however often a row
    is repeated, no task has to hold its copies. A group of n different rows is cut into about sqrt(n) ranges of
    ``order``, so neither the rows of a range nor the ranges of a group that one task sees grow faster than sqrt(n).
    """
    columns = df.columns
    alike = written(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")), "alike-rows")
    all_of = F.col(value) * F.col("_copies")
    sizes = written(alike.groupBy(group).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("_ranges")), "group-sizes")
    # rows are dealt out by cell, group and range in one column, whatever the join with the sizes has done
    cell = F.concat_ws(":", "_range", F.col(group).cast("string")).alias("_cell")
    cut = alike.join(sizes, group).withColumn("_range", F.floor(F.col(order) * F.col("_ranges")).cast("long")).withColumn("_cell", cell).repartition("_cell")
    totals = cut.groupBy("_cell", group, "_range").agg(F.sum(all_of).alias("_total"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_cell", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_cell").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_within", F.coalesce(F.sum(all_of).over(within), F.lit(0))).join(starts, "_cell")
    placed = written(placed.select(*columns, "_copies", (F.col("_start") + F.col("_within")).alias("_first")), "prefix-sums")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = placed.where(F.col("_copies") <= COPIES).withColumn("_k", F.explode(upto(F.col("_copies"))))
    blocks = placed.where(F.col("_copies") > COPIES).withColumn("_b", F.explode(upto(F.ceil(F.col("_copies") / COPIES))))
    size = F.least(F.lit(COPIES), F.col("_copies") - F.col("_b") * COPIES)
    many = blocks.repartition(F.col(group), F.col(order), F.col("_b")).withColumn("_k", F.explode(upto(size))).withColumn("_k", F.col("_k") + F.col("_b") * COPIES)
    return few.unionByName(many.drop("_b")).withColumn(out, F.col("_first") + F.col("_k") * F.col(value)).drop("_copies", "_first", "_k")


def unit_hash(*columns: Column | str) -> Column:
    """A double in [0, 1) that depends on the columns' values only: 52 bits of the md5 sum of the non-null ones, joined by bars."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def components(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the smallest node that links reach, for every row of ``nodes``.

    ``links`` has columns a and b (longs). Each round every node takes the smallest label among its neighbours
    and itself, then the label of that label; rounds go on until nothing changes, and each is written to the
    shared folder. Neighbours are met by joins on the link's far end and minima with partial sums, so a node
    with very many links is split like any skewed join key.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    linked = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("n"), "c"), "labels")
    while True:
        near = (
            both.join(linked.withColumnRenamed("n", "b"), "b")
            .select(F.col("a").alias("n"), "c")
            .union(linked)
            .groupBy("n")
            .agg(F.min("c").alias("c"))
        )
        up = linked.select(F.col("n").alias("c"), F.col("c").alias("_up"))
        step = written(
            near.join(up, "c", "left").select("n", F.least("c", F.coalesce("_up", "c")).alias("c")), "labels"
        )
        changed = step.join(linked.withColumnRenamed("c", "_was"), "n").where("c <> _was").limit(1).count()
        linked = step
        if not changed:
            break
    return nodes.join(linked.select(F.col("n").alias(node), F.col("c").alias("component")), node, "left").withColumn(
        "component", F.coalesce("component", node)
    )
