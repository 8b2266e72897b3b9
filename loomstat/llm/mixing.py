"""Mixing sources to target weights, natively: hash-random order, prefix sums of words, exact cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


#: Rows of a mix that are broadcast at most to meet their texts; beyond, texts are shuffled once.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, repeats: int) -> DataFrame:
    """Adds ``target``: each source's share of all words by ``weight``, at most ``repeats`` times its own words.

    What a cap cuts off goes to the sources below theirs, by weight, until none is above. A round needs two sums
    only: with a level L, a source gets min(weight * L, cap), and L rises as sources reach their caps.
    """
    cap = F.col("source_size") * repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        filled, weight, n = sources.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - (filled or 0)) / weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def mix(docs: DataFrame, weights: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 17) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs`` has doc_id, source and text. ``weights`` takes the table of sources (``source``, ``source_size``) and
    adds ``weight``. Returns doc_id, source, size, source_size, target, taken and ``copies``/``part``: how often the
    document is taken whole, and how many of its words the cut leaves once more.

    Every row gets a hash-random key from its id and text. Within a source, rows stand in the order of that key;
    the budget (the rounded target) is met by whole passes over the source and one pass that ends at the exact word.

    Null or empty texts have no words and are never taken. A null source is a source of its own. Repeated rows are
    rows of their own; ties of the key are settled by id and size. An empty table gives an empty result.
    """
    text = F.col("text")
    base = common.written(
        docs.select(
            "doc_id",
            "source",
            # a group is never null: the flag sets a null source apart from an empty one
            F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("_source"),
            words(text).alias("size"),
            common.unit_hash(F.lit(seed), F.col("doc_id").cast("string"), text).alias("_key"),
        ),
        "mix-rows",
    )
    sources = common.written(base.groupBy("_source", "source").agg(F.sum("size").alias("source_size")), "mix-sources")
    aims = common.written(targets(weights(sources), repeats).select("_source", "source_size", "target"), "mix-targets")
    size, total, before = F.col("size"), F.col("source_size"), F.col("_before")
    budget = F.round("target").cast("long")
    passes = F.when(total > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long")
    rows = common.prefix_sums(base, "_source", "_key", ["doc_id", "size"], "size", "_before")
    return (
        rows.join(aims, "_source")
        .withColumn("_budget", budget)
        .withColumn("copies", F.when(size > 0, passes).otherwise(F.lit(0)).cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(size, F.col("_budget") - passes * total - before)).cast("long"))
        .withColumn("taken", F.col("copies") * size + F.col("part"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "part", "_key")
    )


def cycling(pattern: tuple[int, ...] = (5, 2, 1)) -> Callable[[DataFrame], DataFrame]:
    """Weights that repeat over the sources by code point, null last."""

    def add(sources: DataFrame) -> DataFrame:
        at = (F.col("_rank") % len(pattern) + 1).cast("int")
        return common.ranked(sources, "_source", "_rank").withColumn("weight", F.element_at(F.array(*map(F.lit, pattern)), at)).drop("_rank")

    return add


def mixed_documents(docs: DataFrame, weights: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, the last one of a source
    cut after its last word within the budget.

    Rows are met again by their key, which depends on id and text; repeated rows share one and are taken alike.
    """
    plan = (
        mix(docs, weights, repeats, seed)
        .groupBy("_key", "doc_id")
        .agg(F.max("copies").alias("_copies"), F.max("part").alias("_part"))
        .where("_copies + _part > 0")
    )
    plan = common.written(plan, "mix-plan")
    if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    keyed = docs.withColumn("_key", common.unit_hash(F.lit(seed), F.col("doc_id").cast("string"), "text"))
    met = keyed.join(
        plan.withColumnRenamed("doc_id", "_id"), (keyed["_key"] == plan["_key"]) & keyed["doc_id"].eqNullSafe(F.col("_id"))
    ).drop(plan["_key"])
    whole = F.array_repeat(F.col("text"), F.col("_copies").cast("int"))
    space = r"[\x20\x09-\x0D]+"
    pieces = F.split(F.regexp_replace("text", f"^{space}", ""), space, (F.col("_part") + 1).cast("int"))
    rest = F.length(F.element_at(pieces, (F.col("_part") + 1).cast("int")))
    cut = F.regexp_replace(F.left("text", F.length("text") - rest), f"{space}$", "")
    cut = F.when(F.size(pieces) <= F.col("_part"), F.col("text")).otherwise(cut)
    texts = F.concat(whole, F.when(F.col("_part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = met.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the mix over all documents; odd rows as ``mix`` says."""
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs, cycling()).select("doc_id", "size", "source_size", "target", "taken")


#: The same in SQL. Levels rise as sources reach their caps; 24 rounds are more than 20 sources can need.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS s,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '17', doc_id::VARCHAR, text)), 1, 13))::BIGINT AS h
  FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS source_size FROM base GROUP BY s),
w AS (SELECT s, source_size, [5, 2, 1][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM src),
lv AS (
  SELECT 0 AS i, 0.0::DOUBLE AS level
  UNION ALL
  SELECT i + 1, (SELECT ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) FILTER (cap <= weight * level), 0))::DOUBLE
                        / sum(weight) FILTER (cap > weight * level) FROM w)
  FROM lv WHERE i < 24 AND level IS NOT NULL),
top AS (SELECT max(level) AS level FROM lv),
aim AS (SELECT s, source_size, least(weight * level, cap::DOUBLE) AS target FROM w, top),
run AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM base JOIN aim USING (s))
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 OR source_size = 0 THEN 0
            ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM run
"""
