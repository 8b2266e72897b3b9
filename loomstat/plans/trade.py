"""The trade tables in the roles of a study: customers are subjects, brands are variants, orders are visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.genotypes import BySubject


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IID, segment, acctbal, y (mean price of orders), n_orders, big (a mean above 150,000), and means of order lines."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"), F.sum("l_tax").alias("t"), F.count(F.lit(1)).alias("k")
    )
    per = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
        F.try_divide(F.sum("q"), F.sum("k")).alias("mean_quantity"), F.try_divide(F.sum("d"), F.sum("k")).alias("mean_discount"), F.try_divide(F.sum("t"), F.sum("k")).alias("mean_tax"),
        F.max(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)).alias("had_pending"),
    )
    c = table(spark, sf_dir, "customer")
    return c.join(per, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").cast("string").alias("IID"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"),
        "y", "n_orders", "first_date", "last_date", "mean_quantity", "mean_discount", "mean_tax", "had_pending", (F.col("y") > 150_000).cast("double").alias("big"),
    )


SUBJECTS = """
lines AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_discount) AS d, sum(l_tax) AS t, count(*) AS k FROM lineitem GROUP BY 1),
subj AS (
  SELECT c_custkey AS id, c_custkey::VARCHAR AS IID, c_mktsegment AS segment, c_acctbal AS acctbal, avg(o_totalprice) AS y,
         count(*)::DOUBLE AS n_orders, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
         sum(q) / sum(k) AS mean_quantity, sum(d) / sum(k) AS mean_discount, sum(t) / sum(k) AS mean_tax,
         max(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)::DOUBLE AS had_pending,
         (avg(o_totalprice) > 150000)::INT::DOUBLE AS big
  FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)"""


def cells(spark: SparkSession, sf_dir: str, people: DataFrame) -> BySubject:
    """Lines of a brand that a customer bought, at most 2; one cell in 37 is missing.

    Bought lines are dealt by customer once, counted there and kept as one array a customer; no cell is a row.
    """
    part = table(spark, sf_dir, "part")
    names = [r["p_brand"] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]  # few brands
    known = F.array(*map(F.lit, names)).cast("array<string>")
    parts = part.select("p_partkey", (F.array_position(known, F.col("p_brand")) - 1).alias("at"))
    bought = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("id", "at").repartition("id").groupBy("id").agg(F.count(F.lit(1)), *(F.count_if(F.col("at") == v).alias(f"_{v}") for v in range(len(names))))
    )
    value = lambda v: F.when((F.col("id") * 31 + v) % 37 != 0, F.least(F.lit(2.0), F.coalesce(f"_{v}", F.lit(0)).cast("double")))
    rows = people.select("IID", "id").join(bought, "id", "left").select("IID", F.array(*map(value, range(len(names)))).cast("array<double>").alias("values"))
    return BySubject(rows, spark.range(len(names)).select(F.col("id").cast("int").alias("at"), F.get(known, F.col("id").cast("int")).alias("predictor")))


def dosages(spark: SparkSession, sf_dir: str, people: DataFrame) -> DataFrame:
    """(IID, predictor, value) of ``cells``."""
    return cells(spark, sf_dir, people).long()


DOSAGES = """
brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS v FROM (SELECT DISTINCT p_brand FROM part)),
bought AS (SELECT o_custkey AS id, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cells AS (
  SELECT s.IID, s.id, s.segment, b.p_brand AS predictor,
         CASE WHEN (s.id * 31 + b.v) % 37 <> 0 THEN least(2, coalesce(n, 0))::DOUBLE END AS value
  FROM subj s CROSS JOIN brands b LEFT JOIN bought c ON c.id = s.id AND c.p_brand = b.p_brand)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IID, its number, visit order, years since the first order, price (thousands): one row an order."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    first = Window.partitionBy("id")  # joins on id then find visits dealt by it
    years = (F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.min("o_orderdate").over(first))) / F.lit(86400 * 365.25)
    return o.select(
        F.col("id").cast("string").alias("IID"), "id", F.col("o_orderkey").alias("_row"), years.alias("years"), (F.col("o_totalprice") / 1000).alias("price"), F.col("o_orderpriority").alias("priority")
    )


VISITS = """
visits AS (
  SELECT o_custkey::VARCHAR AS IID, o_orderkey AS _row,
         (epoch(o_orderdate)::BIGINT - epoch(min(o_orderdate) OVER (PARTITION BY o_custkey))::BIGINT) / (86400 * 365.25)::DOUBLE AS years,
         o_totalprice / 1000 AS price, o_orderpriority AS priority
  FROM orders)"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table over orders: predictor, CHR, POS, EAF, beta, SE and an evenly spread P, by run and stratum."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("v"), k).alias("predictor"), F.concat(F.lit("chr"), k % 22 + 1).alias("CHR"), (k * 37 % 100003).alias("POS"),
        ((k * 13 % 997 + 1) / F.lit(1000.0)).alias("EAF"), ((k * 7919 % 9973 - 4986) / F.lit(9973.0)).alias("beta"), F.lit(0.25).alias("SE"),
        F.pow((k * 104729 % 99991 + 0.5) / F.lit(99991.0), 2.0).alias("P"), F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("run"), F.lit("linear").alias("model_type"),
        (k % 50 + 100).alias("N"),
    )


STUDY = """
study AS (
  SELECT 'v' || o_orderkey AS predictor, 'chr' || (o_orderkey % 22 + 1) AS CHR, o_orderkey * 37 % 100003 AS POS,
         (o_orderkey * 13 % 997 + 1) / 1000.0::DOUBLE AS EAF, (o_orderkey * 7919 % 9973 - 4986) / 9973.0::DOUBLE AS beta, 0.25::DOUBLE AS SE,
         pow((o_orderkey * 104729 % 99991 + 0.5) / 99991.0::DOUBLE, 2.0) AS P, o_orderpriority AS stratum, o_orderstatus AS run,
         'linear' AS model_type, o_orderkey % 50 + 100 AS N
  FROM orders)"""
