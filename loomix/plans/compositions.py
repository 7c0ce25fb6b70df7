"""Rewritten functions inside larger plans: predicates, join and group keys, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import advise, catalog
from ..functions import scalars


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floored modulus as the key of an aggregate."""
    key = scalars.mod_bucket(F.col("l_partkey") - 1000, F.lit(7).cast("long"))
    return _table(spark, sf_dir, "lineitem").groupBy(key.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


def adult_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that reaches the Parquet scan."""
    return _table(spark, sf_dir, "part").where(scalars.common_is_adult(F.col("p_size").cast("long"))).select("p_partkey", "p_size")


def bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join keys computed on both sides, which are counted first: a key has one row on either side, not all pairs."""
    key = lambda c: scalars.mod_bucket(F.col(c), F.lit(5).cast("long"))
    left = _table(spark, sf_dir, "supplier").groupBy(key("s_suppkey").alias("k")).agg(F.count("*").alias("suppliers"))
    right = _table(spark, sf_dir, "nation").groupBy(key("n_nationkey").alias("k")).agg(F.count("*").alias("nations"), F.max("n_name").alias("last_name"))
    return left.join(right, "k").select("k", (F.col("suppliers") * F.col("nations")).alias("pairs"), "last_name")


def deviation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over a group's mean, then a rank; Spark limits each group's rows before the shuffle."""
    rows = _table(spark, sf_dir, "orders")
    mean = rows.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    scored = rows.join(mean, "o_orderpriority").select("o_orderkey", "o_orderpriority", F.round(scalars.tpcds_sales_deviation(F.col("o_totalprice"), F.col("mean")), 6).alias("deviation"))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("deviation"), "o_orderkey"))
    return scored.withColumn("rank", rank).where("rank <= 10")


def conditional_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function inside an aggregate."""
    name = F.date_format("o_orderdate", "EEEE")
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.sum(scalars.tpcds_day_sales(name, F.col("o_totalprice"))), 2).alias("sunday_sales"), F.count("*").alias("n"))


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, as the catalog reads its table."""
    return catalog.latest(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success counts by group, as the catalog's statistics."""
    return catalog.success_rates(_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "F").withColumnsRenamed({"succeeded": "finished", "tried": "n"})


def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return catalog.latest(events, ["user_id"], ["at", "event_id"])


def catalog_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 64 events of each type, as samples are kept."""
    return catalog.newest(_table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 64)


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success by two groups."""
    return catalog.success_rates(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_linestatus", "F")


def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances below zero replaced by zero, and a customer added for each nation."""
    table = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = _table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("c_custkey"), F.col("n_nationkey").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"))
    return catalog.merged(table, table.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(new), ["c_custkey"])


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, and those without, by intersection and difference."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey")
    buyers = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customers.intersect(buyers).withColumn("orders", F.lit(True)).unionByName(customers.subtract(buyers).withColumn("orders", F.lit(False)))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the hundred largest orders."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


def oldest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row by date and key, as the oldest pending rewrite is found."""
    return _table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


def generated_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made for timing, with nulls and moduli, and a function over it."""
    rows = advise.frame(spark, 100_000, **advise.FRAMES["nulls"])
    return rows.select("x", "maybe", scalars.mod_bucket(F.col("value"), F.col("modulus")).alias("bucket"))


QUERIES = {
    "plan_bucket_revenue": (bucket_revenue, "SELECT ((l_partkey - 1000) % 7 + 7) % 7 AS bucket, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1"),
    "plan_adult_filter": (adult_filter, "SELECT p_partkey, p_size FROM part WHERE p_size >= 18"),
    "plan_bucket_join": (bucket_join, "SELECT s_suppkey % 5 AS k, count(*) AS pairs, max(n_name) AS last_name FROM supplier JOIN nation ON s_suppkey % 5 = n_nationkey % 5 GROUP BY 1"),
    "plan_deviation_window": (
        deviation_window,
        """WITH m AS (SELECT o_orderkey, o_orderpriority, o_totalprice, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS mean FROM orders),
        d AS (SELECT o_orderkey, o_orderpriority, round(abs(o_totalprice - mean) / mean, 6) AS deviation FROM m)
        SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY deviation DESC, o_orderkey) AS rank FROM d QUALIFY rank <= 10""",
    ),
    "plan_conditional_sum": (conditional_sum, "SELECT o_orderstatus, round(sum(CASE WHEN dayname(o_orderdate) = 'Sunday' THEN o_totalprice END), 2) AS sunday_sales, count(*) AS n FROM orders GROUP BY 1"),
    "plan_latest_orders": (latest_orders, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "catalog_latest": (catalog_latest, "SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) = 1"),
    "catalog_newest_samples": (catalog_newest, "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 64"),
    "catalog_stats": (catalog_stats, "SELECT l_returnflag, l_linenumber, count(*) FILTER (WHERE l_linestatus = 'F') AS succeeded, count(*) AS tried FROM lineitem GROUP BY 1, 2"),
    "catalog_merge": (catalog_merge, "SELECT c_custkey, c_nationkey, greatest(c_acctbal, 0) AS c_acctbal FROM customer UNION ALL SELECT CAST(-n_nationkey - 1 AS BIGINT), n_nationkey, 1.0::DOUBLE FROM nation"),
    "plan_set_operations": (set_operations, "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS orders FROM customer"),
    "plan_top_orders": (top_orders, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "plan_oldest_order": (oldest_order, "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1"),
    "scan_generated_frame": (generated_frame, "SELECT x, CASE WHEN x % 100 <> 0 THEN x END AS maybe, ((x - 1000) % (x % 99 + 1) + (x % 99 + 1)) % (x % 99 + 1) AS bucket FROM (SELECT range AS x FROM range(100000))"),
    "plan_status_counts": (status_counts, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) AS n FROM orders GROUP BY 1"),
}
