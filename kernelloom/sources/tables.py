"""Series views of the star-schema tables: one row a series, or long form (key, t, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Length of the future part of a monthly series.
HORIZON = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def money(value: Column, unit: float = 1.0) -> Column:
    """An exact sum of a two-decimal amount, so that no order of adding shows."""
    return F.sum(value.cast("decimal(18,2)")).cast("double") / F.lit(unit)


def on_calendar(cells: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with x: their values at every step from the first to the last, null where there is none.

    The array is as long as the calendar, whatever the number of rows behind it.
    """
    bounds = cells.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    steps = keys.join(F.broadcast(bounds)).withColumn("t", F.explode(F.sequence("lo", "hi")))
    full = steps.join(cells, [key, "t"], "left").withColumn("t", F.col("t") - F.col("lo"))
    rest = [c for c in keys.columns if c != key]
    series = full.groupBy(key, *rest).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return series.select(key, *rest, F.col("s.v").alias("x"))


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, name, domain (the region), x: a nation's monthly order value in millions."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    cells = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").alias("k"), month.alias("t")).agg(money(F.col("o_totalprice"), 1e6).alias("v"))
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return on_calendar(cells, nations.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("r_name").alias("domain")), "k")


def supplier_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, x: a supplier's weekly shipped quantity."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    first = item.agg(F.min(F.to_date("l_shipdate")).alias("first"))
    week = F.floor(F.date_diff(F.to_date("l_shipdate"), F.col("first")) / 7).cast("int")
    cells = item.join(F.broadcast(first)).groupBy(F.col("l_suppkey").alias("k"), week.alias("t")).agg(money(F.col("l_quantity")).alias("v"))
    return on_calendar(cells, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, t, v in long form: a user's event values in order of time; an error's value is missing."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("k"), (F.row_number().over(order) - 1).alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, x, domain (the label): embeddings in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("domain"))
