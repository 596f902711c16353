"""Inputs of the catalogue: the shared tables as samples, signals and epochs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import HOUR, ns_of_timestamp

#: 2024-01-01, where the events start.
ORIGIN = 1_704_067_200_000_000_000
EDGES_V = [0.0, 25.0, 50.0, 100.0, 200.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (the user), event_type, t_ns, v."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), "event_type", ns_of_timestamp("ts").alias("t_ns"), F.col("value").alias("v"))


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their type, as a number, for the unit."""
    code = F.expr("cast(array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type) as int)")
    return events(spark, sf_dir).select(code.alias("unit"), "t_ns", "v")


def epochs(spark: SparkSession, n: int = 60, every: int = 12 * HOUR, length: int = 6 * HOUR) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("epoch_id"), (F.lit(ORIGIN) + F.col("id") * every).alias("start_ns"), (F.lit(ORIGIN) + F.col("id") * every + length).alias("end_ns"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each day that has any, in millions: epoch_id 0, t_ns, v."""
    rows = table(spark, sf_dir, "lineitem").groupBy(ns_of_timestamp("l_shipdate").alias("t_ns")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / 1e6).alias("v"))
    return rows.select(F.lit(0).alias("epoch_id"), "t_ns", "v")


X = "x AS (SELECT user_id AS unit, event_type, epoch_ns(ts) AS t_ns, value AS v FROM events)"
T = "tr AS (SELECT CAST(list_position(['click','error','purchase','signup','view'], event_type) AS INT) AS unit, epoch_ns(ts) AS t_ns, value AS v FROM events)"
D = "d AS (SELECT 0 AS epoch_id, epoch_ns(l_shipdate) AS t_ns, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS v FROM lineitem GROUP BY 2)"


def e_sql(n: int = 60, every: int = 12 * HOUR, length: int = 6 * HOUR) -> str:
    return f"e AS (SELECT CAST(range AS INT) AS epoch_id, {ORIGIN} + range * {every} AS start_ns, {ORIGIN} + range * {every} + {length} AS end_ns FROM range({n}))"


def tagged_sql(source: str = "x", name: str = "xe") -> str:
    return f"{name} AS (SELECT s.*, e.epoch_id, e.start_ns, e.end_ns FROM {source} s JOIN e ON s.t_ns BETWEEN e.start_ns AND e.end_ns)"


def nbins_sql(bin_ns: int) -> str:
    length = "(end_ns - start_ns)"
    return f"CASE WHEN 2 * {length} < {bin_ns} THEN 0 WHEN {length} <= {bin_ns} THEN 1 ELSE (2 * {length} - {bin_ns}) // {2 * bin_ns} + 1 END"


def grid_sql(bin_ns: int) -> str:
    return f"g AS (SELECT epoch_id, bin, start_ns + bin * {bin_ns} + {bin_ns} // 2 AS t_ns FROM (SELECT *, unnest(range({nbins_sql(bin_ns)})) AS bin FROM e))"


