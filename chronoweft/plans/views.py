"""Timed records derived from the test tables, as DataFrames and as the same in DuckDB SQL. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed units: source, id, start, end, speaker."""
    e = table(spark, sf_dir, "events")
    start = millis("ts")
    return e.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), start.alias("start"), (start + F.floor(F.col("value") * 600000)).alias("end"), F.col("event_type").alias("speaker"))


UNITS = """u AS (SELECT user_id AS source, event_id AS id, (epoch_us(ts) // 1000) AS start, (epoch_us(ts) // 1000) + CAST(floor(value * 600000) AS BIGINT) AS "end", event_type AS speaker FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as transcript segments laid end to end at 18 characters a second: source, id, start, end, speaker, text."""
    c = table(spark, sf_dir, "conversations")
    length = F.floor(F.length("text") * 1000 / 18).cast("long")
    before = F.sum(length).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0))
    return c.select(F.col("conv_id").alias("source"), F.col("turn").alias("id"), start.alias("start"), (start + length).alias("end"), F.col("role").alias("speaker"), "text")


SEGMENTS = """s0 AS (SELECT *, CAST(floor(length(text) * 1000 / 18) AS BIGINT) AS d FROM conversations),
s1 AS (SELECT *, CAST(coalesce(sum(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s0),
s AS (SELECT conv_id AS source, turn AS id, start, start + d AS "end", role AS speaker, text FROM s1)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans of a supplier's calendar in days: source, id, start, end. Both silences and freezes are taken from it."""
    i = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long") * 1000
    return i.select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 20).alias("end"), F.col("l_returnflag").alias("flag"))


SPANS = """x AS (SELECT l_suppkey AS source, l_orderkey * 10 + l_linenumber AS id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1000 AS start,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1000 + CAST(l_quantity AS BIGINT) * 20 AS "end", l_returnflag AS flag FROM lineitem)"""
