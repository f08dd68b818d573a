"""Canonical panel tables from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: str) -> F.Column:
    return F.lpad(F.col(key).cast("string"), 6, "0")


def _bars(lines: DataFrame, day: F.Column) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.groupBy(code_of("l_suppkey").alias("code"), day.alias("trade_date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a code (supplier) and day."""
    return _bars(table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a code and month, dated the first."""
    return _bars(table(spark, sf_dir, "lineitem"), F.trunc("l_shipdate", "month"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly snapshots: codes with a bar in the week, dated its Monday."""
    return table(spark, sf_dir, "lineitem").select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("observed_date"), code_of("l_suppkey").alias("code")).distinct()


def month_ends(days: DataFrame) -> DataFrame:
    """Last date of each month of a table of trade dates."""
    return days.groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("signal_date")).select("signal_date")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account events: purchases buy, errors sell, anything else is no trade (null side)."""
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL")
    return e.select(
        F.col("event_id").alias("fill_id"), code_of("user_id").alias("account"), "ts", F.to_date("ts").alias("day"), side.alias("side"),
        F.col("value").cast("decimal(18,2)").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("shares"),
    )
