"""Risk and return figures of equity series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def period_metrics(series: DataFrame, start: str, end: str, key: str = "code", date: str = "trade_date", value: str = "equity", per_year: int = 252) -> DataFrame:
    """A row a key for start..end (both included). The baseline is the last value before start, or else the first.

    total_return, annual_return, volatility, sharpe (null without volatility), max_drawdown, calmar (null without a
    drawdown), n. Series without a row in the period give none.
    """
    w = W.partitionBy(key).orderBy(date)
    s = series.where(F.col(date) <= F.lit(end).cast("date")).select(key, date, F.col(value).cast("double").alias("v"), F.lag(value).over(w).cast("double").alias("before"))
    s = s.where(F.col(date) >= F.lit(start).cast("date")).withColumn("base", F.first(F.coalesce("before", "v")).over(w))
    s = s.withColumn("r", F.col("v") / F.coalesce("before", "v") - 1).withColumn("peak", F.greatest("base", F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0))))
    a = s.groupBy(key).agg(F.count("*").alias("n"), F.first("base").alias("base"), F.max_by("v", date).alias("last"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.min(F.col("v") / F.col("peak") - 1).alias("max_drawdown"))
    year = F.sqrt(F.lit(float(per_year)))
    sd = F.coalesce(F.when(F.col("n") > 1, F.col("sd")), F.lit(0.0))
    annual = F.pow(F.col("last") / F.col("base"), per_year / F.col("n")) - 1
    return a.select(
        key, "n", (F.col("last") / F.col("base") - 1).alias("total_return"), annual.alias("annual_return"), (sd * year).alias("volatility"),
        F.when(sd > 0, F.col("mean") / sd * year).alias("sharpe"), "max_drawdown", F.when(F.col("max_drawdown") < 0, annual / -F.col("max_drawdown")).alias("calmar"),
    )


def rolling_windows(series: DataFrame, length: int, step: int, key: str = "code", date: str = "trade_date", value: str = "close") -> DataFrame:
    """Return and worst drawdown of the windows of `length` steps (a multiple of `step`) that end on every `step`-th row.

    Rows are folded once, into blocks of `step` rows with their extremes; a window is one row and whole blocks after it.
    """
    if length % step:
        raise ValueError("a window must be whole blocks")
    w = W.partitionBy(key).orderBy(date)
    s = series.select(key, date, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("i")).withColumn("block", F.ceil(F.col("i") / step))
    s = s.withColumn("high", F.max("v").over(W.partitionBy(key, "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    blocks = s.groupBy(key, "block").agg(
        F.count("*").alias("n"), F.max_by(date, "i").alias(date), F.max_by("v", "i").alias("last"), F.max("v").alias("peak"), F.min("v").alias("low"), F.min(F.col("v") / F.col("high") - 1).alias("worst"))
    over, many = W.partitionBy(key).orderBy("block"), length // step
    parts = F.collect_list(F.struct("peak", "low", "worst")).over(over.rowsBetween(1 - many, 0))
    ends = blocks.select(key, date, "block", "n", "last", F.lag("last", many).over(over).alias("base"), parts.alias("parts")).where((F.col("block") >= many) & (F.col("n") == step))
    start = F.struct(F.col("base").alias("peak"), F.lit(0.0).alias("worst"))
    fold = F.aggregate("parts", start, lambda a, x: F.struct(F.greatest(a.peak, x.peak).alias("peak"), F.least(a.worst, x.worst, x.low / a.peak - 1).alias("worst")), lambda a: a.worst)
    return ends.select(key, date, (F.col("last") / F.col("base") - 1).alias("window_return"), fold.alias("worst_drawdown"))


def stability(windows: DataFrame, key: str = "code") -> DataFrame:
    """A row a key over its rolling windows: how many, the share with a gain, the extremes, the worst drawdown."""
    return windows.groupBy(key).agg(
        F.count("*").alias("windows"), (F.count_if(F.col("window_return") > 0) / F.count("*")).alias("positive_share"),
        F.min("window_return").alias("min_return"), F.max("window_return").alias("max_return"), F.min("worst_drawdown").alias("worst_drawdown"),
    )


def dominated(metrics: DataFrame, benchmark: DataFrame, key: str = "code") -> DataFrame:
    """metrics with dominated: no better than the benchmark's one row in return, drawdown and Sharpe ratio alike."""
    b = benchmark.select(*[F.col(c).alias(f"of_{c}") for c in ("total_return", "max_drawdown", "sharpe")])
    no_better = [F.col(c) <= F.col(f"of_{c}") for c in ("total_return", "max_drawdown", "sharpe")]
    return metrics.crossJoin(F.broadcast(b)).select(*metrics.columns, F.coalesce(no_better[0] & no_better[1] & no_better[2], F.lit(False)).alias("dominated"))


def total_return_index(bars: DataFrame, dividends: DataFrame, base: float = 1000.0, key: str = "code") -> DataFrame:
    """Index of close plus dividends (key, ex_date, cash) paid into it on their ex dates, from the first bar on.

    The product telescopes: only ex dates add a factor to the ratio of closes, so only they carry rounding."""
    w = W.partitionBy(key).orderBy("trade_date")
    cash = dividends.groupBy(key, F.col("ex_date").alias("trade_date")).agg(F.sum("cash").alias("cash"))
    s = bars.join(cash, [key, "trade_date"], "left")
    s = s.withColumn("paid_in", F.when(F.row_number().over(w) > 1, F.log((F.col("close") + F.col("cash").cast("double")) / F.col("close"))))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    growth = F.col("close") / F.first("close").over(so_far) * F.exp(F.coalesce(F.sum("paid_in").over(so_far), F.lit(0.0)))
    return s.withColumn("total_return_index", base * growth).drop("paid_in")


def rank_correlation(df: DataFrame, by: str, x: str, y: str, tie: str) -> DataFrame:
    """Correlation of ordinal ranks by group; null under three rows or without variance."""
    w = W.partitionBy(by)
    r = df.withColumn("rx", F.row_number().over(w.orderBy(x, tie))).withColumn("ry", F.row_number().over(w.orderBy(y, tie)))
    return r.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rank_ic"))
