"""Data-quality gates that fail closed: every rejection carries a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, which fails when run if a key comes twice. The count is a table beside it, joined by key."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys))))).otherwise(n)).where("_n = 1").drop("_n")


def first_reason(*rules: tuple[Column, str], otherwise: str = "") -> Column:
    """Reason of the first rule that applies, in order. A rule that can't be decided applies."""
    out = None
    for applies, reason in rules:
        hit = F.coalesce(applies, F.lit(True))
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise(otherwise)


def all_reasons(*rules: tuple[Column, str]) -> Column:
    """All reasons that apply, in order, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(applies, F.lit(True)), F.lit(reason)) for applies, reason in rules])), ";")


def is_true(flag: Column) -> Column:
    """Unknown is not true."""
    return flag.eqNullSafe(F.lit(True))


def bar_reason() -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return first_reason(
        (F.least(o, h, lo, c) <= 0, "NON_POSITIVE"), (h < F.greatest(o, c), "HIGH_TOO_LOW"), (lo > F.least(o, c), "LOW_TOO_HIGH"), (F.col("volume") <= 0, "NO_VOLUME"),
    )


def execution_rejection(side: Column, change_percent: Column) -> Column:
    """Why an order can't be executed at a bar's open; "" if it can. Bars are null where there was none."""
    o, h, lo = F.col("open"), F.col("high"), F.col("low")
    flat = (o == h) & (h == lo)
    return (
        F.when(F.col("close").isNull(), "MISSING_MARKET_ROW")
        .when(F.coalesce(F.col("volume"), F.lit(0)) <= 0, "SUSPENDED_OR_ZERO_VOLUME")
        .when(o.isNull() | (o <= 0), "MISSING_OR_NONPOSITIVE_OPEN")
        .when((side == "BUY") & flat & (change_percent > 4.5), "ONE_PRICE_LIMIT_UP")
        .when((side == "SELL") & flat & (change_percent < -4.5), "ONE_PRICE_LIMIT_DOWN")
        .otherwise("")
    )


def order_gate(side: Column, shares: Column, price: Column, lower: Column, upper: Column, tradable: Column, minimum: Column, step: Column, held: Column) -> Column:
    """Ordered checks of one order against the rules of its day."""
    return (
        F.when(~F.coalesce(side.isin("BUY", "SELL"), F.lit(False)), "INVALID_SIDE")
        .when(F.coalesce(shares <= 0, F.lit(True)), "INVALID_SHARES")
        .when(lower.isNull() | upper.isNull(), "RULES_MISSING")
        .when(~is_true(tradable), "NOT_TRADABLE")
        .when(F.coalesce(price <= 0, F.lit(True)), "INVALID_PRICE")
        .when((price < lower) | (price > upper), "PRICE_OUT_OF_BOUNDS")
        .when((side == "BUY") & (price == upper), "AT_UPPER_LIMIT")
        .when((side == "SELL") & (price == lower), "AT_LOWER_LIMIT")
        .when((side == "BUY") & (shares < minimum), "BELOW_MINIMUM")
        .when((side == "BUY") & (F.pmod(shares - minimum, step) != 0), "NOT_A_STEP")
        .when((side == "SELL") & (shares > F.coalesce(held, F.lit(0))), "NOT_ENOUGH_SHARES")
        .otherwise("PRECHECK_PASS_NOT_FILL")
    )


def both_ways(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    return left.select(*keys).join(right, keys, "left_anti").withColumn("only", F.lit("left")).union(right.select(*keys).join(left, keys, "left_anti").withColumn("only", F.lit("right")))


def keys_of_one_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that only one side has, with the side, by one grouping of both: no join and no sort. Null equals no key."""
    both = left.select(key, F.lit(True).alias("_left")).union(right.select(key, F.lit(False)))
    found = both.groupBy(key).agg(F.bool_or("_left").alias("_l"), F.bool_or(~F.col("_left")).alias("_r"))
    alone = F.col(key).isNull()
    sides = F.array_compact(F.array(F.when(F.col("_l") & (alone | ~F.col("_r")), F.lit("left")), F.when(F.col("_r") & (alone | ~F.col("_l")), F.lit("right"))))
    return found.where(alone | (F.col("_l") != F.col("_r"))).select(key, F.explode(sides).alias("only"))


def missing_fields(df: DataFrame, *columns: str) -> DataFrame:
    """(field, filled): rows with a value, by column; one pass."""
    counts = df.agg(*[F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("x.*")
