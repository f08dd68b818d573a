"""Accounts from fills: idempotent booking, first-in-first-out lots, dividends, corporate actions, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators.panel import as_of

MONEY = "decimal(18,2)"


def content_hash(*columns: str) -> Column:
    """Hash of a row's values that tells which of them are null: xxhash64() alone skips nulls, so a value that moves from one
    column to another that was null would go unnoticed."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def book(fills: DataFrame, content: list[str]) -> DataFrame:
    """One row a fill id: status BOOKED; or CONFLICT where one id came with different contents. Repeats change nothing.

    fills has fill_id and the columns of `content`; of a booked id its content is returned.
    """
    same = F.count_distinct(content_hash(*content))
    booked = fills.groupBy("fill_id").agg(F.count("*").alias("received"), same.alias("contents"), *[F.min(c).alias(c) for c in content])
    return booked.withColumn("status", F.when(F.col("contents") > 1, "CONFLICT").otherwise("BOOKED")).drop("contents")


def out_of_order(fills: DataFrame, key: str, arrival: str, time: str) -> DataFrame:
    """fills with refused: whether one came after a later one of its key."""
    latest = F.max(time).over(W.partitionBy(key).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    return fills.withColumn("refused", F.coalesce(F.col(time) < latest, F.lit(False)))


def fifo_lots(fills: DataFrame) -> DataFrame:
    """What is left of each bought lot after all sales of its account, oldest first: account, lot_id, bought, left,
    oversold (the account's sales beyond what it ever bought)."""
    sold = fills.where("side = 'SELL'").groupBy("account").agg(F.sum("shares").alias("sold"))
    buys = fills.where("side = 'BUY'")
    before = F.coalesce(F.sum("shares").over(W.partitionBy("account").orderBy("ts", "fill_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lots = buys.withColumn("before", before).withColumn("total", F.sum("shares").over(W.partitionBy("account"))).join(sold, "account", "left")
    gone = F.greatest(F.lit(0), F.least("shares", F.coalesce("sold", F.lit(0)) - F.col("before")))
    return lots.select("account", F.col("fill_id").alias("lot_id"), F.col("shares").alias("bought"), (F.col("shares") - gone).alias("left"), F.greatest(F.lit(0), F.coalesce("sold", F.lit(0)) - F.col("total")).alias("oversold"))


def balances(fills: DataFrame, fee_rate: str, least: str) -> DataFrame:
    """Per account: signed cash of its fills less fees rounded up, and shares."""
    gross = (F.col("price") * F.col("shares")).cast(MONEY)
    fee = F.greatest(F.lit(least).cast(MONEY), F.ceil(gross * F.lit(fee_rate).cast("decimal(8,6)"), F.lit(2)).cast(MONEY))
    sign = F.when(F.col("side") == "SELL", 1).otherwise(-1)
    return fills.where("side is not null").groupBy("account").agg(
        F.sum((sign * gross).cast(MONEY) - fee).cast(MONEY).alias("cash_change"), F.sum(-sign * F.col("shares")).alias("shares"), F.sum(fee).cast(MONEY).alias("fees"), F.count("*").alias("fills"),
    )


def entitlements(positions: DataFrame, events: DataFrame, tax: str = "0.2") -> DataFrame:
    """Dividends due on the shares held at the close of the record date.

    positions: account, code, trade_date, change (signed shares); events: event_id, code, record_date, ex_date, pay_date,
    per_share. Status REFUSED where dates are out of order, else ACCEPTED. Positions are summed up once; an event asks each
    account that ever held its code for the last sum at or before its record date.
    """
    daily = positions.groupBy("account", "code", "trade_date").agg(F.sum("change").alias("change"))
    sums = daily.withColumn("held", F.sum("change").over(W.partitionBy("account", "code").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)))
    asked = events.join(daily.select("account", "code").distinct(), "code")
    e = as_of(asked, sums, ["account", "code"], "record_date", "trade_date", ["held"]).where("held > 0")
    gross = (F.col("held") * F.col("per_share")).cast(MONEY)
    bad = ~((F.col("record_date") < F.col("ex_date")) & (F.col("ex_date") <= F.col("pay_date")))
    return e.select("event_id", "account", "code", "held", gross.alias("gross"), F.round(gross * F.lit(tax).cast("decimal(4,2)"), 2).cast(MONEY).alias("withheld"), F.when(bad, "REFUSED").otherwise("ACCEPTED").alias("status"))


def advance(entitlements: DataFrame, days: DataFrame) -> DataFrame:
    """How far each entitlement has come on the days on which its account was processed.

    entitlements: account, event_id, supplied (day), ex_date, pay_date, gross, payment, once or as often as supplied; days:
    account, day. It is recognised on its ex date and paid on its pay date, if the account is processed on just these
    days; a day passed by is refused, not made up for: LATE_EX, LATE_PAY. REWRITTEN where supplies differ. Else PENDING,
    RECEIVABLE or PAID. Processing a day again changes nothing. Accounts without a day are PENDING.
    """
    content = ["ex_date", "pay_date", "gross", "payment"]
    e = entitlements.groupBy("account", "event_id").agg(F.count_distinct(content_hash(*content)).alias("versions"), F.min("supplied").alias("supplied"), *[F.min(c).alias(c) for c in content])
    seen = days.distinct()
    at = lambda name, on: seen.select("account", F.col("day").alias(on), F.lit(True).alias(name))
    last = days.groupBy("account").agg(F.max("day").alias("last_day"))
    j = e.join(at("ex_seen", "ex_date"), ["account", "ex_date"], "left").join(at("pay_seen", "pay_date"), ["account", "pay_date"], "left").join(last, "account", "left")
    recognised = F.coalesce(F.col("ex_seen") & (F.col("supplied") <= F.col("ex_date")), F.lit(False))
    passed = lambda c: F.coalesce(F.col("last_day") > F.col(c), F.lit(False))
    status = (
        F.when(F.col("versions") > 1, "REWRITTEN").when(~recognised & (passed("ex_date") | (F.col("supplied") > F.col("ex_date"))), "LATE_EX").when(~recognised, "PENDING")
        .when(F.coalesce("pay_seen", F.lit(False)), "PAID").when(passed("pay_date"), "LATE_PAY").otherwise("RECEIVABLE")
    )
    j = j.withColumn("status", status)
    due = lambda s, c: F.when(F.col("status") == s, c).otherwise(F.lit(0)).cast(MONEY)
    return j.select("account", "event_id", "status", due("RECEIVABLE", F.col("gross")).alias("receivable"), due("PAID", F.col("payment")).alias("cash"), due("PAID", F.col("gross") - F.col("payment")).alias("withheld"))


def convert(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions (account, code, shares) after actions (code, successors array<struct<code, ratio>>): whole shares and the
    fraction left over; positions without an action stay."""
    j = positions.join(actions.withColumn("acted", F.lit(True)), "code", "left")
    own = F.array(F.struct(F.col("code").alias("code"), F.lit(1).cast("decimal(10,4)").alias("ratio")))
    each = j.select("account", F.explode(F.when(F.col("acted"), F.col("successors")).otherwise(own)).alias("s"), "shares")
    total = each.groupBy("account", F.col("s.code").alias("code")).agg(F.sum(F.col("shares") * F.col("s.ratio")).alias("exact"))
    return total.select("account", "code", F.floor("exact").cast("long").alias("shares"), (F.col("exact") - F.floor("exact")).cast("double").alias("fraction"))


def reconcile(stored: DataFrame, recomputed: DataFrame, keys: str | list[str], columns: list[str], tolerance: float | None = None) -> DataFrame:
    """Keys whose stored figures aren't those recomputed, with all reasons; empty if all agree. With a tolerance, figures
    may differ by that share of the recomputed one's size (of 1 at least); a missing figure agrees with a missing one."""
    keys = [keys] if isinstance(keys, str) else keys
    r = recomputed.select(*keys, *[F.col(c).alias(f"re_{c}") for c in columns], F.lit(True).alias("re_there"))
    j = stored.withColumn("st_there", F.lit(True)).join(r, keys, "full_outer")

    def same(c: str) -> Column:
        a, b = F.col(c), F.col(f"re_{c}")
        if tolerance is None:
            return a.eqNullSafe(b)
        return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b)), a.isNull() & b.isNull())

    reasons = [F.when(F.col("st_there").isNull(), F.lit("NOT_STORED")), F.when(F.col("re_there").isNull(), F.lit("NOT_RECOMPUTED"))]
    both = F.col("st_there") & F.col("re_there")
    reasons += [F.when(both & ~same(c), F.lit(f"{c.upper()}_DIFFERS")) for c in columns]
    return j.select(*keys, F.array_join(F.array_compact(F.array(*reasons)), ";").alias("reasons")).where("reasons <> ''")
