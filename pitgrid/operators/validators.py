"""Validators: stored rows, fetched segments, snapshots, orders and files are held against what they came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S

#: Names of date columns, in the order in which they are looked for.
DATE_COLUMNS = ("trade_date", "date", "report_date", "notice_date")


def _reasons(*rules: tuple[Column, str]) -> Column:
    """Reasons that apply, in order; a rule that can't be decided doesn't."""
    return F.array_compact(F.array(*[F.when(applies, F.lit(reason)) for applies, reason in rules]))


def canonical_errors(canonical: DataFrame, raw: DataFrame, adjusted: DataFrame, keys: list[str], raw_fields: list[str], prices: list[str], scale: Column) -> DataFrame:
    """(keys, errors) of rows of a canonical layer that differ from their two sources, exactly.

    canonical has the raw fields, each price again as <price>_adjusted, adjust_scale, and the code each source used in
    raw_source and adjusted_source; the sources have code_used. A canonical price is the adjusted source's times the scale,
    which is an expression on the keys, and null where the source has none. All sides are grouped by key first, so a repeated
    key is an error of its own row and doesn't multiply others.
    """

    def side(df, name):
        values = F.struct(*[c for c in df.columns if c not in keys])
        return df.groupBy(*keys).agg(F.min(values).alias(name), F.count("*").alias(f"{name}_n"))

    j = side(canonical, "own").join(side(raw, "raw"), keys, "full_outer").join(side(adjusted, "adj"), keys, "full_outer")
    have = lambda name: F.col(f"{name}_n").isNotNull()
    whole = have("own") & have("raw") & have("adj")
    differs = lambda a, b: whole & ~a.eqNullSafe(b)
    rules = [
        (have("raw") & ~have("own"), "SOURCE_ROW_LOST"),
        (have("own") & ~(have("raw") & have("adj")), "NOT_IN_SOURCE"),
        (have("raw") != have("adj"), "BASES_DISAGREE"),
        (F.col("own_n") > 1, "REPEATED_KEY"),
        ((F.col("raw_n") > 1) | (F.col("adj_n") > 1), "REPEATED_IN_SOURCE"),
        (differs(F.col("own.raw_source"), F.col("raw.code_used")) | differs(F.col("own.adjusted_source"), F.col("adj.code_used")), "SOURCE_CODE_DIFFERS"),
        (differs(F.col("own.adjust_scale"), scale), "SCALE_DIFFERS"),
        *[(differs(F.col(f"own.{c}"), F.col(f"raw.{c}")), f"RAW_DIFFERS:{c}") for c in raw_fields],
        *[(differs(F.col(f"own.{c}_adjusted"), F.col(f"adj.{c}") * scale), f"ADJUSTED_DIFFERS:{c}") for c in prices],
        *[(whole & (F.col(f"own.{c}") <= 0), f"NON_POSITIVE:{c}") for c in prices],
    ]
    return j.select(*keys, _reasons(*rules).alias("errors")).where(F.size("errors") > 0)


def segment_errors(rows: DataFrame, series: list[str], segment: str, day: str, limit: int = 2000) -> DataFrame:
    """(series, segment, n_rows, errors) of all fetched segments: TRUNCATED at `limit` rows or more, as a source that pages
    would cut the rest off unseen; REPEATED_DATE in a segment; OVERLAP where a day also stands in another segment of the
    series. Rows are counted by day first, so no series is gathered in one task unaggregated."""
    days = rows.groupBy(*series, segment, day).agg(F.count("*").alias("n"))
    held = days.withColumn("segments", F.count("*").over(W.partitionBy(*series, day)))
    by_segment = held.groupBy(*series, segment).agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"), F.max("segments").alias("segments"))
    errors = _reasons((F.col("n_rows") >= limit, "TRUNCATED"), (F.col("most") > 1, "REPEATED_DATE"), (F.col("segments") > 1, "OVERLAP"))
    return by_segment.select(*series, segment, "n_rows", errors.alias("errors"))


def snapshot_errors(rows: DataFrame, observed: str, updated: str, member: str, least: int, most: int) -> DataFrame:
    """(observed, n_members, errors) of all membership snapshots: their size, members named twice, more than one update date,
    and an update after the day of observation, which would be knowledge of the future."""
    by_member = rows.groupBy(observed, member).agg(F.count("*").alias("n"), F.min(updated).alias("first"), F.max(updated).alias("last"))
    one = by_member.groupBy(observed).agg(F.sum("n").alias("n_members"), F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    errors = _reasons(
        (~F.col("n_members").between(least, most), "SIZE_OUT_OF_RANGE"), (F.col("n") > 1, "REPEATED_MEMBER"), (F.col("first").isNull(), "NO_UPDATE_DATE"),
        (F.col("first") != F.col("last"), "SEVERAL_UPDATE_DATES"), (F.col("last") > F.col(observed), "FUTURE_UPDATE"),
    )
    return one.select(observed, "n_members", errors.alias("errors"))


def whole_shares(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Orders over an amount of money (order_id, code, day, requested) as numbers of shares at the day's unadjusted open.
    The smallest step is 200 on the science board and 100 elsewhere. What comes out are candidates, not fills."""
    priced = orders.join(bars.select("code", F.col("trade_date").alias("day"), "open", "volume", F.lit(True).alias("known")), ["code", "day"], "left")
    step = F.when(S.board_of(F.col("code")) == "star", 200).otherwise(100)
    tradable = F.coalesce((F.col("volume") > 0) & (F.col("open") > 0), F.lit(False))
    shares = F.when(tradable, F.floor(F.col("requested") / F.col("open") / step) * step)
    reason = (
        F.when(F.col("known").isNull(), "MISSING_UNADJUSTED_PRICE").when(~tradable, "NOT_CONFIRMED_TRADABLE")
        .when(shares < step, "CANDIDATE_BELOW_MINIMUM_SHARES").otherwise("CANDIDATE_NOT_FILL")
    )
    return priced.select("order_id", "code", "day", F.when(tradable, F.col("open")).alias("open"), shares.cast("long").alias("shares"), reason.alias("reason"))


def order_impact(orders: DataFrame, ruled: DataFrame, tolerance: float = 0.001, samples: int = 20) -> DataFrame:
    """(reason, n, samples): how many orders (order_id, code, day, side) meet a bar that is missing, has no rule inferred for
    it or no open, a halted day, or an open at the limit against their side; an order can count for several of the last.
    samples are the smallest order ids of each reason, found without sorting the rest."""
    j = orders.join(ruled.withColumnRenamed("trade_date", "day").withColumn("known", F.lit(True)), ["code", "day"], "left")
    at = lambda limit: F.abs(F.col("open") - F.col(limit)) <= tolerance
    usable = F.col("limit_up").isNotNull() & F.col("open").isNotNull()
    reasons = _reasons(
        (F.col("known").isNull(), "MISSING_PRICE_ROW"), (F.col("known") & F.col("limit_up").isNull(), "MISSING_RULE_INPUT"),
        (F.col("limit_up").isNotNull() & F.col("open").isNull(), "INVALID_OPEN"), (usable & F.col("halted"), "SUSPENDED_ORDER_DAY"),
        (usable & (F.col("side") == "BUY") & at("limit_up"), "BUY_AT_INFERRED_LIMIT_UP"), (usable & (F.col("side") == "SELL") & at("limit_down"), "SELL_AT_INFERRED_LIMIT_DOWN"),
    )
    hits = j.select("order_id", F.explode(reasons).alias("reason"))
    counts = hits.groupBy("reason").agg(F.count("*").alias("n"))
    names = ("MISSING_PRICE_ROW", "MISSING_RULE_INPUT", "INVALID_OPEN", "SUSPENDED_ORDER_DAY", "BUY_AT_INFERRED_LIMIT_UP", "SELL_AT_INFERRED_LIMIT_DOWN")
    first = reduce(DataFrame.unionAll, [hits.where(F.col("reason") == name).orderBy("order_id").limit(samples) for name in names])
    listed = first.groupBy("reason").agg(F.sort_array(F.collect_list("order_id")).alias("samples"))  # at most `samples` a reason
    return counts.join(listed, "reason").select("reason", "n", "samples")


def profile(df: DataFrame, name: str, date_columns: tuple[str, ...] = DATE_COLUMNS) -> DataFrame:
    """One row: name, n_rows, columns in order, the first known date column, and the least and greatest of its values that
    aren't empty."""
    day = next((c for c in date_columns if c in df.columns), None)
    value = F.nullif(F.trim(F.col(day).cast("string")), F.lit("")) if day else F.lit(None).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.min(value).alias("date_min"), F.max(value).alias("date_max")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(",".join(df.columns)).alias("columns"), F.lit(day).cast("string").alias("date_column"), "date_min", "date_max"
    )


def watchlist_errors(candidates: DataFrame, given: DataFrame, expected: DataFrame, group: list[str], member: str, industry: str, mechanism: str, per_mechanism: int) -> DataFrame:
    """(group, errors) of every group's list: given (group, member, place) is held against expected, the list chosen anew,
    and against the rules themselves, by the industry and mechanism of its members among the candidates."""
    known = candidates.select(*group, member, F.col(industry).alias("_i"), F.col(mechanism).alias("_m"), F.lit(True).alias("_known"))
    g = given.join(known, [*group, member], "left")
    times = lambda keys, name: g.groupBy(*group, *keys).agg(F.count("*").alias("n")).groupBy(*group).agg(F.max("n").alias(name))
    ranks = g.groupBy(*group).agg(
        F.count("*").alias("size"), F.countDistinct("place").alias("places"), F.min("place").alias("lowest"), F.max("place").alias("highest"),
        F.max(F.col("_known").isNull()).alias("unknown"),
    )
    compared = given.select(*group, member, F.col("place").alias("is")).join(expected.select(*group, member, F.col("place").alias("should")), [*group, member], "full_outer")
    wrong = compared.groupBy(*group).agg(F.max(F.col("is").isNull() | F.col("should").isNull()).alias("other"), F.max(F.col("is") != F.col("should")).alias("moved"))
    j = wrong.join(ranks, group, "left").join(times(["_i"], "industry_n"), group, "left").join(times(["_m"], "mechanism_n"), group, "left")
    errors = _reasons(
        (F.col("unknown"), "NOT_A_CANDIDATE"), (F.col("industry_n") > 1, "INDUSTRY_TWICE"), (F.col("mechanism_n") > per_mechanism, "MECHANISM_OVER_LIMIT"),
        ((F.col("lowest") != 1) | (F.col("highest") != F.col("size")) | (F.col("places") != F.col("size")), "PLACES_NOT_CONSECUTIVE"),
        (F.col("other"), "NOT_THE_SELECTION"), (F.col("moved"), "ORDER_DIFFERS"),
    )
    return j.select(*group, errors.alias("errors"))


def account_errors(accounts: DataFrame, fills: DataFrame, lots: DataFrame, dividends: DataFrame, paid: DataFrame) -> DataFrame:
    """(account, errors, expected_cash) of every stored account whose figures don't follow from its journal, and of every
    other one with no errors. Cash, shares and dividends are summed up from the journals alone.

    accounts: account, as_of, initial_cash, cash, dividend_cash, receivable, withheld. fills: account, at (place in the
    journal), fill_id, day, seq, code, side, price, shares, fees. lots: account, code, shares. dividends: account, event_id,
    ex_date, pay_date, shares, gross_per_share, payment_per_share. paid: account, event_id.
    """
    money = "decimal(18,2)"
    signed = F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares")).alias("signed")
    any_of = lambda c: F.coalesce(F.max(c), F.lit(False))

    here = F.struct("day", "seq")
    journal = W.partitionBy("account").orderBy("at")
    order = fills.select("account", "at", "day", "seq").select("account", (here <= F.lag(here).over(journal)).alias("early"))

    so_far = W.partitionBy("account", "code").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    held = fills.select("account", "code", "at", signed).select("account", "code", "signed", F.sum("signed").over(so_far).alias("held")).groupBy("account", "code").agg(F.sum("signed").alias("moved"), any_of(F.col("held") < 0).alias("negative"))
    both = held.unionByName(lots.select("account", "code", F.col("shares").alias("stored")), True).groupBy("account", "code").agg(F.sum("moved").alias("moved"), F.sum("stored").alias("stored"), F.max("negative").alias("negative"))
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    shares = both.select("account", "negative", (~known("moved").eqNullSafe(known("stored"))).alias("shares_differ"))

    flow = F.sum(-(F.col("signed") * F.col("price")) - F.col("fees")).alias("flow")
    flows = fills.select("account", "fill_id", "day", "price", "fees", signed).groupBy("account", "fill_id").agg(F.count("*").alias("fill_n"), F.max("day").alias("last_day"), flow)

    value = lambda per, name: (F.col("shares") * per).alias(name)
    gross, payment = F.col("gross_per_share"), F.col("payment_per_share")
    due = dividends.select("account", "event_id", "ex_date", "pay_date", F.lit(1).alias("due"), value(payment, "payment"), value(gross, "gross"), value(gross - payment, "tax"))
    events = due.unionByName(paid.select("account", "event_id", F.lit(True).alias("named")), True).groupBy("account", "event_id").agg(
        F.count("due").alias("n"), any_of("named").alias("named"), F.max("ex_date").alias("ex_date"), F.max("pay_date").alias("pay_date"), *[F.sum(c).alias(c) for c in ("payment", "gross", "tax")])
    there, no_id = F.col("n") > 0, F.col("event_id").isNull()
    is_paid = there & F.col("named") & ~no_id
    dues = events.select(
        "account", F.col("n").alias("event_n"), F.col("ex_date").alias("last_ex"), is_paid.alias("any_paid"), F.when(is_paid, F.col("pay_date")).alias("last_pay"), (F.col("named") & (~there | no_id)).alias("unknown_paid"),
        F.when(is_paid, F.col("payment")).alias("received"), F.when(there & ~is_paid, F.col("gross")).alias("open_gross"), F.when(is_paid, F.col("tax")).alias("held_back"))

    # all parts go through one grouping: joined one by one, their sorts and maps would stand side by side in one task
    parts = reduce(lambda a, b: a.unionByName(b, True), (order, shares, flows, dues))
    summed = ("flow", "received", "open_gross", "held_back")
    found = parts.groupBy("account").agg(*[(F.sum if c in summed else F.max)(c).alias(c) for c in parts.columns if c != "account"])
    j = accounts.join(found, "account", "left").withColumns({"repeated_fill": F.col("fill_n") > 1, "repeated_event": F.col("event_n") > 1})
    as_of = F.col("as_of")
    after = lambda some, last: some & (as_of.isNull() | F.coalesce(F.col(last) > as_of, F.lit(False)))
    j = j.withColumns({"future_fill": after(F.col("fill_n") > 0, "last_day"), "future_event": after(F.col("event_n") > 0, "last_ex"), "early_payment": after(F.col("any_paid"), "last_pay")})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,4)")
    j = j.withColumn("expected_cash", F.col("initial_cash") + zero("flow") + zero("received"))
    differs = lambda c, expected: ~F.col(c).cast("decimal(28,4)").eqNullSafe(expected.cast("decimal(28,4)"))
    errors = _reasons(
        (differs("cash", F.col("expected_cash")), "CASH_MISMATCH"), (differs("dividend_cash", zero("received")), "DIVIDEND_CASH_MISMATCH"), (F.col("repeated_event"), "DUPLICATE_DIVIDEND"),
        (F.col("repeated_fill"), "DUPLICATE_FILL"), (F.col("early_payment"), "EARLY_PAYMENT"), (F.col("early"), "FILL_ORDER_INVALID"), (F.col("future_fill"), "FUTURE_FILL"), (F.col("future_event"), "FUTURE_RECOGNITION"),
        (F.col("negative"), "NEGATIVE_POSITION"), (differs("receivable", zero("open_gross")), "RECEIVABLE_MISMATCH"), (F.col("shares_differ"), "SHARES_MISMATCH"), (F.col("unknown_paid"), "UNKNOWN_PAID_EVENT"),
        (differs("withheld", zero("held_back")), "WITHHELD_MISMATCH"),
    )
    return j.select("account", errors.alias("errors"), F.col("expected_cash").cast(money).alias("expected_cash"))
