"""Decisions as columns: when to enter and leave, what to open within the budgets, and whether an order can be filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators.gates import is_true


def _both(action: str, reason: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))


def exit_decision(mechanism: Column, hard_risk: Column, quality_valid: Column, total_return: Column, held_days: Column, pe_percentile: Column, entry_profit: Column, current_profit: Column, weeks_below: Column) -> Column:
    """(action, reason), the first that applies; what is unknown is never a reason to hold."""
    r1, gained = mechanism == "R1", total_return > 0
    unconfirmed = F.coalesce((entry_profit <= 0) | (current_profit < entry_profit), F.lit(True))
    recovered = ~r1 & (pe_percentile >= 0.6)
    return (
        F.when(hard_risk | (quality_valid == F.lit(False)), _both("SELL_SIGNAL", "RISK_OR_QUALITY_EXIT"))
        .when(total_return <= -0.12, _both("SELL_SIGNAL", "STOP_LOSS"))
        .when(held_days >= 126, _both("SELL_SIGNAL", "TIME_EXIT"))
        .when(r1 & (weeks_below >= 2), _both("SELL_SIGNAL", "TWO_WEEK_MA60_EXIT"))
        .when(~r1 & ~F.coalesce(pe_percentile.between(0, 1), F.lit(False)), _both("REVIEW", "VALUATION_MISSING_OR_INVALID"))
        .when(recovered & unconfirmed, _both("REVIEW", "PE_RISE_EARNINGS_NOT_CONFIRMED"))
        .when(recovered & is_true(gained), _both("SELL_SIGNAL", "VALUATION_RECOVERY_EXIT"))
        .when(recovered, _both("REVIEW", "PE_RISE_WITHOUT_POSITIVE_TOTAL_RETURN"))
        .when(hard_risk.isNull() | quality_valid.isNull() | total_return.isNull(), _both("REVIEW", "RISK_OR_RETURN_UNKNOWN"))
        .when(r1 & F.coalesce(weeks_below < 0, F.lit(True)), _both("REVIEW", "WEEKLY_SERIES_UNKNOWN"))
        .otherwise(_both("HOLD", "NO_EXIT_TRIGGER"))
    )


def entry_action(quality_reasons: Column, trigger: Column) -> Column:
    """Quality first: a candidate with any reason against it is blocked whatever its prices say."""
    return F.when(quality_reasons != "", "BLOCKED").when(trigger == "BASELINE_TRIGGER", "BUY_SIGNAL").otherwise(trigger)


def plan_openings(signals: DataFrame, accounts: DataFrame, group: str) -> DataFrame:
    """signals (group, code, industry, roe, cash_ratio; a code once a group) with verdict and budget.

    accounts: (group, cash, market_value, held, industries, monthly_buys). At most four positions, one an industry, two
    openings a month; a budget is the least of a tenth of equity, the cash left and what keeps a fifth of equity in
    cash. Only the best of an industry can be opened, and two at most, so ranks tell what a fold over the list would.
    """
    best_first = [F.desc("roe"), F.desc("cash_ratio"), F.asc("code")]
    s = signals.join(accounts, group)
    taken, industry_taken = F.array_contains("held", F.col("code")), F.array_contains("industries", F.col("industry"))
    equity = F.col("cash") + F.col("market_value")

    def budget(reserved: Column) -> Column:
        least = F.least(equity * 0.1, F.col("cash") - reserved, equity * 0.8 - F.col("market_value") - reserved)
        return F.greatest(F.lit(0), F.floor(F.round(least * 100, 6)) / 100).cast("decimal(18,2)")

    free = s.where(~taken & ~industry_taken)
    free = free.withColumn("_i", F.row_number().over(W.partitionBy(group, "industry").orderBy(*best_first))).where("_i = 1")
    free = free.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*best_first))).where("_r <= least(4 - size(held), 2 - monthly_buys)")
    first = budget(F.lit(0).cast("decimal(18,2)"))
    plans = free.withColumn("budget", F.when(F.col("_r") == 1, first).otherwise(budget(first))).where("budget > 0")
    before = plans.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("roe")).alias("a"), (-F.col("cash_ratio")).alias("b"), "code", "industry", "budget"))).alias("plans"))
    place = F.struct((-F.col("roe")).alias("a"), (-F.col("cash_ratio")).alias("b"), F.col("code"))
    out = s.join(before, group, "left").withColumn("plans", F.coalesce("plans", F.array().cast(before.schema["plans"].dataType)))
    own = F.filter("plans", lambda p: p.code == F.col("code"))
    earlier = F.filter("plans", lambda p: F.struct(p.a.alias("a"), p.b.alias("b"), p.code.alias("code")) < place)
    n = F.size(earlier)
    verdict = (
        F.when(F.size(own) > 0, "PLANNED_NOT_EXECUTED").when(taken, "ALREADY_HELD_ADD_NOT_IMPLEMENTED")
        .when(industry_taken | F.exists(earlier, lambda p: p.industry == F.col("industry")), "INDUSTRY_LIMIT")
        .when(F.size("held") + n >= 4, "POSITION_LIMIT").when(F.col("monthly_buys") + n >= 2, "MONTHLY_BUY_LIMIT").otherwise("NO_AVAILABLE_BUDGET")
    )
    return out.select(*signals.columns, verdict.alias("verdict"), F.get(own, F.lit(0)).budget.alias("budget"))


def greedy_by_group(candidates: DataFrame, group: list[str], order: list, mechanism: str, industry: str, per_mechanism: int, top: int) -> DataFrame:
    """Of each group's candidates in order, take one an industry and at most so many a mechanism, up to `top`; a row that
    is passed over uses nothing up. A fold over the group's sorted rows."""
    listed = candidates.withColumn("_at", F.struct(*order, *[F.col(c) for c in candidates.columns if c not in group]))
    folded = listed.groupBy(*group).agg(F.array_sort(F.collect_list("_at")).alias("rows"))
    taken = F.filter("rows", lambda x: F.lit(False))

    def step(acc, x):
        same = lambda name: F.size(F.filter(acc, lambda y: y[name] == x[name]))
        fits = (F.size(acc) < top) & (same(industry) == 0) & (same(mechanism) < per_mechanism)
        return F.when(fits, F.concat(acc, F.array(x))).otherwise(acc)

    kept = folded.select(*group, F.posexplode(F.aggregate("rows", taken, step)).alias("place", "r"))
    return kept.select(*group, *[F.col(f"r.{c}").alias(c) for c in candidates.columns if c not in group], (F.col("place") + 1).cast("long").alias("place"))


def slipped_price(side: Column, price: Column, rate: str = "0.0005") -> Column:
    """The open with adverse slippage, to the cent against the order."""
    p = price.cast("decimal(18,4)")
    r = F.lit(rate).cast("decimal(6,4)")
    return F.when(side == "BUY", F.ceil(p * (1 + r) * 100) / 100).otherwise(F.floor(p * (1 - r) * 100) / 100).cast("decimal(18,2)")


def execution_verdict(action: Column, mechanism: Column, signal_day: Column, execution_day: Column, next_day: Column, has_rules: Column, low: Column, open_: Column, high: Column, price: Column, shares: Column) -> Column:
    """Why an order isn't filled, or BOOKED."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(mechanism.isin("L1", "R1")), "MISSING_SIGNAL_IDENTITY").when(no(action.isin("BUY_SIGNAL", "SELL_SIGNAL")), "NO_EXECUTABLE_SIGNAL")
        .when(no((signal_day < execution_day) & (next_day == execution_day)), "ORDER_NOT_NEXT_TRADING_DAY").when(no(has_rules), "MISSING_VERIFIED_RULES")
        .when(no((low > 0) & (low <= open_) & (open_ <= high)), "INVALID_EXECUTION_BAR").when(no(price.between(low, high)), "SLIPPED_PRICE_OUTSIDE_BAR")
        .when(no(shares > 0), F.when(action == "BUY_SIGNAL", "BUDGET_BELOW_MINIMUM").otherwise("NO_POSITION")).otherwise("BOOKED")
    )


def first_order_state(now: Column, execution_day: Column, quote_time: Column, market_status: Column, frozen_at: Column, reviewed: Column) -> Column:
    """Where the first order of an account stands: it waits for its day and for the close, and is never filled later."""
    day, at = F.to_date(now), lambda t: F.date_format(t, "HH:mm:ss")
    state = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(day < execution_day, state("WAITING", "EXECUTION_DAY_NOT_REACHED")).when(day > execution_day, state("EXPIRED", "NO_RETROSPECTIVE_FILL"))
        .when(at(now) < "15:05:00", state("WAITING", "END_OF_DAY_MODEL_NOT_READY"))
        .when(quote_time.isNull() | reviewed.isNull(), state("WAITING_EVIDENCE", "MISSING_EXECUTION_DAY_EVIDENCE"))
        .when(at(quote_time) < "15:00:00", state("WAITING_EVIDENCE", "INCOMPLETE_DAILY_QUOTE"))
        .when(market_status.isin(6, 7, 8, 9, 14, 15, 16), state("REJECTED", "PROVIDER_STATUS_NOT_TRADABLE"))
        .when(~market_status.eqNullSafe(F.lit(5)), state("WAITING_EVIDENCE", "PROVIDER_CLOSE_STATUS_NOT_CONFIRMED"))
        .when(F.coalesce((F.to_date(frozen_at) != execution_day) | (at(frozen_at) > "09:25:00"), F.lit(True)), state("REJECTED", "ELIGIBILITY_NOT_FROZEN_BEFORE_OPEN"))
        .when(~reviewed, state("REJECTED", "NOT_VERIFIED")).otherwise(state("SIMULATED_BOOKED", "FILLED"))
    )


def ladder(done: Column, total: Column) -> Column:
    """PASS if all is done (of something), INCOMPLETE if some is."""
    return F.when((total > 0) & (done == total), "PASS").when(done > 0, "INCOMPLETE").otherwise("BLOCKED")
