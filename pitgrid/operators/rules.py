"""The complete rule sets: order checks, quality reasons, eligibility, and evidence of events, each with every reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S
from pitgrid.operators import gates as G
from pitgrid.operators import panel as P

# The order checks' reasons, in the order in which they are asked.
ORDER_REASONS = (
    "INVALID_SIDE", "INVALID_SHARES", "SIGNAL_NOT_PRIOR_DAY", "MISSING_VERIFIED_RULES", "RULES_SCOPE_MISMATCH", "NOT_CONFIRMED_TRADABLE", "INVALID_PRICE_INPUT",
    "INVALID_PRICE_BOUNDS", "PRICE_OUTSIDE_BOUNDS", "BUY_AT_UPPER_LIMIT", "SELL_AT_LOWER_LIMIT", "INVALID_QUANTITY_RULES", "BUY_QUANTITY_RULE_VIOLATION",
    "INSUFFICIENT_SELLABLE_SHARES", "MISSING_TOTAL_POSITION", "ODD_LOT_SPLIT_FORBIDDEN", "SELL_QUANTITY_POLICY_PENDING",
)
PASSED = "PRECHECK_PASS_NOT_FILL"


def order_verdict(order: str = "o", rules: str = "r") -> Column:
    """First reason against an order, or PRECHECK_PASS_NOT_FILL.

    order: struct of code, side, shares, signal_day, execution_day, price, tradable, available, total; rules: struct of
    evidence_id, code, day, lower, upper, minimum, step, sell_policy, null where no rules are known. Whatever is null
    where a value is needed counts against the order.
    """
    o, r = (lambda n: F.col(f"{order}.{n}")), (lambda n: F.col(f"{rules}.{n}"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    buy, sell = o("side") == "BUY", o("side") == "SELL"
    shares, odd = o("shares"), F.pmod(o("shares"), F.lit(100))
    whole_known = F.coalesce(o("total") >= o("available"), F.lit(False))
    hundred, two_hundred = r("sell_policy") == "ROUND100_WITH_WHOLE_REMAINDER", r("sell_policy") == "MIN200_OR_ENTIRE_BALANCE"
    asks_total = (hundred & (odd != 0)) | (two_hundred & (shares < 200))
    splits = (hundred & (odd != 0) & (odd != F.pmod(o("total"), F.lit(100)))) | (two_hundred & (shares < 200) & (shares != o("total")))
    applies = (
        no(buy | sell), no(shares > 0), no(o("signal_day") < o("execution_day")), F.coalesce(F.col(rules).isNull() | r("evidence_id").isNull() | (r("evidence_id") == ""), F.lit(True)),
        no((r("day") == o("execution_day")) & (r("code") == o("code"))), no(o("tradable")), no((o("price") > 0) & (r("lower") > 0) & (r("upper") > 0)),
        no(r("lower") < r("upper")), no(o("price").between(r("lower"), r("upper"))), buy & (o("price") == r("upper")), sell & (o("price") == r("lower")),
        buy & no((r("minimum") > 0) & (r("step") > 0)), buy & ((shares < r("minimum")) | (F.pmod(shares - r("minimum"), r("step")) != 0)),
        sell & no(o("available") >= shares), sell & F.coalesce(asks_total, F.lit(False)) & ~whole_known, sell & F.coalesce(splits, F.lit(False)), sell & no(hundred | two_hundred),
    )
    out = None
    for hit, reason in zip(applies, ORDER_REASONS, strict=True):
        hit = F.coalesce(hit, F.lit(False))
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise(PASSED)


def quality_reasons(day: Column) -> Column:
    """All sixteen reasons against a candidate on a day, in order, joined by semicolons; "" if none.

    Columns: evidence_id, checked_on, mainboard, nonfinancial, is_st, standard_audit, material_risk, listed_on, annuals
    (array of struct of year, available_on, profit, cash, roe), ttm_profit, ttm_available_on, median_amount. A flag counts
    only if it is known to be as it should.
    """
    annuals, three = F.col("annuals"), F.coalesce(F.size("annuals") == 3, F.lit(False))
    each = lambda f: F.transform(annuals, f)
    total = lambda name: F.aggregate(each(lambda a: a[name].cast("double")), F.lit(0.0), lambda s, x: s + x)
    window = F.sequence(F.year(day) - 3, F.year(day) - 1)
    years_fit = three & (F.array_sort(F.array_distinct(each(lambda a: a["year"].cast("int")))) == window)
    available = F.coalesce(F.forall(annuals, lambda a: (a["available_on"] <= day) & (a["available_on"] > F.make_date(a["year"].cast("int"), F.lit(12), F.lit(31)))), F.lit(False))
    valued = three & F.coalesce(F.forall(annuals, lambda a: S.finite(a["profit"]).isNotNull() & S.finite(a["cash"]).isNotNull() & S.finite(a["roe"]).isNotNull()), F.lit(False))
    ratio = total("cash") / F.nullif(total("profit"), F.lit(0.0))
    listed = F.add_months("listed_on", 36)
    unlike = lambda name, expected: ~F.col(name).eqNullSafe(F.lit(expected))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return G.all_reasons(
        (no((F.trim("evidence_id") != "") & (F.col("checked_on") == day)), "MISSING_CURRENT_EVIDENCE"),
        (unlike("mainboard", True), "MAINBOARD_NOT_CONFIRMED"), (unlike("nonfinancial", True), "NONFINANCIAL_NOT_CONFIRMED"), (unlike("is_st", False), "NON_ST_NOT_CONFIRMED"),
        (unlike("standard_audit", True), "STANDARD_AUDIT_NOT_CONFIRMED"), (unlike("material_risk", False), "NO_MATERIAL_RISK_NOT_CONFIRMED"),
        (no(day >= listed), "LISTING_LESS_THAN_THREE_YEARS"), (~years_fit, "ANNUAL_WINDOW_INVALID"), (~available, "ANNUAL_AVAILABILITY_INVALID"), (~valued, "MISSING_TOTAL_FINANCIAL_VALUES"),
        (valued & no(F.forall(annuals, lambda a: a["profit"] > 0)), "ANNUAL_PROFIT_FAILED"),
        (valued & (F.size(F.filter(annuals, lambda a: a["cash"] > 0)) < 2), "OPERATING_CASHFLOW_FAILED"),
        (valued & no((total("profit") > 0) & (ratio >= 0.8)), "CASH_PROFIT_RATIO_FAILED"),
        (valued & no(F.get(F.array_sort(each(lambda a: a["roe"].cast("double"))), F.lit(1)) >= 10), "ROE_FAILED"),
        (no((F.col("ttm_available_on") <= day) & (F.col("ttm_profit") > 0)), "TTM_PROFIT_UNAVAILABLE_OR_FAILED"),
        (no(S.finite(F.col("median_amount")) >= 20_000_000), "LIQUIDITY_UNAVAILABLE_OR_FAILED"),
    )


def eligibility(rows: DataFrame, window: int, most_halts: int, longest_halt: int, recent: int, most_recent: int, cooldown: int, deviation_rows: int, amount_rows: int, least_amount: float) -> DataFrame:
    """rows with reason: the first of twelve checks that a row fails, or ELIGIBLE.

    rows: code, trade_date, cal_idx, halted, special, open, high, low, close, preclose, volume, amount, adjusted. A window
    holds the row and `window` rows before it; halts are counted in it, the longest run inside it, and apart from that in
    the `recent` rows before the row; the row must be the `cooldown`-th traded one in a row at least.
    """
    back = lambda n: P.rows(-n, 0)
    halt = F.when(F.col("halted"), 1)
    price_ok = F.when(F.col("adjusted") > 0, 1)
    halts = P.halt_features("halted", window + 1, recent)
    f = rows.withColumn("row_no", F.row_number().over(P.series()))
    f = f.select(
        "*", F.lag("cal_idx", window).over(P.series()).alias("_first"), F.count(halt).over(back(window)).alias("_halts"), halts["longest_halt"].alias("_longest"),
        F.count(halt).over(P.rows(-recent, -1)).alias("_recent"), F.max(F.when(F.col("halted"), F.col("cal_idx"))).over(back(window)).alias("_last_halt"), F.count(price_ok).over(back(window)).alias("_prices"),
        F.count(price_ok).over(back(deviation_rows)).alias("_dev"), F.count(F.when(F.col("amount") >= 0, 1)).over(back(amount_rows - 1)).alias("_amounts"), F.percentile("amount", F.lit(0.5)).over(back(amount_rows - 1)).alias("_median"),
    )
    f = f.withColumn("_live", F.when(F.col("halted"), 0).otherwise(F.coalesce(F.col("cal_idx") - F.col("_last_halt"), F.lit(window + 1))))
    current = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("open", "high", "low", "close", "preclose", "volume", "amount")])
    reason = G.first_reason(
        (F.col("halted"), "HALTED"), (F.col("special"), "SPECIAL_TREATMENT"), (F.col("row_no") <= window, "SHORT_HISTORY"), (F.col("cal_idx") - F.col("_first") != window, "CALENDAR_GAP"),
        (F.col("_halts") > most_halts, "TOO_MANY_HALTS"), (F.col("_longest") > longest_halt, "LONG_HALT"), (F.col("_recent") > most_recent, "RECENT_HALT"), (F.col("_live") < cooldown, "RESUMED_TOO_RECENTLY"),
        (F.col("_prices") < window + 1, "BAD_PRICE_IN_WINDOW"), (~current, "BAD_CURRENT_VALUES"), (F.col("_amounts") < amount_rows, "BAD_AMOUNT"), (F.col("_median") < least_amount, "LOW_AMOUNT"), otherwise="ELIGIBLE")
    return f.withColumn("reason", reason).select(*rows.columns, "reason")


# ---- evidence of events

# Fixed values.
EVENT_TYPES = ("DELISTING", "MERGER", "CODE_CHANGE", "DATA_INTERRUPTION")
ACTION_TYPES = ("MERGER_AND_TERMINATION", "DEMERGER_AND_TERMINATION")
PRICE_BASES = ("AUCTION", "SETTLEMENT", "LAST_TRADE", "UNKNOWN")


def _missing(*names: str) -> Column:
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in names]))
    return F.when(F.size(gaps) > 0, F.concat(F.lit("MISSING:"), F.array_join(gaps, ",")))


def _iso(c: str) -> Column:
    return F.when(F.col(c).rlike(r"^\d{4}-\d\d-\d\d$"), F.col(c).try_cast("date"))


def _decimal(c: Column) -> Column:
    return c.try_cast("decimal(38,10)")


def event_evidence_problem(settled: bool, types: tuple[str, ...] = EVENT_TYPES) -> Column:
    """First problem of an event's evidence (text columns), "" if none. With settled, the day of settlement must be known, not
    before the last day of trade, and a price of a known basis positive; without, UNKNOWN goes with a price of "0"."""
    effective, last, settlement = _iso("effective_date"), _iso("last_tradable_date"), _iso("settlement_date")
    price, unknown = _decimal(F.col("settlement_price")), F.col("price_basis") == "UNKNOWN"
    no_day = effective.isNull() | last.isNull() | price.isNull() | (settlement.isNull() if settled else settlement.isNull() & (F.col("settlement_date") != "UNKNOWN"))
    out_of_order = (last > effective) | (settlement < last) if settled else last > effective
    bad_price = F.when((price <= 0) & ~unknown, "PRICE_NOT_POSITIVE") if settled else F.when(unknown & (F.col("settlement_price") != "0"), "UNKNOWN_BASIS_WITH_PRICE")
    missing = _missing("code", "event_type", "effective_date", "last_tradable_date", "settlement_date", "settlement_price", "price_basis", "source", "source_as_of", "sha256")
    return F.coalesce(
        missing, F.when(~F.col("event_type").isin(*types), "UNKNOWN_EVENT_TYPE"), F.when(~F.col("price_basis").isin(*PRICE_BASES), "UNKNOWN_PRICE_BASIS"),
        F.when(no_day, "BAD_DATE_OR_PRICE"), F.when(out_of_order, "DATES_OUT_OF_ORDER"), bad_price, F.lit(""),
    )


def action_evidence_problem() -> Column:
    """First problem of a corporate action's evidence; successors is an array of struct of code and share_ratio (text)."""
    missing = _missing("source_code", "event_type", "effective_date", "cash_option", "settlement_price", "price_basis", "source", "source_as_of")
    some = lambda f: F.exists("successors", f)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.coalesce(
        missing, F.when(~F.col("event_type").isin(*ACTION_TYPES), "UNKNOWN_ACTION_TYPE"), F.when(_iso("effective_date").isNull() | _decimal(F.col("settlement_price")).isNull(), "BAD_DATE_OR_PRICE"),
        F.when(F.coalesce(F.size("successors"), F.lit(0)) <= 0, "NO_SUCCESSOR"), F.when(some(lambda s: blank(s["code"]) | blank(s["share_ratio"])), "SUCCESSOR_INCOMPLETE"),
        F.when(some(lambda s: ~s["code"].rlike(r"^[0-9]{6}$")), "BAD_SUCCESSOR_CODE"), F.when(some(lambda s: _decimal(s["share_ratio"]).isNull()), "BAD_SHARE_RATIO"),
        F.when(some(lambda s: _decimal(s["share_ratio"]) <= 0), "SHARE_RATIO_NOT_POSITIVE"), F.when((F.col("price_basis") == "UNKNOWN") & (F.col("settlement_price") != "0"), "UNKNOWN_BASIS_WITH_PRICE"), F.lit(""),
    )


def dividend_probe(year: Column) -> tuple[Column, Column]:
    """(errors, reviews), two arrays: what makes a reported dividend unusable, and what a person must look at.

    Columns, all text: code, reported_code, register_date, ex_date, pay_date, gross_cash, net_cash, stock_share, reserve_share.
    """
    register, ex, pay = _iso("register_date"), _iso("ex_date"), _iso("pay_date")
    dated = register.isNotNull() & ex.isNotNull() & pay.isNotNull()
    number = lambda c: F.coalesce(_decimal(F.col(c)) >= 0, F.lit(False))
    listed = lambda *rules: F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(reason)) for hit, reason in rules]))
    errors = listed(
        (~F.col("reported_code").eqNullSafe(S.market_prefix(F.col("code"))), "SECURITY_MISMATCH"), (dated & ~((register < ex) & (ex <= pay)), "INVALID_DATE_ORDER"), (dated & (F.year(ex) != year), "QUERY_YEAR_MISMATCH"),
        (~dated, "MISSING_OR_INVALID_DATE"), (~number("gross_cash"), "INVALID_GROSS_CASH"))
    reviews = listed((~number("net_cash"), "NET_CASH_NOT_SINGLE_NUMBER"), (~number("stock_share"), "UNRESOLVED_stock_share"), (~number("reserve_share"), "UNRESOLVED_reserve_share"))
    return errors, reviews
