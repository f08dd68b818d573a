"""Scalar functions as column expressions. Whatever can't be read is null, never zero and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing number.
MISSING = ("", "false", "none", "null", "nan", "--", "-")
#: Code prefixes of boards.
STAR, CHINEXT, BSE = ("688", "689"), ("300", "301", "302"), ("430", "83", "87", "920")


def finite(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def positive(c: Column) -> Column:
    d = finite(c)
    return F.when(d > 0, d)


def parse_number(text: Column) -> Column:
    """Grouping commas, units of ten thousand and of a hundred million, per cent."""
    t = F.regexp_replace(F.trim(text), ",", "")
    bare = F.regexp_replace(t, "[万亿%]$", "")
    scale = F.when(t.endswith("万"), 1e4).when(t.endswith("亿"), 1e8).when(t.endswith("%"), 0.01).otherwise(1.0)
    return F.when(~F.lower(t).isin(*MISSING), finite(bare) * scale)


def assumed_available_date(period: Column) -> Column:
    """When a report of the period is taken as known, if it isn't dated: by the filing limit of its quarter."""
    y, tail = F.year(period), F.date_format(period, "MM-dd")
    on = lambda year, m, d: F.make_date(year, F.lit(m), F.lit(d))
    return F.when(tail == "03-31", on(y, 5, 15)).when(tail == "06-30", on(y, 8, 31)).when(tail == "09-30", on(y, 11, 15)).when(tail == "12-31", on(y + 1, 4, 30)).otherwise(F.date_add(period, 120))


def board_of(code: Column) -> Column:
    starts = lambda prefixes: F.greatest(*[code.startswith(p) for p in prefixes])
    return F.when(starts(STAR), "star").when(starts(CHINEXT), "chinext").when(starts(BSE), "bse").otherwise("main")


def price_limit_ratio(board: Column, special: Column, day: Column) -> Column:
    """Daily limit as a share of the close before; a special-treatment main board share has 5 % before the change."""
    wide = F.when(board.isin("star", "chinext"), 0.2).when(board == "bse", 0.3)
    tight = special & day.isNotNull() & (day < F.lit("2026-07-06").cast("date"))
    return F.coalesce(wide, F.when(F.coalesce(tight, F.lit(False)), 0.05).otherwise(0.1)).cast("decimal(4,2)")


def market_prefix(code: Column) -> Column:
    return F.concat(F.when(F.left(code, F.lit(1)).isin("5", "6", "9"), "sh.").otherwise("sz."), code)


def half_up(c: Column, places: int = 2) -> Column:
    """On decimals, away from zero at the half."""
    return F.round(c, places)


def round_binary(c: Column, places: int) -> Column:
    """Doubles as C's round(c * 10**places) / 10**places, which SQL engines use; F.round() goes by the decimal text, where a
    half can lie that the product misses."""
    t = F.abs(c.cast("double")) * 10.0**places
    whole = F.floor(t).cast("double")
    return F.signum(c) * (whole + F.when(t - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**places


def round_up(c: Column) -> Column:
    """To whole hundredths, away from zero; for c >= 0."""
    return F.ceil(c, F.lit(2))


def commission(gross: Column, rate: str, least: str) -> Column:
    """A share of the gross, at least `least`, rounded half up; none on nothing."""
    fee = F.greatest(F.lit(least).cast("decimal(18,2)"), half_up(gross * F.lit(rate).cast("decimal(8,6)")).cast("decimal(18,2)"))
    return F.when(gross > 0, fee).otherwise(F.lit(0).cast("decimal(18,2)"))


def stamp_tax(gross: Column, day: Column, side: Column) -> Column:
    """Sellers only; the rate was halved on 2023-08-28."""
    rate = F.when(day >= F.lit("2023-08-28").cast("date"), F.lit("0.0005").cast("decimal(8,6)")).otherwise(F.lit("0.001").cast("decimal(8,6)"))
    return F.when(side == "SELL", half_up(gross * rate).cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))


def holding_band(acquired: Column, sold: Column) -> Column:
    """Held through the day before the sale: up to a month, up to a year, longer."""
    held = F.date_sub(sold, 1)
    return F.when(held >= F.add_months(acquired, 12), "OVER_ONE_YEAR").when(held >= F.add_months(acquired, 1), "ONE_MONTH_TO_ONE_YEAR").otherwise("UP_TO_ONE_MONTH")


def dividend_tax(gross: Column, band: Column) -> Column:
    share = F.when(band == "UP_TO_ONE_MONTH", "1").when(band == "ONE_MONTH_TO_ONE_YEAR", "0.5").otherwise("0").cast("decimal(4,2)")
    return half_up(gross * F.lit("0.2").cast("decimal(4,2)") * share).cast("decimal(18,2)")


def whole_lots(budget: Column, price: Column, lot: int = 100) -> Column:
    return (F.floor(budget / price / lot) * lot).cast("long")


def affordable_lots(cash: Column, price: Column, rate: str, least: str, lot: int = 100) -> Column:
    """Largest number of whole lots whose cost and commission cash covers. The commission is either the least or a share, so
    the answer lies within a lot of what either alone would allow."""
    unit = price * lot
    guesses = [F.floor((cash - F.lit(least).cast("decimal(18,2)")) / unit), F.floor(cash / (unit * (1 + F.lit(rate).cast("decimal(8,6)"))))]
    cost = lambda n: (unit * n).cast("decimal(18,2)") + commission((unit * n).cast("decimal(18,2)"), rate, least)
    tries = F.array(*[F.greatest((guess + k).cast("bigint"), F.lit(0).cast("bigint")) for guess in guesses for k in (-1, 0, 1)])
    return F.coalesce(F.array_max(F.filter(tries, lambda n: (n == 0) | (cost(n) <= cash))), F.lit(0).cast("bigint")) * lot


def opening_size(cash: Column, single: Column, portfolio: Column, price: Column, minimum: Column, step: Column, rate: str, least: str) -> Column:
    """The largest legal purchase, minimum + k step shares, whose cost and commission stay within the least of three budgets:
    a struct of status, shares, gross, fees, required and budget. Amounts are non-negative decimals; what can't be read, or
    a price, minimum or step that isn't positive, is INVALID_INPUT with no shares."""
    money = "decimal(18,2)"
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a value that is worked out once
    within = F.when(cash.isNotNull() & single.isNotNull() & portfolio.isNotNull(), F.least(cash, single, portfolio)).cast(money)

    def sized(i: Column) -> Column:
        # the commission is either the least or a share: the answer lies within a step of what either alone would allow
        alone = [(i.budget - F.lit(least).cast(money)) / i.price, i.budget / (i.price * (1 + F.lit(rate).cast("decimal(8,6)")))]
        near = F.flatten(F.transform(F.array(*[F.floor((n - i.minimum) / i.step).cast("bigint") for n in alone]), lambda at: F.array(at - 1, at, at + 1)))
        steps = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(near, lambda k: F.greatest(k, F.lit(0).cast("bigint")))))
        tries = F.transform(steps, lambda k: (i.minimum + k * i.step).cast("bigint"))
        costs = F.transform(F.transform(tries, lambda n: F.struct(n.alias("shares"), (i.price * n).cast(money).alias("gross"))), lambda x: F.struct(x.shares.alias("shares"), x.gross.alias("gross"), commission(x.gross, rate, least).alias("fees")))
        fits = F.filter(costs, lambda x: (x.gross + x.fees).cast(money) <= i.budget)
        return F.array_max(fits)  # most shares: they come first

    bad = lambda i: ~F.coalesce((i.budget >= 0) & (i.price > 0) & (i.minimum > 0) & (i.step > 0), F.lit(False))
    nothing = F.lit(0).cast(money)
    out = lambda status, x, i: F.struct(F.lit(status).alias("status"), F.coalesce(x.shares, F.lit(0).cast("bigint")).alias("shares"), F.coalesce(x.gross, nothing).alias("gross"), F.coalesce(x.fees, nothing).alias("fees"), F.coalesce((x.gross + x.fees).cast(money), nothing).alias("required"), i.budget.alias("budget"))
    known = F.struct(within.alias("budget"), price.alias("price"), minimum.alias("minimum"), step.alias("step"))
    return let(known, lambda i: let(
        F.when(~bad(i), sized(i)), lambda x: F.when(bad(i), out("INVALID_INPUT", x, i)).when(x.isNull(), out("BUDGET_BELOW_MINIMUM_LOT", x, i)).otherwise(out("SIZED_NOT_EXECUTED", x, i))))


def phase_of(year: Column) -> Column:
    return F.when(year <= 1996, "EARLY").when(year <= 1998, "MIDDLE").when(year <= 2000, "LATE").otherwise("LAST")
