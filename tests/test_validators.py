"""Validators: clean tables pass, every planted fault is named, sizes are those that trying every number gives."""

import datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from pitgrid.functions import scalars as S
from pitgrid.operators import validators as V
from pitgrid.plans.queries import queries

SF = "/root/testdata/sf0.001"
DAY = datetime.date


def canonical(spark, rows):
    return spark.createDataFrame(rows, "code string, d int, close decimal(18,2), raw_source string, adjusted_source string, adjust_scale decimal(6,4), close_adjusted decimal(20,4)")


def audit(spark, own, raw, adjusted):
    source = "code string, d int, close decimal(20,4), code_used string"
    raw, adjusted = (spark.createDataFrame(x, source) for x in (raw, adjusted))
    got = V.canonical_errors(canonical(spark, own), raw.withColumn("close", F.col("close").cast("decimal(18,2)")), adjusted, ["code", "d"], ["close"], ["close"], F.lit("0.5").cast("decimal(6,4)"))
    return {(r.code, r.d): r.errors for r in got.collect()}


def test_canonical_errors(spark):
    own = lambda d, close="4.00", adj="1.0000", scale="0.5": ("a", d, Decimal(close), "a", "a", scale and Decimal(scale), adj and Decimal(adj))
    src = lambda d, close: ("a", d, close and Decimal(close), "a")
    raw, adjusted = [src(d, "4.00") for d in range(6)], [src(d, "2.0000") for d in range(6)]
    assert audit(spark, [own(d) for d in range(6)], raw, adjusted) == {}
    adjusted[4] = src(4, None)
    assert audit(spark, [own(0), own(1, close="4.01"), own(2, adj="1.0001"), own(3, scale=None), own(4), own(5), own(9)], raw, adjusted) == {
        ("a", 1): ["RAW_DIFFERS:close"], ("a", 2): ["ADJUSTED_DIFFERS:close"], ("a", 3): ["SCALE_DIFFERS"], ("a", 4): ["ADJUSTED_DIFFERS:close"], ("a", 9): ["NOT_IN_SOURCE"]}
    # nothing was made up where the source has no price; repeated and lost rows are errors of their own
    assert audit(spark, [own(4, adj=None), own(4, adj=None)], raw[4:], adjusted[4:]) == {("a", 4): ["REPEATED_KEY"], ("a", 5): ["SOURCE_ROW_LOST"]}
    assert audit(spark, [], [], []) == {}


def test_segment_errors(spark):
    rows = [("a", 1, 1), ("a", 1, 2), ("a", 2, 2), ("a", 2, 3), ("a", 2, 4), ("b", 1, 7), ("b", 1, 7), ("b", 2, 8), (None, 1, 1)]
    got = V.segment_errors(spark.createDataFrame(rows, "code string, seg int, d int"), ["code"], "seg", "d", 3).collect()
    assert {(r.code, r.seg): (r.n_rows, r.errors) for r in got} == {
        ("a", 1): (2, ["OVERLAP"]), ("a", 2): (3, ["TRUNCATED", "OVERLAP"]), ("b", 1): (2, ["REPEATED_DATE"]), ("b", 2): (1, []), (None, 1): (1, [])}


def test_snapshot_errors(spark):
    d = DAY(2020, 1, 6)
    rows = [(1, "a", 1), (1, "b", 1), (2, "a", 3), (2, "b", 2), (3, "a", 1), (3, "a", 1), (4, "a", 1), (5, "a", None), (5, "b", None)]
    at = lambda k: k and d + datetime.timedelta(k)
    df = spark.createDataFrame([(at(o), m, at(u)) for o, m, u in rows], "o date, m string, u date")
    assert {(r.o - d).days: r.errors for r in V.snapshot_errors(df, "o", "u", "m", 2, 2).collect()} == {
        1: [], 2: ["SEVERAL_UPDATE_DATES", "FUTURE_UPDATE"], 3: ["REPEATED_MEMBER"], 4: ["SIZE_OUT_OF_RANGE"], 5: ["NO_UPDATE_DATE"]}


def plain_size(budget, price, minimum, step):
    def required(n):
        gross = price * n
        return gross + max(Decimal(5), (gross * Decimal("0.0003")).quantize(Decimal("0.01"), ROUND_HALF_UP)) if gross > 0 else gross

    best, n = None, minimum
    while required(n) <= budget:
        best, n = n, n + step
    return best


def test_opening_size_against_every_number(spark):
    cases = [(Decimal(c), Decimal(s), Decimal(p), Decimal(price), m, k) for price in ("0.37", "9.99", "166.65", "166.66") for c, s, p in (("20000", "18000.01", "99999"), ("16670.99", "16671", "16671"), ("5.37", "6", "7"), ("42", "41.99", "43"), ("0", "1", "1"))
             for m, k in ((100, 100), (200, 1), (1, 1))]
    df = spark.createDataFrame(cases, "c decimal(18,2), s decimal(18,2), p decimal(18,2), price decimal(18,2), m int, k int")
    got = df.select("*", S.opening_size(F.col("c"), F.col("s"), F.col("p"), F.col("price"), F.col("m"), F.col("k"), "0.0003", "5").alias("z")).collect()
    assert len({r.z.status for r in got}) == 2
    for r in got:
        want = plain_size(min(r.c, r.s, r.p), r.price, r.m, r.k)
        assert (r.z.shares, r.z.status) == ((0, "BUDGET_BELOW_MINIMUM_LOT") if want is None else (want, "SIZED_NOT_EXECUTED"))
        assert r.z.gross + r.z.fees == r.z.required <= r.z.budget and r.z.gross == r.price * r.z.shares
    bad = spark.createDataFrame([(None, Decimal(1), 100, 100), (Decimal(9), Decimal(0), 100, 100), (Decimal(9), Decimal(1), 0, 100), (Decimal(9), Decimal(1), 1, 0), (Decimal(9), Decimal(1), None, 1)], "c decimal(18,2), price decimal(18,2), m int, k int")
    sized = bad.select(S.opening_size(F.col("c"), F.lit(9).cast("decimal(18,2)"), F.lit(9).cast("decimal(18,2)"), F.col("price"), F.col("m"), F.col("k"), "0.0003", "5").alias("z")).collect()
    assert all(r.z.status == "INVALID_INPUT" and r.z.shares == 0 for r in sized)


def test_whole_shares(spark):
    d = DAY(2024, 1, 2)
    orders = spark.createDataFrame([(1, "688001", d, 4100.0), (2, "600000", d, 1999.0), (3, "600000", d, 1000.0), (4, "600000", d, 999.0), (5, "300001", d, 9.0), (6, "none", d, 9.0), (7, "688001", d, 1999.0)], "order_id long, code string, day date, requested double")
    bars = spark.createDataFrame([("688001", d, 10.0, 1.0), ("600000", d, 10.0, 1.0), ("300001", d, 10.0, 0.0)], "code string, trade_date date, open double, volume double")
    assert {r.order_id: (r.shares, r.reason) for r in V.whole_shares(orders, bars).collect()} == {
        1: (400, "CANDIDATE_NOT_FILL"), 2: (100, "CANDIDATE_NOT_FILL"), 3: (100, "CANDIDATE_NOT_FILL"), 4: (0, "CANDIDATE_BELOW_MINIMUM_SHARES"), 5: (None, "NOT_CONFIRMED_TRADABLE"), 6: (None, "MISSING_UNADJUSTED_PRICE"), 7: (0, "CANDIDATE_BELOW_MINIMUM_SHARES")}


def test_order_impact_keeps_only_the_first_samples(spark):
    d = DAY(2024, 1, 2)
    orders = spark.range(50).selectExpr("id order_id", "'a' code", "date'2024-01-02' day", "if(id % 2 = 0, 'BUY', 'SELL') side")
    ruled = spark.createDataFrame([("a", d, 11.0, True, 11.0005, 9.0)], "code string, trade_date date, open double, halted boolean, limit_up double, limit_down double")
    got = {r.reason: (r.n, r.samples) for r in V.order_impact(orders, ruled, samples=3).collect()}
    assert got == {"SUSPENDED_ORDER_DAY": (50, [0, 1, 2]), "BUY_AT_INFERRED_LIMIT_UP": (25, [0, 2, 4])}


def test_profile(spark):
    df = spark.createDataFrame([("x", "2024-01-03", " "), ("y", " ", ""), ("z", "2024-01-01 ", "1900-01-01")], "code string, date string, report_date string")
    assert V.profile(df, "f").collect()[0].asDict() == {"name": "f", "n_rows": 3, "columns": "code,date,report_date", "date_column": "date", "date_min": "2024-01-01", "date_max": "2024-01-03"}
    assert V.profile(df.select("code").limit(0), "g").collect()[0].asDict() == {"name": "g", "n_rows": 0, "columns": "code", "date_column": None, "date_min": None, "date_max": None}


def test_every_fault_of_a_watchlist_is_named(spark):
    got = {r.region: r.errors for r in queries()["watchlist_validation"](spark, SF).collect()}
    assert got[0] == "" and got[1] == "PLACES_NOT_CONSECUTIVE;ORDER_DIFFERS" and got[2] == "PLACES_NOT_CONSECUTIVE;NOT_THE_SELECTION" and got[3] == "ORDER_DIFFERS"
    assert "INDUSTRY_TWICE" in got[4] and "NOT_THE_SELECTION" in got[4]
    candidates = spark.createDataFrame([(0, 1, "i", "m"), (0, 2, "j", "m"), (0, 3, "k", "m")], "g int, id int, i string, m string")
    given = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 9, 4)], "g int, id int, place int")
    errors = V.watchlist_errors(candidates, given, given.where("id < 3"), ["g"], "id", "i", "m", 2).collect()
    assert [r.errors for r in errors] == [["NOT_A_CANDIDATE", "MECHANISM_OVER_LIMIT", "NOT_THE_SELECTION"]]


def ledger_case(spark, fills=(), lots=(), dividends=(), paid=(), **stored):
    d = DAY(2024, 1, 10)
    money = {"initial_cash": "1000", "cash": "1000", "dividend_cash": "0", "receivable": "0", "withheld": "0"} | stored
    accounts = spark.createDataFrame([("a", d, *(Decimal(money[k]) for k in ("initial_cash", "cash", "dividend_cash", "receivable", "withheld")))], "account string, as_of date, initial_cash decimal(18,2), cash decimal(18,2), dividend_cash decimal(18,2), receivable decimal(18,2), withheld decimal(18,2)")
    f = spark.createDataFrame([("a", i, x[0], DAY(2024, 1, x[1]), i, "s", x[2], Decimal(x[3]), x[4], Decimal("1")) for i, x in enumerate(fills)], "account string, at int, fill_id int, day date, seq int, code string, side string, price decimal(18,2), shares long, fees decimal(18,2)")
    e = spark.createDataFrame([("a", x[0], DAY(2024, 1, x[1]), DAY(2024, 1, x[2]), x[3], Decimal("1.00"), Decimal("0.90")) for x in dividends], "account string, event_id int, ex_date date, pay_date date, shares long, gross_per_share decimal(18,2), payment_per_share decimal(18,2)")
    held = spark.createDataFrame([("a", "s", n) for n in lots], "account string, code string, shares long")
    p = spark.createDataFrame([("a", x) for x in paid], "account string, event_id int")
    return V.account_errors(accounts, f, held, e, p).collect()[0].errors


def test_account_errors(spark):
    buy, sell = (1, 2, "BUY", "10", 20), (2, 3, "SELL", "11", 5)
    assert ledger_case(spark) == []
    assert ledger_case(spark, [buy, sell], [10, 5], cash="853") == []  # 1000 - 200 - 1 + 55 - 1
    assert ledger_case(spark, [buy, sell], [10, 6], cash="854") == ["CASH_MISMATCH", "SHARES_MISMATCH"]
    assert ledger_case(spark, [sell, buy], [15], cash="853") == ["FILL_ORDER_INVALID", "NEGATIVE_POSITION"]
    assert ledger_case(spark, [buy, (1, 11, "SELL", "10", 20)], cash="998") == ["DUPLICATE_FILL", "FUTURE_FILL"]
    paid_and_open = [(7, 4, 5, 10), (8, 6, 12, 20)]
    assert ledger_case(spark, dividends=paid_and_open, paid=[7], cash="1009", dividend_cash="9", receivable="20", withheld="1") == []
    assert ledger_case(spark, dividends=paid_and_open, paid=[7, 8, 9], cash="1027", dividend_cash="27", receivable="1", withheld="4") == ["EARLY_PAYMENT", "RECEIVABLE_MISMATCH", "UNKNOWN_PAID_EVENT", "WITHHELD_MISMATCH"]
    assert ledger_case(spark, dividends=[(7, 11, 12, 1), (7, 11, 12, 1)], receivable="2", dividend_cash="1") == ["DIVIDEND_CASH_MISMATCH", "DUPLICATE_DIVIDEND", "FUTURE_RECOGNITION"]
