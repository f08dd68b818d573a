"""The complete rule sets over the tables; what rows lack is planted by the remainders of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.operators import panel as P
from pitgrid.operators import rules as R
from pitgrid.plans import adapters as A
from pitgrid.plans.registry import query, with_parts

T = A.table


@query("PF09 PF10 JN11", """WITH o AS (SELECT o_orderkey AS k, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, CASE WHEN o_orderkey % 23 = 0 THEN 'HOLD' WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE (o_orderkey // 2 % 12 + 1) * 50 + CASE WHEN o_orderkey % 5 = 1 THEN 30 ELSE 0 END END AS shares,
        o_orderkey % 17 = 0 AS same_day, CASE WHEN o_orderkey % 13 = 0 THEN 2 WHEN o_orderkey % 13 = 1 THEN 1 ELSE 0 END AS no_rules, o_orderkey % 11 IN (0, 1) AS other_scope, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END AS tradable,
        CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE o_orderkey // 2 % 50 + 1 END AS price, 10 AS lo, CASE WHEN o_orderkey % 31 = 0 THEN 10 ELSE 40 END AS hi, CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE 100 END AS minimum, CASE WHEN o_orderkey % 3 = 0 THEN 50 ELSE 100 END AS step,
        o_orderkey // 2 % 4 * 200 + 30 AS available, CASE WHEN o_orderkey % 7 <> 2 THEN o_orderkey // 2 % 4 * 200 + 30 + o_orderkey // 2 % 6 * 10 END AS total, ['ROUND100_WITH_WHOLE_REMAINDER', 'MIN200_OR_ENTIRE_BALANCE', 'OTHER'][1 + o_orderkey // 2 % 3] AS policy FROM orders)
    SELECT k, CASE WHEN side NOT IN ('BUY', 'SELL') THEN 'INVALID_SIDE' WHEN shares <= 0 THEN 'INVALID_SHARES' WHEN same_day THEN 'SIGNAL_NOT_PRIOR_DAY' WHEN no_rules > 0 THEN 'MISSING_VERIFIED_RULES' WHEN other_scope THEN 'RULES_SCOPE_MISMATCH' WHEN tradable IS DISTINCT FROM true THEN 'NOT_CONFIRMED_TRADABLE' WHEN price <= 0 THEN 'INVALID_PRICE_INPUT'
        WHEN lo >= hi THEN 'INVALID_PRICE_BOUNDS' WHEN price < lo OR price > hi THEN 'PRICE_OUTSIDE_BOUNDS' WHEN side = 'BUY' AND price = hi THEN 'BUY_AT_UPPER_LIMIT' WHEN side = 'SELL' AND price = lo THEN 'SELL_AT_LOWER_LIMIT'
        WHEN side = 'BUY' THEN CASE WHEN minimum <= 0 THEN 'INVALID_QUANTITY_RULES' WHEN shares < minimum OR (shares - minimum) % step <> 0 THEN 'BUY_QUANTITY_RULE_VIOLATION' ELSE 'PRECHECK_PASS_NOT_FILL' END
        WHEN available < shares THEN 'INSUFFICIENT_SELLABLE_SHARES' WHEN policy = 'OTHER' THEN 'SELL_QUANTITY_POLICY_PENDING'
        WHEN policy LIKE 'ROUND%' AND shares % 100 = 0 OR policy LIKE 'MIN%' AND shares >= 200 THEN 'PRECHECK_PASS_NOT_FILL' WHEN total IS NULL THEN 'MISSING_TOTAL_POSITION'
        WHEN policy LIKE 'ROUND%' AND shares % 100 <> total % 100 OR policy LIKE 'MIN%' AND shares <> total THEN 'ODD_LOT_SPLIT_FORBIDDEN' ELSE 'PRECHECK_PASS_NOT_FILL' END AS verdict FROM o""")
def complete_order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventeen checks of every order against the rules of its day."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    half = F.floor(k / 2)
    whole = lambda c: c.cast("long")
    money = lambda c: c.cast("decimal(18,2)")
    code = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    shares = F.when(k % 19 == 0, 0).otherwise((half % 12 + 1) * 50 + F.when(k % 5 == 1, 30).otherwise(0))
    policy = F.get(F.array(*[F.lit(p) for p in ("ROUND100_WITH_WHOLE_REMAINDER", "MIN200_OR_ENTIRE_BALANCE", "OTHER")]), (half % 3).cast("int"))
    available = half % 4 * 200 + 30
    order = F.struct(
        code.alias("code"), F.when(k % 23 == 0, "HOLD").when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), whole(shares).alias("shares"), F.date_sub(d, F.when(k % 17 == 0, 0).otherwise(1)).alias("signal_day"), d.alias("execution_day"),
        money(F.when(k % 29 == 0, 0).otherwise(half % 50 + 1)).alias("price"), F.when(k % 10 == 3, False).when(k % 10 != 0, True).alias("tradable"), whole(available).alias("available"), whole(F.when(k % 7 != 2, available + half % 6 * 10)).alias("total"))
    known = F.struct(
        F.when(k % 13 == 1, "").otherwise("e1").alias("evidence_id"), F.when(k % 11 == 0, "999999x").otherwise(code).alias("code"), F.when(k % 11 == 1, F.date_add(d, 1)).otherwise(d).alias("day"), money(F.lit(10)).alias("lower"), money(F.when(k % 31 == 0, 10).otherwise(40)).alias("upper"),
        whole(F.when(k % 37 == 0, 0).otherwise(100)).alias("minimum"), whole(F.when(k % 3 == 0, 50).otherwise(100)).alias("step"), policy.alias("sell_policy"))
    o = T(spark, sf_dir, "orders").select(k.alias("k"), order.alias("o"), F.when(k % 13 != 0, known).alias("r"))
    return o.select("k", R.order_verdict().alias("verdict"))


@query("PF11 CQ08", """WITH y AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) - 150000 AS profit, CAST(sum(CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 40000 END AS DECIMAL(18,2))) AS DOUBLE) - 60000 AS cash, CAST(count(*) AS DOUBLE) * 4 AS roe FROM orders GROUP BY ALL),
    w AS (SELECT k, y, CASE WHEN (k + y) % 31 = 3 THEN NULL ELSE profit END AS profit, cash, roe, CASE WHEN (k + y) % 7 = 2 THEN make_date(y + 1, 8, 30) WHEN (k + y) % 13 = 5 THEN make_date(y, 12, 31) ELSE make_date(y + 1, 4, 30) END AS av FROM y WHERE y BETWEEN 1998 AND 2000 OR y = 1997 AND k % 9 = 1),
    a AS (SELECT k, count(*) AS n, count(DISTINCT y) FILTER (y >= 1998) AS inside, bool_and(av <= DATE '2001-06-30' AND av > make_date(y, 12, 31)) AS av_ok, count(profit) AS valued, bool_and(profit > 0) AS pos, count(*) FILTER (cash > 0) AS cashes, sum(profit) AS sp, sum(cash) AS sc, quantile_cont(roe, 0.5) AS med FROM w GROUP BY 1),
    c AS (SELECT c_custkey AS k, c_acctbal AS b, coalesce(n, 0) AS n, coalesce(inside, 0) AS inside, coalesce(av_ok, true) AS av_ok, coalesce(valued, 0) = 3 AND coalesce(n, 0) = 3 AS ok, pos, cashes, sp, sc, med FROM customer LEFT JOIN a ON a.k = c_custkey)
    SELECT k, concat_ws(';', CASE WHEN k % 8 IN (0, 1) THEN 'MISSING_CURRENT_EVIDENCE' END, CASE WHEN k % 5 IN (0, 1) THEN 'MAINBOARD_NOT_CONFIRMED' END, CASE WHEN k % 10 = 7 THEN 'NONFINANCIAL_NOT_CONFIRMED' END, CASE WHEN k % 11 IN (2, 3) THEN 'NON_ST_NOT_CONFIRMED' END, CASE WHEN k % 12 = 5 THEN 'STANDARD_AUDIT_NOT_CONFIRMED' END, CASE WHEN k % 14 IN (6, 7) THEN 'NO_MATERIAL_RISK_NOT_CONFIRMED' END,
        CASE WHEN k % 16 IN (4, 5) THEN 'LISTING_LESS_THAN_THREE_YEARS' END, CASE WHEN n <> 3 OR inside <> 3 THEN 'ANNUAL_WINDOW_INVALID' END, CASE WHEN NOT av_ok THEN 'ANNUAL_AVAILABILITY_INVALID' END, CASE WHEN NOT ok THEN 'MISSING_TOTAL_FINANCIAL_VALUES' END, CASE WHEN ok AND NOT pos THEN 'ANNUAL_PROFIT_FAILED' END, CASE WHEN ok AND cashes < 2 THEN 'OPERATING_CASHFLOW_FAILED' END,
        CASE WHEN ok AND (sp <= 0 OR sc / sp < 0.8) THEN 'CASH_PROFIT_RATIO_FAILED' END, CASE WHEN ok AND med < 10 THEN 'ROE_FAILED' END, CASE WHEN k % 18 = 3 OR b <= 0 THEN 'TTM_PROFIT_UNAVAILABLE_OR_FAILED' END, CASE WHEN k % 20 IN (5, 6) OR b * 5000 < 20000000 THEN 'LIQUIDITY_UNAVAILABLE_OR_FAILED' END) AS reasons FROM c""")
def complete_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen reasons against every customer on a day, its orders of a year standing for an annual report."""
    o, day = T(spark, sf_dir, "orders"), F.lit("2001-06-30").cast("date")
    cents = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    year = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y")).agg(
        (cents(F.col("o_totalprice")) - 150_000).alias("profit"), (cents(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(40_000)) - 60_000).alias("cash"), (F.count("*") * 4).cast("double").alias("roe"))
    s, y = F.col("k") + F.col("y"), F.col("y")
    on = lambda shift, m, d: F.make_date((y + shift).cast("int"), F.lit(m), F.lit(d))
    available = F.when(s % 7 == 2, on(1, 8, 30)).when(s % 13 == 5, on(0, 12, 31)).otherwise(on(1, 4, 30))
    annual = F.struct(y.alias("year"), available.alias("available_on"), F.when(s % 31 != 3, F.col("profit")).alias("profit"), "cash", "roe")
    annuals = year.where(y.between(1998, 2000) | ((y == 1997) & (F.col("k") % 9 == 1))).groupBy("k").agg(F.array_sort(F.collect_list(annual)).alias("annuals"))  # four years at most
    c = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b")).join(annuals, "k", "left")
    k = F.col("k")
    flag = lambda m, wrong, null, right: F.when(k % m == wrong, not right).when(k % m != null, right)
    evidence = c.select(
        "k", F.when(k % 8 == 0, " ").otherwise("e").alias("evidence_id"), F.date_sub(day, F.when(k % 8 == 1, 1).otherwise(0)).alias("checked_on"), flag(5, 0, 1, True).alias("mainboard"), flag(10, 7, 7, True).alias("nonfinancial"), flag(11, 2, 3, False).alias("is_st"),
        flag(12, 5, 5, True).alias("standard_audit"), flag(14, 6, 7, False).alias("material_risk"), F.when(k % 16 == 4, F.lit("1998-07-01").cast("date")).when(k % 16 != 5, F.lit("1998-06-30").cast("date")).alias("listed_on"),
        F.coalesce("annuals", F.array().cast(annuals.schema["annuals"].dataType)).alias("annuals"), F.col("b").alias("ttm_profit"), F.date_add(day, F.when(k % 18 == 3, 1).otherwise(0)).alias("ttm_available_on"),
        F.when(k % 20 == 5, F.lit(float("nan"))).when(k % 20 != 6, F.col("b") * 5000).alias("median_amount"))
    return evidence.select("k", R.quality_reasons(day).alias("reasons"))


@query("PF06 CQ16 WN04", with_parts("monthly", "months") + """, b AS (SELECT m.*, cal_idx AS i, CAST(code AS BIGINT) AS n, volume < 40 AS halted, CAST(code AS BIGINT) % 10 = 3 AND month(trade_date) = 5 AS special, CASE WHEN CAST(code AS BIGINT) % 9 = 4 AND trade_date = DATE '1998-03-01' THEN 0 ELSE close END AS adjusted, lag(close) OVER w AS preclose,
        CASE WHEN CAST(code AS BIGINT) % 8 = 5 AND month(trade_date) = 11 AND year(trade_date) = 1999 THEN NULL ELSE amount END AS am, row_number() OVER w AS r FROM monthly m JOIN months USING (trade_date) WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    g AS (SELECT *, r - coalesce(max(CASE WHEN NOT halted THEN r END) OVER (PARTITION BY code ORDER BY r), 0) AS run FROM b),
    f AS (SELECT a.code, a.trade_date, a.halted, a.special, a.r, a.i, a.preclose, a.open, a.am, any_value(x.i) FILTER (x.r = a.r - 24) AS first_i, count(*) FILTER (x.halted) AS halts, max(CASE WHEN x.halted THEN least(x.run, x.r - greatest(1, a.r - 24) + 1) ELSE 0 END) AS longest, count(*) FILTER (x.halted AND x.r BETWEEN a.r - 3 AND a.r - 1) AS recent,
            max(CASE WHEN x.halted THEN x.i END) AS last_halt, count(*) FILTER (x.adjusted > 0) AS prices, count(*) FILTER (x.am >= 0 AND x.r > a.r - 5) AS ams, quantile_cont(x.am, 0.5) FILTER (x.r > a.r - 5) AS med FROM g a JOIN g x ON x.code = a.code AND x.r BETWEEN a.r - 24 AND a.r GROUP BY ALL)
    SELECT code, trade_date, CASE WHEN halted THEN 'HALTED' WHEN special THEN 'SPECIAL_TREATMENT' WHEN r <= 24 THEN 'SHORT_HISTORY' WHEN i - first_i <> 24 THEN 'CALENDAR_GAP' WHEN halts > 4 THEN 'TOO_MANY_HALTS' WHEN longest > 1 THEN 'LONG_HALT' WHEN recent > 0 THEN 'RECENT_HALT' WHEN coalesce(i - last_halt, 25) < 5 THEN 'RESUMED_TOO_RECENTLY' WHEN prices < 25 THEN 'BAD_PRICE_IN_WINDOW'
        WHEN NOT coalesce(preclose > 0 AND am > 0, false) THEN 'BAD_CURRENT_VALUES' WHEN ams < 5 THEN 'BAD_AMOUNT' WHEN med < 180000 THEN 'LOW_AMOUNT' ELSE 'ELIGIBLE' END AS reason FROM f""")
def complete_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve checks of every monthly bar, over windows of 25 months."""
    m, n = A.monthly(spark, sf_dir), F.col("code").cast("long")
    b = m.join(F.broadcast(P.calendar(m)), "trade_date").select(
        "code", "trade_date", "cal_idx", (F.col("volume") < 40).alias("halted"), ((n % 10 == 3) & (F.month("trade_date") == 5)).alias("special"), "open", "high", "low", "close", P.lagged("close", 1).alias("preclose"), "volume",
        F.when(~((n % 8 == 5) & (F.month("trade_date") == 11) & (F.year("trade_date") == 1999)), F.col("amount")).alias("amount"), F.when((n % 9 == 4) & (F.col("trade_date") == F.lit("1998-03-01").cast("date")), 0.0).otherwise(F.col("close")).alias("adjusted"))
    out = R.eligibility(b, window=24, most_halts=4, longest_halt=1, recent=3, most_recent=0, cooldown=5, deviation_rows=12, amount_rows=5, least_amount=180_000)
    return out.select("code", "trade_date", "reason")


@query("PF13 PF14", """WITH p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k, CASE WHEN k % 31 = 0 THEN 'MISSING:source,sha256' WHEN k % 29 = 1 THEN 'UNKNOWN_EVENT_TYPE' WHEN k % 23 = 2 THEN 'UNKNOWN_PRICE_BASIS' WHEN k % 19 = 3 OR k % 21 = 10 THEN 'BAD_DATE_OR_PRICE' END AS base, k % 17 = 4 AS late, k % 13 = 5 AND k % 23 <> 2 AS basis, CASE WHEN k % 21 = 10 THEN 3 ELSE k % 11 END AS price, k % 7 = 6 AS undated, k % 27 = 8 AS early FROM p)
    SELECT k, coalesce(base, CASE WHEN late THEN 'DATES_OUT_OF_ORDER' WHEN basis AND price <> 0 THEN 'UNKNOWN_BASIS_WITH_PRICE' ELSE '' END) AS event_problem,
        coalesce(base, CASE WHEN undated THEN 'BAD_DATE_OR_PRICE' WHEN late OR early THEN 'DATES_OUT_OF_ORDER' WHEN price = 0 AND NOT basis THEN 'PRICE_NOT_POSITIVE' ELSE '' END) AS delisting_problem,
        CASE WHEN k % 31 = 0 THEN 'MISSING:source' WHEN k % 29 = 1 THEN 'UNKNOWN_ACTION_TYPE' WHEN k % 19 = 3 THEN 'BAD_DATE_OR_PRICE' WHEN k % 10 = 0 THEN 'NO_SUCCESSOR' WHEN k % 10 = 1 THEN 'SUCCESSOR_INCOMPLETE' WHEN k % 10 = 2 THEN 'BAD_SUCCESSOR_CODE' WHEN k % 10 = 3 THEN 'BAD_SHARE_RATIO' WHEN k % 10 = 4 THEN 'SHARE_RATIO_NOT_POSITIVE' WHEN basis AND price <> 0 THEN 'UNKNOWN_BASIS_WITH_PRICE' ELSE '' END AS action_problem,
        concat_ws(';', CASE WHEN k % 9 = 4 THEN 'SECURITY_MISMATCH' END, CASE WHEN k % 19 <> 3 AND (late OR k % 16 = 7) THEN 'INVALID_DATE_ORDER' END, CASE WHEN k % 19 <> 3 AND k % 16 = 7 THEN 'QUERY_YEAR_MISMATCH' END, CASE WHEN k % 19 = 3 THEN 'MISSING_OR_INVALID_DATE' END, CASE WHEN k % 14 = 8 THEN 'INVALID_GROSS_CASH' END) AS errors,
        concat_ws(';', CASE WHEN k % 6 = 1 THEN 'NET_CASH_NOT_SINGLE_NUMBER' END, CASE WHEN k % 8 = 3 THEN 'UNRESOLVED_stock_share' END, CASE WHEN k % 12 = 9 THEN 'UNRESOLVED_reserve_share' END) AS reviews FROM e""")
def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of an event, of a delisting, of a corporate action and of a dividend for every part, all as text."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    successor = lambda code, ratio: F.struct(F.lit(code).alias("code"), F.lit(ratio).alias("share_ratio"))
    good = successor("600001", "0.5")
    successors = (
        F.when(k % 10 == 0, F.array().cast("array<struct<code:string,share_ratio:string>>")).when(k % 10 == 1, F.array(good, successor("600002", ""))).when(k % 10 == 2, F.array(good, successor("60000x", "1")))
        .when(k % 10 == 3, F.array(good, successor("600002", "half"))).when(k % 10 == 4, F.array(successor("600002", "0"), good)).otherwise(F.array(good, good)))
    lost = F.when(k % 31 == 0, F.lit(None).cast("string"))
    price = F.when(k % 21 == 10, F.lit("about 3")).otherwise(text(k % 11))
    common = T(spark, sf_dir, "part").select(
        k.alias("k"), F.lit("600000").alias("code"), F.lit("600000").alias("source_code"), F.when(k % 29 == 1, "RUMOUR").otherwise("DELISTING").alias("event_type"), F.when(k % 19 == 3, "2024/05/06").otherwise("2024-05-06").alias("effective_date"),
        F.when(k % 17 == 4, "2024-05-07").otherwise("2024-05-06").alias("last_tradable_date"), F.when(k % 7 == 6, "UNKNOWN").when(k % 27 == 8, "2024-05-01").otherwise("2024-06-01").alias("settlement_date"), price.alias("settlement_price"),
        F.when(k % 23 == 2, "GUESS").when(k % 13 == 5, "UNKNOWN").otherwise("AUCTION").alias("price_basis"), F.coalesce(lost, F.when(k % 31 != 0, "s")).alias("source"), F.lit("2024-05-01").alias("source_as_of"), F.when(k % 31 != 0, "h").otherwise("").alias("sha256"),
        F.lit("cash").alias("cash_option"), successors.alias("successors"), F.when(k % 9 == 4, "sz.600000").otherwise("sh.600000").alias("reported_code"), F.when(k % 19 == 3, "").otherwise("2024-05-01").alias("register_date"),
        F.when(k % 16 == 7, "2023-05-02").otherwise("2024-05-02").alias("ex_date"), F.when(k % 17 == 4, "2023-01-01").otherwise("2024-05-03").alias("pay_date"), F.when(k % 14 == 8, "-1").otherwise("0.5").alias("gross_cash"), F.when(k % 6 == 1, "0.4 or 0.45").otherwise("0.4").alias("net_cash"),
        F.when(k % 8 != 3, "0").alias("stock_share"), F.when(k % 12 == 9, "").otherwise("0").alias("reserve_share"))
    errors, reviews = R.dividend_probe(F.lit(2024))
    out = common.withColumn("event_problem", R.event_evidence_problem(settled=False)).withColumn("delisting_problem", R.event_evidence_problem(settled=True)).withColumn("errors", F.array_join(errors, ";")).withColumn("reviews", F.array_join(reviews, ";"))
    out = out.withColumn("event_type", F.when(F.col("event_type") == "RUMOUR", "SPLIT").otherwise("MERGER_AND_TERMINATION")).withColumn("settlement_price", F.when(F.col("settlement_price") == "about 3", F.lit("3")).otherwise(F.col("settlement_price")))
    return out.withColumn("action_problem", R.action_evidence_problem()).select("k", "event_problem", "delisting_problem", "action_problem", "errors", "reviews")
