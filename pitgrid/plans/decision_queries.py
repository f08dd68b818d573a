"""Queries of decisions, execution, audits of candidates, readiness and independent checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators import decisions as D
from pitgrid.operators import gates as G
from pitgrid.operators import panel as P
from pitgrid.plans import adapters as A
from pitgrid.plans.ledger_queries import watchlist_greedy
from pitgrid.plans.panel_queries import HALT_SQL
from pitgrid.plans.registry import query, with_parts

T = A.table


@query("PF12", """WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS r1, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 17 = 0 END AS risk, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_custkey % 23 <> 0 END AS ok,
      CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_acctbal / 10000 - 0.1 END AS ret, c_custkey % 140 AS held, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 101) / 100.0 END AS pe, c_custkey % 7 * 10 AS ep, c_custkey % 5 * 15 AS cp,
      CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 4 - 1 END AS weeks FROM customer)
    SELECT k, split_part(d, ':', 1) AS action, split_part(d, ':', 2) AS reason FROM (SELECT k, CASE WHEN risk OR NOT ok THEN 'SELL_SIGNAL:RISK_OR_QUALITY_EXIT' WHEN ret <= -0.12 THEN 'SELL_SIGNAL:STOP_LOSS' WHEN held >= 126 THEN 'SELL_SIGNAL:TIME_EXIT'
      WHEN r1 AND weeks >= 2 THEN 'SELL_SIGNAL:TWO_WEEK_MA60_EXIT' WHEN NOT r1 AND (pe IS NULL OR pe > 1) THEN 'REVIEW:VALUATION_MISSING_OR_INVALID' WHEN NOT r1 AND pe >= 0.6 AND (ep <= 0 OR cp < ep) THEN 'REVIEW:PE_RISE_EARNINGS_NOT_CONFIRMED'
      WHEN NOT r1 AND pe >= 0.6 AND ret > 0 THEN 'SELL_SIGNAL:VALUATION_RECOVERY_EXIT' WHEN NOT r1 AND pe >= 0.6 THEN 'REVIEW:PE_RISE_WITHOUT_POSITIVE_TOTAL_RETURN' WHEN risk IS NULL OR ok IS NULL OR ret IS NULL THEN 'REVIEW:RISK_OR_RETURN_UNKNOWN'
      WHEN r1 AND (weeks IS NULL OR weeks < 0) THEN 'REVIEW:WEEKLY_SERIES_UNKNOWN' ELSE 'HOLD:NO_EXIT_TRIGGER' END AS d FROM c)""")
def exit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    unless = lambda n, c: F.when(k % n != 0, c)
    d = D.exit_decision(F.when(k % 2 == 0, "R1").otherwise("L1"), unless(19, k % 17 == 0), unless(29, k % 23 != 0), unless(31, F.col("c_acctbal") / 10000 - 0.1), k % 140,
                        unless(11, (k % 101) / 100.0), k % 7 * 10, k % 5 * 15, unless(13, k % 4 - 1))
    return T(spark, sf_dir, "customer").select(k.alias("k"), d.alias("d")).select("k", "d.action", "d.reason")


@query("CQ10", """SELECT o_orderkey AS k, CASE WHEN o_totalprice < 50000 OR o_orderstatus = 'P' THEN 'BLOCKED' WHEN o_orderpriority LIKE '1%' THEN 'BUY_SIGNAL' ELSE 'NO_TRIGGER' END AS action,
    concat_ws(';', CASE WHEN o_totalprice < 50000 THEN 'LIQUIDITY_UNAVAILABLE_OR_FAILED' END, CASE WHEN o_orderstatus = 'P' THEN 'STATUS_PENDING' END) AS reasons FROM orders""")
def entry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = G.all_reasons((F.col("o_totalprice") < 50000, "LIQUIDITY_UNAVAILABLE_OR_FAILED"), (F.col("o_orderstatus") == "P", "STATUS_PENDING"))
    trigger = F.when(F.col("o_orderpriority").startswith("1"), "BASELINE_TRIGGER").otherwise("NO_TRIGGER")
    return T(spark, sf_dir, "orders").withColumn("reasons", reasons).select(F.col("o_orderkey").alias("k"), D.entry_action(F.col("reasons"), trigger).alias("action"), "reasons")


def opening_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals and accounts by nation; ties in the first key are frequent."""
    c = T(spark, sf_dir, "customer")
    signals = c.select(F.col("c_nationkey").alias("account"), A.code_of("c_custkey").alias("code"), "c_mktsegment", (F.col("c_custkey") % 12).alias("roe"), F.round("c_acctbal", 2).alias("cash_ratio"))
    signals = signals.withColumnRenamed("c_mktsegment", "industry")
    n = F.col("n_nationkey")
    accounts = T(spark, sf_dir, "nation").select(
        n.alias("account"), ((n * 7919) % 60000).cast("decimal(18,2)").alias("cash"), ((n * 104729) % 90000).cast("decimal(18,2)").alias("market_value"),
        F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.concat(A.code_of("n_nationkey"), F.lit("x")), (n % 4).cast("int"))).alias("held"),
        F.when(n % 3 == 0, F.array(F.lit("BUILDING"))).otherwise(F.array().cast("array<string>")).alias("industries"), (n % 3).alias("monthly_buys"))
    return signals, accounts


@query("RK07", None)
def opening_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test folds the same lists by hand."""
    out = D.plan_openings(*opening_inputs(spark, sf_dir), "account")
    return out.select("account", "code", "industry", "verdict", F.col("budget").cast("double").alias("budget"))


@query("WN05", with_parts("cal", "bars") + """SELECT code, trade_date, coalesce(i - lag(i, 20) OVER (PARTITION BY code ORDER BY i) = 20, false) AS complete FROM (SELECT b.code, b.trade_date, c.cal_idx AS i FROM bars b JOIN cal c USING (trade_date))""")
def complete_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 21 rows that miss no day of the calendar."""
    b = A.bars(spark, sf_dir).select("code", "trade_date").join(P.calendar(A.days(spark, sf_dir)), "trade_date")
    return b.select("code", "trade_date", F.coalesce(F.col("cal_idx") - P.lagged("cal_idx", 20) == 20, F.lit(False)).alias("complete"))


_ID_SQL = "SELECT account, fill_id, 'O' || account || lpad(CAST(row_number() OVER (PARTITION BY account ORDER BY ts, fill_id) AS VARCHAR), 5, '0') AS order_id, 'L1:' || account || ':' || CAST(day AS VARCHAR) AS plan_id FROM fills WHERE side IS NOT NULL"


@query("SF27", with_parts("fills") + _ID_SQL)
def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered within the account; one numbering of all would put all rows into one task."""
    n = F.row_number().over(W.partitionBy("account").orderBy("ts", "fill_id")).cast("string")
    return A.fills(spark, sf_dir).where("side is not null").select("account", "fill_id", F.concat(F.lit("O"), "account", F.lpad(n, 5, "0")).alias("order_id"), F.concat(F.lit("L1:"), "account", F.lit(":"), F.col("day").cast("string")).alias("plan_id"))


#: Halted days allowed in the window, in a row and of late, and tradable days asked for after a halt.
POLICIES = {"strict": (0, 0, 253, 0), "recent20": (253, 253, 0, 0), "short5": (5, 5, 253, 0), "all": (253, 253, 253, 0), "cool5": (253, 253, 253, 5), "cool10": (253, 253, 253, 10), "cool20": (253, 253, 253, 20)}


@query("CQ04 CQ17", HALT_SQL + f""", f AS (SELECT a.code, a.trade_date, (SELECT count(*) FILTER (b.halted) FROM q b WHERE b.code = a.code AND b.n BETWEEN a.n - 19 AND a.n) AS halts,
    (SELECT max(CASE WHEN b.halted THEN least(b.run, b.n - greatest(1, a.n - 19) + 1) ELSE 0 END) FROM q b WHERE b.code = a.code AND b.n BETWEEN a.n - 19 AND a.n) AS longest,
    (SELECT count(*) FILTER (b.halted) FROM q b WHERE b.code = a.code AND b.n BETWEEN a.n - 5 AND a.n - 1) AS recent, a.n - coalesce(a.last_halt, 0) AS live FROM q a),
    p(policy, w, r, l, c) AS (VALUES {", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in POLICIES.items())})
    SELECT policy, trade_date, count(*) AS eligible, count(*) FILTER (halts > 0) AS with_halts FROM f JOIN p ON halts <= w AND longest <= r AND recent <= l AND live >= c GROUP BY ALL""")
def halt_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that each policy lets through by day, and how many of them were halted within the window."""
    b = A.bars(spark, sf_dir).select("code", "trade_date", (F.col("volume") < 12).alias("halted"))
    f = P.halt_features("halted", 20, 5)
    b = b.withColumn("row_no", f.pop("row_no"))
    b = b.select("code", "trade_date", *[v.alias(k) for k, v in f.items()])
    passes = [F.when((F.col("halts") <= w) & (F.col("longest_halt") <= r) & (F.col("recent_halts") <= late) & (F.col("tradable_run") >= cool), F.lit(k)) for k, (w, r, late, cool) in POLICIES.items()]
    return b.withColumn("policy", F.explode(F.array_compact(F.array(*passes)))).groupBy("policy", "trade_date").agg(F.count("*").alias("eligible"), F.count_if(F.col("halts") > 0).alias("with_halts"))


_CANDIDATES = """, u AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_suppkey % 3 = 0 AS reviewed FROM supplier), b AS (SELECT code, max(trade_date) AS last_date, count(*) AS n, count(*) FILTER (volume < 12) AS halts FROM bars WHERE CAST(code AS BIGINT) % 7 <> 0 GROUP BY 1),
    m AS (SELECT code, count(*) AS seen FROM members WHERE observed_date >= DATE '1998-01-01' GROUP BY 1), k AS (SELECT u.code, CAST(last_date AS VARCHAR) AS last_date, coalesce(n, 0) AS n, coalesce(halts, 0) AS halts,
      CASE WHEN n IS NULL THEN 'EMPTY_PRICE_FILE' ELSE 'REQUIRES_EVENT_SOURCE_REVIEW' END AS classification, CASE WHEN seen > 0 THEN 'IN_SCOPE' ELSE 'OUTSIDE_SCOPE' END AS scope, reviewed
      FROM u LEFT JOIN b USING (code) LEFT JOIN m USING (code) WHERE last_date IS NULL OR last_date < (SELECT max(trade_date) FROM bars)) """


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bars(spark, sf_dir)
    end = b.agg(F.max("trade_date").alias("end"))
    by_code = b.where(F.col("code").cast("long") % 7 != 0).groupBy("code").agg(F.max("trade_date").alias("last_date"), F.count("*").alias("n"), F.count_if(F.col("volume") < 12).alias("halts"))
    seen = A.members(spark, sf_dir).where("observed_date >= date'1998-01-01'").groupBy("code").agg(F.count("*").alias("seen"))
    u = T(spark, sf_dir, "supplier").select(A.code_of("s_suppkey").alias("code"), (F.col("s_suppkey") % 3 == 0).alias("reviewed"))
    j = u.join(by_code, "code", "left").join(seen, "code", "left").withColumn("end", end.scalar()).where("last_date is null or last_date < end")
    return j.select("code", F.col("last_date").cast("string").alias("last_date"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("halts", F.lit(0)).alias("halts"),
                    F.when(F.col("n").isNull(), "EMPTY_PRICE_FILE").otherwise("REQUIRES_EVENT_SOURCE_REVIEW").alias("classification"), F.when(F.col("seen") > 0, "IN_SCOPE").otherwise("OUTSIDE_SCOPE").alias("scope"), "reviewed")


@query("CQ15", with_parts("bars", "members") + _CANDIDATES + "SELECT * FROM k")
def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes whose bars end before the last day of all, or that have none (every seventh code's bars count as lost)."""
    return _candidates(spark, sf_dir)


_LADDER = "CASE WHEN {n} > 0 AND {d} = {n} THEN 'PASS' WHEN {d} > 0 THEN 'INCOMPLETE' ELSE 'BLOCKED' END"


@query("CQ21 CQ22", with_parts("bars", "members") + _CANDIDATES + f""", g AS (SELECT count(*) AS n, count(*) FILTER (reviewed) AS d, count(*) FILTER (n > 0) AS n1, count(*) FILTER (n > 0 AND reviewed) AS d1, count(*) FILTER (n = 0 AND scope = 'IN_SCOPE') AS e FROM k),
    v AS (SELECT 'price_history_coverage' AS gate, CASE WHEN e = 0 THEN 'PASS' ELSE 'BLOCKED' END AS actual FROM g UNION ALL SELECT 'non_empty_event_evidence', {_LADDER.format(n="n1", d="d1")} FROM g UNION ALL SELECT 'event_evidence', {_LADDER.format(n="n", d="d")} FROM g)
    SELECT q.gate, coalesce(actual, 'MISSING') AS actual, CASE WHEN actual = 'PASS' THEN 'ALLOWED' ELSE 'PROMOTION_BLOCKED' END AS verdict FROM (VALUES ('price_history_coverage'), ('non_empty_event_evidence'), ('event_evidence'), ('shadow_replay')) q(gate) LEFT JOIN v USING (gate)""")
def readiness_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that promotion requires; one that was never assessed blocks it."""
    k, some = _candidates(spark, sf_dir), F.col("n") > 0
    n = k.agg(F.count("*").alias("n"), F.count_if("reviewed").alias("d"), F.count_if(some).alias("n1"), F.count_if(some & F.col("reviewed")).alias("d1"), F.count_if(~some & (F.col("scope") == "IN_SCOPE")).alias("e"))
    gates = {"price_history_coverage": F.when(F.col("e") == 0, "PASS").otherwise("BLOCKED"), "non_empty_event_evidence": D.ladder(F.col("d1"), F.col("n1")), "event_evidence": D.ladder(F.col("d"), F.col("n"))}
    have = n.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), v.alias("actual")) for g, v in gates.items()])).alias("x")).select("x.*")
    required = spark.createDataFrame([(g,) for g in (*gates, "shadow_replay")], "gate string")
    verdict = F.when(F.col("actual") == "PASS", "ALLOWED").otherwise("PROMOTION_BLOCKED")
    return required.join(have, "gate", "left").select("gate", F.coalesce("actual", F.lit("MISSING")).alias("actual"), verdict.alias("verdict"))


_ANNUAL = """, y AS (SELECT code, CAST(year(trade_date) AS BIGINT) AS y, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS ret FROM monthly GROUP BY ALL)"""


@query("CQ24", with_parts("monthly") + _ANNUAL + " SELECT code, y, round(ret, 6) AS ret, round(ret - avg(ret) OVER (PARTITION BY y), 6) AS excess FROM y")
def annual_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's return of each code over the mean of all codes."""
    y = A.monthly(spark, sf_dir).groupBy("code", F.year("trade_date").cast("long").alias("y")).agg((F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1).alias("ret"))
    mean = y.groupBy("y").agg(F.avg("ret").alias("mean"))
    return y.join(mean, "y").select("code", "y", F.round("ret", 6).alias("ret"), F.round(F.col("ret") - F.col("mean"), 6).alias("excess"))


#: Fixed schemas of a forward log's tables; all but the signals begin empty.
FORWARD_LOG = {"orders": "order_id string, code string, day date, side string", "fills": "fill_id string, order_id string, price decimal(18,2), shares long", "positions": "code string, shares long",
               "equity": "day date, equity decimal(18,2)", "reviews": "code string, day date, verdict string"}


@query("", "SELECT 'signals' AS t, CAST(count(*) AS BIGINT) AS n, CAST(3 AS BIGINT) AS columns FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{t}', 0, {s.count(' ') - s.count(', ')})" for t, s in FORWARD_LOG.items()) + ")")
def forward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"signals": T(spark, sf_dir, "customer").where("c_acctbal > 9000").select(A.code_of("c_custkey").alias("code"), "c_mktsegment", F.lit("SIGNAL_FROZEN").alias("status"))}
    tables |= {t: spark.createDataFrame([], s) for t, s in FORWARD_LOG.items()}
    out = None
    for t, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n", F.lit(len(df.columns)).cast("long").alias("columns"))
        out = one if out is None else out.union(one)
    return out


_EXEC_SQL = """, o AS (SELECT o_orderkey AS k, lpad(CAST(o_custkey % 10 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side FROM orders),
    j AS (SELECT o.*, b.trade_date AS d, CAST(b.open AS DECIMAL(18,4)) AS op, CAST(b.low AS DECIMAL(18,4)) AS lo, CAST(b.high AS DECIMAL(18,4)) AS hi FROM o LEFT JOIN bars b ON b.code = o.code AND b.trade_date = o.s + 1),
    p AS (SELECT *, CAST(CASE WHEN side = 'BUY' THEN ceil(op * 1.0005 * 100) / 100 ELSE floor(op * 0.9995 * 100) / 100 END AS DECIMAL(18,2)) AS price FROM j)
    SELECT k, side, CAST(price AS DOUBLE) AS price, CASE WHEN k % 37 = 0 THEN 'MISSING_SIGNAL_IDENTITY' WHEN d IS NULL THEN 'ORDER_NOT_NEXT_TRADING_DAY' WHEN NOT (lo > 0 AND lo <= op AND op <= hi) THEN 'INVALID_EXECUTION_BAR'
      WHEN NOT (price BETWEEN lo AND hi) THEN 'SLIPPED_PRICE_OUTSIDE_BAR' WHEN side = 'BUY' AND k % 500 * 1000 < price * 100 THEN 'BUDGET_BELOW_MINIMUM' ELSE 'BOOKED' END AS verdict FROM p"""


@query("SM05 SM06", with_parts("bars") + _EXEC_SQL)
def order_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the day after their signal, at its open against them by 5 basis points."""
    k = F.col("o_orderkey")
    o = T(spark, sf_dir, "orders").select(k.alias("k"), F.lpad((F.col("o_custkey") % 10).cast("string"), 6, "0").alias("code"), F.to_date("o_orderdate").alias("s"), F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"))
    o = o.withColumn("trade_date", F.date_add("s", 1))
    b = A.bars(spark, sf_dir).select("code", "trade_date", *[F.col(c).cast("decimal(18,4)").alias(c) for c in ("open", "low", "high")], F.lit(True).alias("traded"))
    j = o.join(b, ["code", "trade_date"], "left").withColumn("price", D.slipped_price(F.col("side"), F.col("open")))
    shares = F.when(F.col("side") == "SELL", 100).otherwise(F.floor(F.col("k") % 500 * 1000 / (F.col("price") * 100)) * 100)
    verdict = D.execution_verdict(F.concat("side", F.lit("_SIGNAL")), F.when(F.col("k") % 37 != 0, "L1"), F.col("s"), F.col("trade_date"), F.when(F.col("traded"), F.col("trade_date")), F.lit(True), F.col("low"), F.col("open"), F.col("high"), F.col("price"), shares)
    return j.select("k", "side", F.col("price").cast("double").alias("price"), verdict.alias("verdict"))


@query("SM07", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 // 2 - CASE WHEN o_orderkey % 5 < 2 THEN 1 ELSE 1 END) + INTERVAL 1 HOUR * (14 + o_orderkey % 4) AS now,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 HOUR * (CASE WHEN o_orderkey % 13 = 0 THEN 14 ELSE 15 END) END AS quote, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN o_orderkey % 18 ELSE 5 END AS market,
      o_orderdate + INTERVAL 1 HOUR * (CASE WHEN o_orderkey % 17 = 0 THEN 10 ELSE 9 END) AS frozen, o_orderkey % 19 <> 0 AS reviewed FROM orders)
    SELECT k, CASE WHEN CAST(now AS DATE) < d THEN 'WAITING' WHEN CAST(now AS DATE) > d THEN 'EXPIRED' WHEN hour(now) < 16 THEN 'WAITING' WHEN quote IS NULL OR hour(quote) < 15 THEN 'WAITING_EVIDENCE' WHEN market IN (6, 7, 8, 9, 14, 15, 16) THEN 'REJECTED'
      WHEN market IS DISTINCT FROM 5 THEN 'WAITING_EVIDENCE' WHEN hour(frozen) > 9 OR NOT reviewed THEN 'REJECTED' ELSE 'SIMULATED_BOOKED' END AS status FROM o""")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, start = F.col("o_orderkey"), F.col("o_orderdate")
    at = lambda h, d=F.lit(0): start + F.make_dt_interval(d.cast("int"), h.cast("int"))
    hour = lambda n, yes, no: F.when(k % n == 0, yes).otherwise(no)
    market = F.when(k % 7 == 0, None).when(k % 6 == 0, k % 18).otherwise(5)
    s = D.first_order_state(at(14 + k % 4, F.floor(k % 5 / 2) - 1), F.to_date(start), F.when(k % 11 != 0, at(hour(13, 14, 15))), market, at(hour(17, 10, 9)), k % 19 != 0)
    return T(spark, sf_dir, "orders").select(k.alias("k"), s.status.alias("status"))


@query("SM08", with_parts("monthly") + """, s AS (SELECT code, trade_date, close, lag(close) OVER w AS bought, lead(close) OVER w AS sold FROM monthly WINDOW w AS (PARTITION BY code ORDER BY trade_date))
    SELECT code, trade_date, round(100 * (sold - bought), 6) AS gain, round(close, 6) AS dividend, round(close * 0.2, 6) AS tax, round(100 * (sold - bought) + close * 0.8, 6) AS net FROM s WHERE month(trade_date) = 6 AND bought IS NOT NULL AND sold IS NOT NULL""")
def dividend_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred shares bought a bar before a dividend of a hundredth of the close and sold a bar after; a fifth is taxed."""
    w = W.partitionBy("code").orderBy("trade_date")
    m = A.monthly(spark, sf_dir).select("code", "trade_date", "close", F.lag("close").over(w).alias("bought"), F.lead("close").over(w).alias("sold")).where("month(trade_date) = 6 and bought is not null and sold is not null")
    gain = 100 * (F.col("sold") - F.col("bought"))
    return m.select("code", "trade_date", *[F.round(v, 6).alias(n) for n, v in (("gain", gain), ("dividend", F.col("close")), ("tax", F.col("close") * 0.2), ("net", gain + F.col("close") * 0.8))])


@query("LG14", """WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 <> 0 OR l_linenumber <> 1) GROUP BY 1)
    SELECT a.k, CASE WHEN b.n IS NULL THEN 'NO_REVIEW' WHEN a.n = b.n THEN 'BOUND' ELSE 'INCOMPLETE' END AS verdict FROM a LEFT JOIN b USING (k)""")
def review_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review must name each line of its journal; some reviews here lack the first."""
    lines = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    named = lambda df, n: df.groupBy("k").agg(F.sort_array(F.collect_set("l_linenumber")).alias(n))
    j = named(lines, "journal").join(named(lines.where("k % 10 <> 0 or l_linenumber <> 1"), "review"), "k", "left")
    return j.select("k", F.when(F.col("review").isNull(), "NO_REVIEW").when(F.col("review") == F.col("journal"), "BOUND").otherwise("INCOMPLETE").alias("verdict"))


@query("", "SELECT * FROM (VALUES ('too_many', 0), ('nation_twice', 0), ('segment_thrice', 0), ('not_best_first', 0)) v(rule, broken)")
def watchlist_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caps of the watchlist, counted anew, and its order."""
    w = watchlist_greedy(spark, sf_dir).select("region", "c_custkey").join(T(spark, sf_dir, "customer"), "c_custkey")
    top = T(spark, sf_dir, "nation").join(T(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.max("c_acctbal").alias("best"))
    more = lambda keys, n, name: w.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > n).agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))
    first = w.groupBy("region").agg(F.max("c_acctbal").alias("mine")).join(top, "region").where("mine <> best").agg(F.lit("not_best_first").alias("rule"), F.count("*").alias("broken"))
    return more(["region"], 5, "too_many").union(more(["region", "c_nationkey"], 1, "nation_twice")).union(more(["region", "c_mktsegment"], 2, "segment_thrice")).union(first)
