"""Queries of aggregates, metrics, ledgers and the ranking model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators import decisions as D
from pitgrid.operators import ledger as L
from pitgrid.operators import metrics as M
from pitgrid.operators import panel as P
from pitgrid.operators import ridge as R
from pitgrid.plans import adapters as A
from pitgrid.plans import panel_queries as Q
from pitgrid.plans.registry import query, with_parts

T = A.table


@query("MT01 MT02 MT03 AG12 AG13", with_parts("monthly") + """, s AS (SELECT code, trade_date, close AS v, lag(close) OVER w AS b FROM monthly WHERE trade_date <= DATE '2000-12-01' WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    t AS (SELECT *, first_value(coalesce(b, v)) OVER w AS base, v / coalesce(b, v) - 1 AS r FROM s WHERE trade_date >= DATE '1997-01-01' WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    u AS (SELECT *, greatest(base, max(v) OVER (PARTITION BY code ORDER BY trade_date)) AS peak FROM t),
    a AS (SELECT code, count(*) AS n, max(base) AS base, arg_max(v, trade_date) AS last, stddev_samp(r) AS sd, avg(r) AS mean, min(v / peak - 1) AS dd FROM u GROUP BY 1)
    SELECT code, n, round(last / base - 1, 6) AS total_return, round(pow(last / base, 12 / n) - 1, 6) AS annual_return, round(sd * sqrt(12), 5) AS volatility, round(mean / sd * sqrt(12), 6) AS sharpe, round(dd, 6) AS max_drawdown, round((pow(last / base, 12 / n) - 1) / -dd, 6) AS calmar FROM a""")
def period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.period_metrics(A.monthly(spark, sf_dir), "1997-01-01", "2000-12-01", value="close", per_year=12)
    return Q._rounded(Q._rounded(m, "total_return", "annual_return", "sharpe", "max_drawdown", "calmar", places=6), "volatility", places=5)


@query("WN14 AG19", with_parts("bars") + """, s AS (SELECT code, trade_date, close, row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS i FROM bars), e AS (SELECT * FROM s WHERE i >= 252 AND (i - 252) % 21 = 0),
    p AS (SELECT e.code, e.trade_date, s.i, s.close, max(s.close) OVER (PARTITION BY e.code, e.trade_date ORDER BY s.i) AS peak FROM e JOIN s ON s.code = e.code AND s.i BETWEEN e.i - 252 AND e.i)
    SELECT code, trade_date, round(arg_max(close, i) / arg_min(close, i) - 1, 6) AS window_return, round(min(close / peak - 1), 6) AS worst_drawdown FROM p GROUP BY 1, 2""")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._rounded(M.rolling_windows(A.bars(spark, sf_dir), 252, 21), "window_return", "worst_drawdown", places=6)


@query("AG11 CQ13 JN06 AG24", with_parts("monthly") + """, d AS (SELECT code, trade_date AS ex_date, CAST(close * 0.01 AS DECIMAL(24,12)) AS cash FROM monthly WHERE month(trade_date) = 5),
    g AS (SELECT m.code, m.trade_date, m.close, CASE WHEN row_number() OVER (PARTITION BY m.code ORDER BY m.trade_date) > 1 THEN ln((m.close + CAST(d.cash AS DOUBLE)) / m.close) END AS paid_in, coalesce(d.cash, 0) AS cash FROM monthly m LEFT JOIN d ON d.code = m.code AND d.ex_date = m.trade_date)
    SELECT code, trade_date, round(close / first_value(close) OVER w * exp(coalesce(sum(paid_in) OVER w, 0)), 4) AS growth_index, CAST(round(sum(cash) OVER w, 4) AS DOUBLE) AS cash_so_far FROM g WINDOW w AS (PARTITION BY code ORDER BY trade_date)""")
def total_return_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.monthly(spark, sf_dir).select("code", "trade_date", "close")
    d = m.where("month(trade_date) = 5").select("code", F.col("trade_date").alias("ex_date"), (F.col("close") * 0.01).cast("decimal(24,12)").alias("cash"))
    i = M.total_return_index(m, d, base=1.0)
    paid = F.sum(F.coalesce("cash", F.lit(0).cast("decimal(24,12)"))).over(P.rows(W.unboundedPreceding, 0))
    return i.select("code", "trade_date", F.round("total_return_index", 4).alias("growth_index"), F.round(paid, 4).cast("double").alias("cash_so_far"))


@query("AG02 AG03 AG14 AG18", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, bool_and(o_totalprice > 0) AS all_positive, bool_or(o_totalprice > 499000) AS any_huge FROM orders GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.bool_and(F.col("o_totalprice") > 0).alias("all_positive"), F.bool_or(F.col("o_totalprice") > 499000).alias("any_huge"))


@query("AG06 AG07 AG21", "SELECT l_returnflag AS flag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop, round(CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 10000, 2) AS tax_bps FROM lineitem GROUP BY 1")
def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    g = T(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return g.agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd_pop"), F.round(total(F.col("l_extendedprice") * F.col("l_tax")) / total(F.col("l_extendedprice")) * 10000, 2).alias("tax_bps"))


@query("AG17 WN25", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2), g AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) AS gap FROM d)
    SELECT user_id, count(*) AS days, list_sort(list(n))[len(list(n)) // 2 + 1] AS upper_median, min(gap) AS least_gap FROM g GROUP BY 1""")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of trades a day, and the shortest gap between trading days."""
    d = T(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    d = d.withColumn("gap", F.datediff("d", F.lag("d").over(W.partitionBy("user_id").orderBy("d"))).cast("long"))
    by_user = W.partitionBy("user_id")
    d = d.withColumn("place", F.row_number().over(by_user.orderBy("n", "d"))).withColumn("middle", F.floor(F.count("*").over(by_user) / 2) + 1)
    return d.groupBy("user_id").agg(F.count("*").alias("days"), F.max(F.when(F.col("place") == F.col("middle"), F.col("n"))).alias("upper_median"), F.min("gap").alias("least_gap"))


@query("AG20", with_parts("bars") + "SELECT trade_date, count(*) AS n FROM bars WHERE volume < 12 GROUP BY 1 ORDER BY n DESC, trade_date LIMIT 20")
def most_halted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dates of most halts; ties go to the earlier."""
    return A.bars(spark, sf_dir).where("volume < 12").groupBy("trade_date").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trade_date").limit(20)


@query("AG25 SC07", "SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, max(o_orderdate) AS at FROM orders GROUP BY 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderdate").alias("at"))


@query("ST07 AG26", with_parts("bars") + "SELECT min(last) AS common_cutoff, count(*) FILTER (n >= 504) AS enough, count(*) AS codes FROM (SELECT code, max(trade_date) AS last, count(*) FILTER (volume > 5) AS n FROM bars GROUP BY 1)")
def common_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.bars(spark, sf_dir).groupBy("code").agg(F.max("trade_date").alias("last"), F.count_if(F.col("volume") > 5).alias("n"))
    return c.agg(F.min("last").alias("common_cutoff"), F.count_if(F.col("n") >= 504).alias("enough"), F.count("*").alias("codes"))


@query("WN22 CQ09", with_parts("bars") + """, c AS (SELECT max(trade_date) AS cut FROM bars), v AS (SELECT code, trade_date, close / volume AS pe, cut FROM bars, c WHERE trade_date > CAST(cut - INTERVAL 36 MONTH AS DATE)),
    a AS (SELECT code, count(*) AS n, quantile_cont(pe, 0.2) AS p20, quantile_cont(pe, 0.5) AS p50, quantile_cont(pe, 0.8) AS p80, arg_max(pe, trade_date) AS now FROM v GROUP BY 1)
    SELECT a.code, a.n, round(p20, 6) AS p20, round(p50, 6) AS p50, round(p80, 6) AS p80, round((SELECT count(*) FROM v WHERE v.code = a.code AND v.pe <= a.now) / CAST(a.n AS DOUBLE), 6) AS share_at_or_below, CASE WHEN n < 200 THEN 'REVIEW' WHEN now <= p20 THEN 'TRIGGER' ELSE 'NO_CURRENT_TRIGGER' END AS status FROM a""")
def valuation_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the current ratio of a code stands among those of the three years up to the common cutoff."""
    b = A.bars(spark, sf_dir)
    cut = b.agg(F.max("trade_date").alias("cut"))
    v = b.withColumn("cut", cut.scalar()).where(F.col("trade_date") > F.add_months("cut", -36)).withColumn("pe", F.col("close") / F.col("volume"))
    v = v.withColumn("now", F.last("pe").over(P.series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    q = lambda p: F.percentile("pe", F.lit(p))
    a = v.groupBy("code").agg(F.count("*").alias("n"), q(0.2).alias("p20"), q(0.5).alias("p50"), q(0.8).alias("p80"), F.first("now").alias("now"), F.count_if(F.col("pe") <= F.col("now")).alias("below"))
    status = F.when(F.col("n") < 200, "REVIEW").when(F.col("now") <= F.col("p20"), "TRIGGER").otherwise("NO_CURRENT_TRIGGER")
    return a.select("code", "n", F.round("p20", 6).alias("p20"), F.round("p50", 6).alias("p50"), F.round("p80", 6).alias("p80"), F.round(F.col("below") / F.col("n"), 6).alias("share_at_or_below"), status.alias("status"))


@query("WN24 SS07", with_parts("bars") + """, w AS (SELECT code, date_trunc('week', trade_date) AS wk, arg_max(close, trade_date) AS close FROM bars GROUP BY 1, 2), m AS (SELECT *, CASE WHEN count(*) OVER a = 10 THEN avg(close) OVER a END AS ma, row_number() OVER (PARTITION BY code ORDER BY wk) AS n FROM w WINDOW a AS (PARTITION BY code ORDER BY wk ROWS 9 PRECEDING)),
    f AS (SELECT *, coalesce(close < ma, false) AS below FROM m), l AS (SELECT *, max(CASE WHEN NOT below THEN n END) OVER (PARTITION BY code ORDER BY n) AS last_above FROM f) SELECT code, CAST(wk AS DATE) AS week, n - coalesce(last_above, 0) AS weeks_below FROM l""")
def weeks_below_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive weekly closes below the average of ten."""
    w = A.bars(spark, sf_dir).groupBy("code", F.to_date(F.date_trunc("week", "trade_date")).alias("trade_date")).agg(F.max_by("close", "trade_date").alias("close"))
    w = w.withColumn("below", F.coalesce(F.col("close") < P.moving_average("close", 10), F.lit(False))).withColumn("n", F.row_number().over(P.series()))
    above = F.max(F.when(~F.col("below"), F.col("n"))).over(P.rows(W.unboundedPreceding, 0))
    return w.select("code", F.col("trade_date").alias("week"), (F.col("n") - F.coalesce(above, F.lit(0))).cast("long").alias("weeks_below"))


@query("LG01 LG03 WN27", with_parts("fills") + """, s AS (SELECT account, sum(shares) AS sold FROM fills WHERE side = 'SELL' GROUP BY 1), b AS (SELECT account, fill_id, shares, coalesce(sum(shares) OVER (PARTITION BY account ORDER BY ts, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(shares) OVER (PARTITION BY account) AS total FROM fills WHERE side = 'BUY')
    SELECT b.account, fill_id AS lot_id, shares AS bought, CAST(shares - greatest(0, least(shares, coalesce(sold, 0) - before)) AS BIGINT) AS "left", CAST(greatest(0, coalesce(sold, 0) - total) AS BIGINT) AS oversold FROM b LEFT JOIN s ON s.account = b.account""")
def fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fifo_lots(A.fills(spark, sf_dir)).select("account", "lot_id", "bought", F.col("left").cast("long").alias("left"), F.col("oversold").cast("long").alias("oversold"))


@query("LG02", with_parts("fills") + """, r AS (SELECT fill_id % 4000 AS fill_id, account, side, price, shares FROM fills WHERE side IS NOT NULL UNION ALL SELECT fill_id % 4000, account, side, price, shares FROM fills WHERE side IS NOT NULL AND fill_id % 3 = 0)
    SELECT fill_id, count(*) AS received, CASE WHEN count(DISTINCT (account, side, price, shares)) > 1 THEN 'CONFLICT' ELSE 'BOOKED' END AS status FROM r GROUP BY 1""")
def idempotent_booking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fills(spark, sf_dir).where("side is not null").withColumn("again", F.col("fill_id") % 3 == 0)
    sent = f.select((F.col("fill_id") % 4000).alias("fill_id"), "account", "side", "price", "shares", F.explode(F.when(F.col("again"), F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    return L.book(sent.drop("n"), ["account", "side", "price", "shares"]).select("fill_id", "received", "status")


@query("LG07", with_parts("fills") + ", a AS (SELECT account, fill_id, ts - INTERVAL 1 HOUR * (CASE WHEN fill_id % 17 = 0 THEN 48 ELSE 0 END) AS t FROM fills) SELECT account, count(*) AS fills, count(*) FILTER (t < before) AS refused FROM (SELECT *, max(t) OVER (PARTITION BY account ORDER BY fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a) GROUP BY 1")
def late_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late fills are refused and counted, not dropped."""
    f = A.fills(spark, sf_dir).withColumn("t", F.when(F.col("fill_id") % 17 == 0, F.col("ts") - F.expr("interval 48 hours")).otherwise(F.col("ts")))
    return L.out_of_order(f, "account", "fill_id", "t").groupBy("account").agg(F.count("*").alias("fills"), F.count_if("refused").alias("refused"))


_BALANCE = """g AS (SELECT account, side, shares, CAST(price * shares AS DECIMAL(18,2)) AS gross FROM fills WHERE side IS NOT NULL), h AS (SELECT *, greatest(CAST(1 AS DECIMAL(18,2)), CAST(ceil(gross * 0.0025 * 100) / 100 AS DECIMAL(18,2))) AS fee FROM g),
    bal AS (SELECT account, sum(CASE WHEN side = 'SELL' THEN gross ELSE -gross END - fee) AS cash, CAST(sum(CASE WHEN side = 'SELL' THEN -shares ELSE shares END) AS BIGINT) AS shares, sum(fee) AS fees, count(*) AS n FROM h GROUP BY 1)"""


@query("LG04 LG08", with_parts("fills") + f", {_BALANCE} SELECT account, CAST(cash AS DOUBLE) AS cash_change, shares, CAST(fees AS DOUBLE) AS fees, n AS fills FROM bal")
def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.balances(A.fills(spark, sf_dir), "0.0025", "1")
    return b.select("account", F.col("cash_change").cast("double").alias("cash_change"), "shares", F.col("fees").cast("double").alias("fees"), "fills")


@query("", with_parts("fills") + f", {_BALANCE} SELECT account, concat_ws(';', CASE WHEN CAST(account AS BIGINT) % 10 = 3 THEN 'CASH_CHANGE_DIFFERS' END, CASE WHEN CAST(account AS BIGINT) % 15 = 3 THEN 'SHARES_DIFFERS' END) AS reasons FROM bal WHERE CAST(account AS BIGINT) % 10 = 3 OR CAST(account AS BIGINT) % 15 = 3")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered balances are found by recomputing all of them."""
    b = L.balances(A.fills(spark, sf_dir), "0.0025", "1")
    n = F.col("account").cast("long")
    stored = b.withColumn("cash_change", (F.col("cash_change") + F.when(n % 10 == 3, 1).otherwise(0)).cast("decimal(18,2)")).withColumn("shares", F.col("shares") + F.when(n % 15 == 3, 1).otherwise(0))
    return L.reconcile(stored, b, "account", ["cash_change", "shares"])


@query("LG06", with_parts("fills") + """, p AS (SELECT account, lpad(CAST(fill_id % 5 AS VARCHAR), 6, '0') AS code, day, CAST(CASE WHEN side = 'SELL' THEN -shares ELSE shares END AS BIGINT) AS change FROM fills WHERE side IS NOT NULL),
    e AS (SELECT n AS event_id, lpad(CAST(n % 5 AS VARCHAR), 6, '0') AS code, DATE '2024-01-05' + CAST(n AS INTEGER) AS rec, DATE '2024-01-05' + CAST(n AS INTEGER) + CASE WHEN n % 4 = 0 THEN 0 ELSE 1 END AS ex, DATE '2024-01-12' + CAST(n AS INTEGER) AS pay, CAST(0.1 + n * 0.01 AS DECIMAL(10,4)) AS per FROM range(12) t(n)),
    h AS (SELECT e.event_id, p.account, CAST(sum(change) AS BIGINT) AS held FROM e JOIN p ON p.code = e.code AND p.day <= e.rec GROUP BY 1, 2 HAVING sum(change) > 0)
    SELECT h.event_id, h.account, h.held, CAST(CAST(held * per AS DECIMAL(18,2)) AS DOUBLE) AS gross, CAST(round(CAST(held * per AS DECIMAL(18,2)) * 0.2, 2) AS DOUBLE) AS withheld, CASE WHEN rec < ex AND ex <= pay THEN 'ACCEPTED' ELSE 'REFUSED' END AS status FROM h JOIN e USING (event_id)""")
def dividend_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fills(spark, sf_dir).where("side is not null")
    p = f.select("account", F.lpad((F.col("fill_id") % 5).cast("string"), 6, "0").alias("code"), F.col("day").alias("trade_date"), F.when(F.col("side") == "SELL", -F.col("shares")).otherwise(F.col("shares")).alias("change"))
    n, start = F.col("id"), F.lit("2024-01-05").cast("date")
    e = spark.range(12).select(n.alias("event_id"), F.lpad((n % 5).cast("string"), 6, "0").alias("code"), F.date_add(start, n.cast("int")).alias("record_date"), F.date_add(start, (n + F.when(n % 4 == 0, 0).otherwise(1)).cast("int")).alias("ex_date"), F.date_add(start, (n + 7).cast("int")).alias("pay_date"), (F.lit(0.1) + n * 0.01).cast("decimal(10,4)").alias("per_share"))
    return L.entitlements(p, e).select("event_id", "account", "held", F.col("gross").cast("double").alias("gross"), F.col("withheld").cast("double").alias("withheld"), "status")


@query("LG09 SF24 D13", with_parts("fills") + """, p AS (SELECT account, lpad(CAST(fill_id % 3 AS VARCHAR), 6, '0') AS code, CAST(sum(shares) AS BIGINT) AS shares FROM fills WHERE side = 'BUY' GROUP BY 1, 2), a AS (SELECT * FROM (VALUES ('000001', '000002', 0.5), ('000001', '000009', 1.25)) t(code, successor, ratio)),
    x AS (SELECT p.account, coalesce(a.successor, p.code) AS code, sum(p.shares * CAST(coalesce(a.ratio, 1) AS DECIMAL(10,4))) AS exact FROM p LEFT JOIN a ON a.code = p.code GROUP BY 1, 2) SELECT account, code, CAST(floor(exact) AS BIGINT) AS shares, CAST(exact - floor(exact) AS DOUBLE) AS fraction FROM x""")
def corporate_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.fills(spark, sf_dir).where("side = 'BUY'").groupBy("account", F.lpad((F.col("fill_id") % 3).cast("string"), 6, "0").alias("code")).agg(F.sum("shares").alias("shares"))
    s = lambda code, ratio: F.struct(F.lit(code).alias("code"), F.lit(ratio).cast("decimal(10,4)").alias("ratio"))
    return L.convert(p, spark.range(1).select(F.lit("000001").alias("code"), F.array(s("000002", "0.5"), s("000009", "1.25")).alias("successors")))


@query("LG11 SK04", with_parts("fills") + """, l AS (SELECT account, max(day) AS day, arg_max(price, (ts, fill_id)) AS last_price, count(*) FILTER (day = DATE '2024-01-29') AS today, count(*) FILTER (date_trunc('week', day) = DATE '2024-01-29') AS this_week, count(*) FILTER (date_trunc('month', day) = DATE '2024-01-01') AS this_month, CAST(sum(CASE side WHEN 'BUY' THEN shares WHEN 'SELL' THEN -shares ELSE 0 END) AS BIGINT) AS shares FROM fills WHERE day <= DATE '2024-01-29' GROUP BY 1)
    SELECT account, today, this_week, this_month, concat_ws(';', CASE WHEN shares < 0 THEN 'SHORT' END, CASE WHEN day < DATE '2024-01-28' THEN 'STALE_PRICE' END) AS gaps, CASE WHEN shares >= 0 AND day >= DATE '2024-01-28' THEN CAST(shares * last_price AS DOUBLE) END AS value FROM l""")
def account_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the day, week and month so far; a value only where nothing is missing."""
    now = F.lit("2024-01-29").cast("date")
    f = A.fills(spark, sf_dir).where(F.col("day") <= now)
    signed = F.when(F.col("side") == "BUY", F.col("shares")).when(F.col("side") == "SELL", -F.col("shares")).otherwise(0)
    a = f.groupBy("account").agg(F.max("day").alias("day"), F.max_by("price", F.struct("ts", "fill_id")).alias("last_price"), F.count_if(F.col("day") == now).alias("today"), F.count_if(F.date_trunc("week", "day") == now).alias("this_week"), F.count_if(F.trunc("day", "month") == F.trunc(now, "month")).alias("this_month"), F.sum(signed).alias("held"))
    gaps = F.array_join(F.array_compact(F.array(F.when(F.col("held") < 0, F.lit("SHORT")), F.when(F.col("day") < F.date_sub(now, 1), F.lit("STALE_PRICE")))), ";")
    return a.select("account", "today", "this_week", "this_month", gaps.alias("gaps"), F.when(gaps == "", (F.col("held") * F.col("last_price")).cast("double")).alias("value"))


@query("AG22", with_parts("bars") + """, s AS (SELECT close / lag(close, 5) OVER w - 1 AS x, volume / 100 AS z, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS y, trade_date FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date))
    SELECT count(*) AS n, round(sum(x), 2) AS s_x, round(sum(x * z), 2) AS p_x_z, round(sum(z * z), 2) AS p_z_z, round(sum(z * y), 2) AS p_z_y FROM s WHERE trade_date < DATE '1999-01-01' AND x IS NOT NULL AND y IS NOT NULL""")
def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.gram(_samples(spark, sf_dir).where("trade_date < date'1999-01-01'"), ["x", "z"], "y")
    return g.select("n", *[F.round(c, 2).alias(c) for c in ("s_x", "p_x_z", "p_z_z", "p_z_y")])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bars(spark, sf_dir)
    return b.select("code", "trade_date", (F.col("close") / P.lagged("close", 5) - 1).alias("x"), (F.col("volume") / 100).alias("z"), P.forward_label().alias("y"))


@query("ML03 RK05")
def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the years before 1999, scored on those after; the solve is outside SQL, a test compares it with numpy."""
    s = _samples(spark, sf_dir)
    model = R.fit(s.where("trade_date < date'1999-01-01'"), ["x", "z"], "y")
    later = s.where("trade_date >= date'1999-01-01'").dropna().withColumn("score", model.score())
    return later.select("code", "trade_date", F.round("score", 6).alias("score"), F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("score"), "code")).cast("long").alias("place"))


@query("ML04 AG23", with_parts("monthly") + """, s AS (SELECT code, trade_date, close / lag(close) OVER w - 1 AS x, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS y FROM monthly WINDOW w AS (PARTITION BY code ORDER BY trade_date)), r AS (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY x, code) AS rx, row_number() OVER (PARTITION BY trade_date ORDER BY y, code) AS ry FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
    c AS (SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS ic FROM r GROUP BY 1) SELECT CAST(year(trade_date) AS BIGINT) AS y, count(*) AS months, round(avg(ic), 6) AS mean_ic, round(quantile_cont(ic, 0.5), 6) AS median_ic FROM c GROUP BY 1""")
def rank_ic_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.monthly(spark, sf_dir)
    s = m.select("code", "trade_date", (F.col("close") / P.lagged("close", 1) - 1).alias("x"), P.forward_label().alias("y")).dropna()
    c = M.rank_correlation(s, "trade_date", "x", "y", "code")
    return c.groupBy(F.year("trade_date").cast("long").alias("y")).agg(F.count("*").alias("months"), F.round(F.avg("rank_ic"), 6).alias("mean_ic"), F.round(F.percentile("rank_ic", F.lit(0.5)), 6).alias("median_ic"))


@query("RK06", None)
def watchlist_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By region, customers of highest balance, one a nation and two a segment; a test folds the same by hand."""
    n = T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    c = T(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey").select("region", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    best = c.withColumn("i", F.row_number().over(W.partitionBy("region", "c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("i = 1").drop("i")  # only the first of a pair can be taken
    return D.greedy_by_group(best, ["region"], [(-F.col("c_acctbal")).alias("_o"), F.col("c_custkey").alias("_k")], "c_mktsegment", "c_nationkey", 2, 5)
