"""Queries of gates, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S
from pitgrid.operators import gates as G
from pitgrid.operators import panel as P
from pitgrid.plans import adapters as A
from pitgrid.plans.registry import query, with_parts

T = A.table


@query("QG01", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.duplicate_keys(T(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")), "l_orderkey", "l_linenumber")


@query("PF02 QG03", with_parts("bars") + "SELECT CASE WHEN least(open, high, low, close) <= 0 THEN 'NON_POSITIVE' WHEN high < greatest(open, close) THEN 'HIGH_TOO_LOW' WHEN low > least(open, close) THEN 'LOW_TOO_HIGH' WHEN volume <= 0 THEN 'NO_VOLUME' ELSE '' END AS reason, count(*) AS n FROM bars GROUP BY 1")
def dq_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bars(spark, sf_dir).groupBy(G.bar_reason().alias("reason")).agg(F.count("*").alias("n"))


@query("QG02", "SELECT user_id, count(*) FILTER (ts <= before) AS not_ascending FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")
def dq_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("event_id"))
    return T(spark, sf_dir, "events").withColumn("before", before).groupBy("user_id").agg(F.count_if(F.col("ts") <= F.col("before")).alias("not_ascending"))


@query("QG06", "SELECT 'lang' AS field, count(nullif(lang, '')) AS filled FROM documents UNION ALL SELECT 'source', count(nullif(source, '')) FROM documents UNION ALL SELECT 'text', count(nullif(text, '')) FROM documents")
def dq_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_fields(T(spark, sf_dir, "documents"), "lang", "source", "text")


@query("QG07", with_parts("bars") + "SELECT trade_date, count(*) AS codes, count(*) >= 0.95 * (SELECT count(DISTINCT code) FROM bars) AS covered FROM bars WHERE trade_date > DATE '2001-06-30' GROUP BY 1")
def dq_coverage_after_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bars(spark, sf_dir)
    n = b.agg(F.countDistinct("code").alias("n"))
    late = b.where("trade_date > date'2001-06-30'").groupBy("trade_date").agg(F.count("*").alias("codes"))
    return late.withColumn("n", n.scalar()).select("trade_date", "codes", (F.col("codes") >= 0.95 * F.col("n")).alias("covered"))


@query("AG15", with_parts("members") + "SELECT count(DISTINCT observed_date) AS snapshots, count(DISTINCT h) AS different_sets, max(n) AS largest FROM (SELECT observed_date, sha256(string_agg(code, ',' ORDER BY code)) AS h, count(*) AS n FROM members GROUP BY 1)")
def member_set_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's identity is the hash of its sorted members."""
    sets = A.members(spark, sf_dir).groupBy("observed_date").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("code")), ","), 256).alias("h"), F.count("*").alias("n"))
    return sets.agg(F.countDistinct("observed_date").alias("snapshots"), F.countDistinct("h").alias("different_sets"), F.max("n").alias("largest"))


@query("QG10 ST02 ST03 ST04 ST06", """SELECT d, 'orders' AS only FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)
    UNION ALL SELECT d, 'lineitem' FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) WHERE d BETWEEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AND (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AND d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def calendar_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    span = a.agg(F.struct(F.min("d").alias("lo"), F.max("d").alias("hi")).alias("s"))
    b = A.days(spark, sf_dir).withColumnRenamed("trade_date", "d")
    inside = b.withColumn("s", span.scalar()).where("d between s.lo and s.hi").select("d")
    return a.exceptAll(b).withColumn("only", F.lit("orders")).union(inside.exceptAll(a).withColumn("only", F.lit("lineitem")))


@query("PF07 PF08 JN10", with_parts("bars") + """, o AS (SELECT o_orderkey, lpad(CAST(o_custkey % 10 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM orders),
    p AS (SELECT *, (close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1) * 100 AS chg FROM bars)
    SELECT side, CASE WHEN close IS NULL THEN 'MISSING_MARKET_ROW' WHEN coalesce(volume, 0) <= 0 THEN 'SUSPENDED_OR_ZERO_VOLUME' WHEN open IS NULL OR open <= 0 THEN 'MISSING_OR_NONPOSITIVE_OPEN' WHEN side = 'BUY' AND open = high AND high = low AND chg > 4.5 THEN 'ONE_PRICE_LIMIT_UP' WHEN side = 'SELL' AND open = high AND high = low AND chg < -4.5 THEN 'ONE_PRICE_LIMIT_DOWN' ELSE '' END AS reason, count(*) AS n
    FROM o LEFT JOIN p ON p.code = o.code AND p.trade_date = o.d GROUP BY 1, 2""")
def execution_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(F.lpad((F.col("o_custkey") % 10).cast("string"), 6, "0").alias("code"), F.to_date("o_orderdate").alias("trade_date"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"))
    p = A.bars(spark, sf_dir).withColumn("chg", P.returns() * 100)
    return o.join(p, ["code", "trade_date"], "left").groupBy("side", G.execution_rejection(F.col("side"), F.col("chg")).alias("reason")).agg(F.count("*").alias("n"))


@query("PF10", with_parts("fills") + """, g AS (SELECT account, coalesce(side, 'NONE') AS side, CASE WHEN fill_id % 11 = 0 THEN NULL ELSE shares END AS shares, price, CASE WHEN fill_id % 7 = 0 THEN NULL ELSE CAST(5 AS DECIMAL(18,2)) END AS lo, CAST(60 AS DECIMAL(18,2)) AS hi, CASE WHEN fill_id % 5 = 0 THEN NULL ELSE fill_id % 13 <> 0 END AS tradable FROM fills)
    SELECT side, CASE WHEN side NOT IN ('BUY', 'SELL') THEN 'INVALID_SIDE' WHEN coalesce(shares <= 0, true) THEN 'INVALID_SHARES' WHEN lo IS NULL OR hi IS NULL THEN 'RULES_MISSING' WHEN tradable IS DISTINCT FROM true THEN 'NOT_TRADABLE' WHEN coalesce(price <= 0, true) THEN 'INVALID_PRICE' WHEN price < lo OR price > hi THEN 'PRICE_OUT_OF_BOUNDS' WHEN side = 'BUY' AND price = hi THEN 'AT_UPPER_LIMIT' WHEN side = 'SELL' AND price = lo THEN 'AT_LOWER_LIMIT'
        WHEN side = 'BUY' AND shares < 10 THEN 'BELOW_MINIMUM' WHEN side = 'BUY' AND (shares - 10) % 5 <> 0 THEN 'NOT_A_STEP' WHEN side = 'SELL' AND shares > 40 THEN 'NOT_ENOUGH_SHARES' ELSE 'PRECHECK_PASS_NOT_FILL' END AS verdict, count(*) AS n FROM g GROUP BY 1, 2""")
def order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fills(spark, sf_dir).withColumn("side", F.coalesce("side", F.lit("NONE")))
    i = F.col("fill_id")
    money = lambda v: F.lit(v).cast("decimal(18,2)")
    verdict = G.order_gate(F.col("side"), F.when(i % 11 != 0, F.col("shares")), F.col("price"), F.when(i % 7 != 0, money(5)), money(60), F.when(i % 5 != 0, i % 13 != 0), F.lit(10), F.lit(5), F.lit(40))
    return f.groupBy("side", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("CQ16", with_parts("bars") + """, f AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (volume < 5) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) AS halts, CASE WHEN count(*) OVER m = 20 THEN quantile_cont(amount, 0.5) OVER m END AS med
        FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date), m AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING))
    SELECT CAST(year(trade_date) AS BIGINT) AS y, CASE WHEN n <= 252 THEN 'SHORT_HISTORY' WHEN halts > 4 THEN 'HALT_IN_WINDOW' WHEN volume < 5 THEN 'HALTED' WHEN coalesce(med < 40000, true) THEN 'LOW_AMOUNT' ELSE 'ELIGIBLE' END AS reason, count(*) AS n FROM f GROUP BY 1, 2""")
def eligibility_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing rule of each row."""
    halted = F.col("volume") < 5
    f = A.bars(spark, sf_dir).select("*", F.row_number().over(P.series()).alias("row_no"), F.count(F.when(halted, 1)).over(P.rows(-19, 0)).alias("halts"), P.rolling_median("amount", 20).alias("med"))
    reason = G.first_reason((F.col("row_no") <= 252, "SHORT_HISTORY"), (F.col("halts") > 4, "HALT_IN_WINDOW"), (halted, "HALTED"), (F.col("med") < 40000, "LOW_AMOUNT"), otherwise="ELIGIBLE")
    return f.groupBy(F.year("trade_date").cast("long").alias("y"), reason.alias("reason")).agg(F.count("*").alias("n"))


_FIN = "SELECT o_custkey AS k, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS profit, count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS ratio FROM orders GROUP BY ALL"


def _financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"))
    return o.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("profit"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("ratio"))


@query("D6 D14", f"""WITH f AS ({_FIN}), p AS (SELECT c.c_custkey AS k, c.c_acctbal AS bal, max(profit) FILTER (y = 1998) AS p98, max(profit) FILTER (y = 1999) AS p99, max(profit) FILTER (y = 2000) AS p00, quantile_cont(ratio, 0.5) FILTER (y BETWEEN 1998 AND 2000) AS med FROM customer c LEFT JOIN f ON f.k = c.c_custkey GROUP BY ALL)
    SELECT k, concat_ws(';', CASE WHEN p98 IS NULL OR p99 IS NULL OR p00 IS NULL THEN 'MISSING_YEAR' END, CASE WHEN coalesce(least(p98, p99, p00) < 100000, true) THEN 'WEAK_YEAR' END, CASE WHEN coalesce(med < 0.3, true) THEN 'LOW_MEDIAN' END, CASE WHEN bal <= 0 THEN 'NEGATIVE_BALANCE' END) AS reasons, round(med, 6) AS median_ratio FROM p""")
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three years' figures of a customer, known by the end of 2000, and all reasons against it."""
    year = lambda n: F.max(F.when(F.col("y") == n, F.col("profit"))).alias(f"p{n % 100:02}")
    by = _financials(spark, sf_dir).where("y between 1998 and 2000").groupBy("k").agg(year(1998), year(1999), year(2000), F.percentile("ratio", F.lit(0.5)).alias("med"))
    c = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal").join(by, "k", "left")
    some = F.col("p98").isNull() | F.col("p99").isNull() | F.col("p00").isNull()
    reasons = G.all_reasons((some, "MISSING_YEAR"), (F.least("p98", "p99", "p00") < 100000, "WEAK_YEAR"), (F.col("med") < 0.3, "LOW_MEDIAN"), (F.col("c_acctbal") <= 0, "NEGATIVE_BALANCE"))
    return c.select("k", reasons.alias("reasons"), F.round("med", 6).alias("median_ratio"))


@query("JN01", with_parts("bars", "monthly") + """, adj AS (SELECT l_suppkey, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date, max(l_discount) AS factor, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem WHERE l_tax < 0.08 GROUP BY ALL)
    SELECT coalesce(b.code, a.code) AS code, coalesce(b.trade_date, a.trade_date) AS trade_date, CASE WHEN a.code IS NULL THEN 'NO_ADJUSTED_ROW' WHEN b.volume <> a.volume THEN 'VOLUME_DIFFERS' ELSE 'MERGED' END AS status, round(CASE WHEN b.volume = a.volume THEN b.close * (1 - a.factor) END, 6) AS close_adjusted FROM bars b FULL JOIN adj a ON a.code = b.code AND a.trade_date = b.trade_date""")
def dual_basis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and adjusted rows of a day side by side; a difference in what both report is a status, not a guess."""
    b = A.bars(spark, sf_dir)
    a = T(spark, sf_dir, "lineitem").where("l_tax < 0.08").groupBy(A.code_of("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"))
    a = a.agg(F.max("l_discount").alias("factor"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume_adjusted"))
    m = b.join(a, ["code", "trade_date"], "full_outer")
    status = F.when(F.col("factor").isNull(), "NO_ADJUSTED_ROW").when(F.col("volume") != F.col("volume_adjusted"), "VOLUME_DIFFERS").otherwise("MERGED")
    return m.select("code", "trade_date", status.alias("status"), F.round(F.when(status == "MERGED", F.col("close") * (1 - F.col("factor"))), 6).alias("close_adjusted"))


@query("JN02 JN03 D5 AG01", with_parts("month_ends", "members") + ", r AS (SELECT signal_date, max(observed_date) AS observed_date FROM month_ends, members WHERE observed_date <= signal_date GROUP BY 1) SELECT r.signal_date, r.observed_date, m.code FROM r JOIN members m USING (observed_date)")
def asof_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by the last snapshot at or before each month end: the date is resolved first, then joined."""
    m = A.members(spark, sf_dir)
    snapshots = m.select("observed_date").distinct()
    ends = A.month_ends(A.days(spark, sf_dir)).withColumn("all", F.lit(0))
    resolved = P.as_of(ends, snapshots.withColumn("all", F.lit(0)), ["all"], "signal_date", "observed_date", ["observed_date"])
    return resolved.where("observed_date is not null").join(m, "observed_date").select("signal_date", "observed_date", "code")


@query("JN19 JN20", with_parts("bars") + """, e AS (SELECT event_id, lpad(CAST(user_id % 10 AS VARCHAR), 6, '0') AS code, CAST(ts AS DATE) - 8900 + CAST(event_id % 2000 AS INTEGER) AS d FROM events WHERE event_type = 'signup')
    SELECT e.event_id, e.code, e.d, b.trade_date AS held_date, b.close FROM e ASOF LEFT JOIN bars b ON e.code = b.code AND e.d > b.trade_date""")
def exposure_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bar strictly before each event."""
    e = T(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", F.lpad((F.col("user_id") % 10).cast("string"), 6, "0").alias("code"), F.date_add(F.to_date("ts"), (F.col("event_id") % 2000 - 8900).cast("int")).alias("d"))
    b = A.bars(spark, sf_dir).select("code", F.col("trade_date").alias("held_date"), "close")
    return P.as_of(e, b, ["code"], "d", "held_date", ["held_date", "close"], inclusive=False)


@query("JN04 JN05", with_parts("cal", "bars") + "SELECT b.code, b.trade_date AS signal_date, n.trade_date AS execution_date, x.open AS execution_open FROM bars b JOIN cal c USING (trade_date) JOIN cal n ON n.cal_idx = c.cal_idx + 1 LEFT JOIN bars x ON x.code = b.code AND x.trade_date = n.trade_date WHERE b.volume > 45")
def next_bar_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal is executed on the next date of the calendar, whether or not the code trades."""
    cal, b = P.calendar(A.days(spark, sf_dir)), A.bars(spark, sf_dir)
    nxt = cal.select((F.col("cal_idx") - 1).alias("cal_idx"), F.col("trade_date").alias("execution_date"))
    s = b.where("volume > 45").join(F.broadcast(cal.join(nxt, "cal_idx")), "trade_date").select("code", F.col("trade_date").alias("signal_date"), "execution_date")
    return s.join(b.select("code", F.col("trade_date").alias("execution_date"), F.col("open").alias("execution_open")), ["code", "execution_date"], "left").select("code", "signal_date", "execution_date", "execution_open")


@query("JN12", """WITH a AS (SELECT c_custkey AS id, c_nationkey AS g, CAST(round(c_acctbal / 100) AS BIGINT) AS amount FROM customer), b AS (SELECT s_suppkey AS sid, s_nationkey AS g, CAST(round(s_acctbal / 100) AS BIGINT) AS amount FROM supplier),
    m AS (SELECT a.id, b.sid, count(*) OVER (PARTITION BY a.id) AS na, count(*) OVER (PARTITION BY b.sid) AS nb FROM a JOIN b ON a.g = b.g AND abs(a.amount - b.amount) <= 2)
    SELECT b.sid, m.id, CASE WHEN m.id IS NULL THEN 'UNUSED' WHEN na = 1 AND nb = 1 THEN 'ONE_TO_ONE' ELSE 'AMBIGUOUS' END AS status FROM b LEFT JOIN m ON m.sid = b.sid""")
def interval_match_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches within an interval, accepted only if neither side has another; equi-joined by cells of the interval."""
    a = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.round(F.col("c_acctbal") / 100).cast("long").alias("amount"))
    b = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("g"), F.round(F.col("s_acctbal") / 100).cast("long").alias("near"))
    cells = b.select("sid", "g", "near", F.explode(F.sequence(F.col("near") - 2, F.col("near") + 2)).alias("amount"))
    m = cells.join(a, ["g", "amount"]).select("sid", "id")
    m = m.withColumn("na", F.count("*").over(W.partitionBy("id"))).withColumn("nb", F.count("*").over(W.partitionBy("sid")))
    status = F.when(F.col("id").isNull(), "UNUSED").when((F.col("na") == 1) & (F.col("nb") == 1), "ONE_TO_ONE").otherwise("AMBIGUOUS")
    return b.select("sid").join(m, "sid", "left").select("sid", "id", status.alias("status"))


@query("JN15 JN16", with_parts("monthly") + """, o AS (SELECT code, trade_date, close * CASE WHEN month(trade_date) = 6 THEN 1.001 ELSE 1 END AS close, volume + CASE WHEN year(trade_date) = 1999 THEN 150 ELSE 50 END AS volume FROM monthly WHERE month(trade_date) <> 2),
    j AS (SELECT m.code, m.trade_date, m.close AS c1, o.close AS c2, abs(m.close - o.close) > 0.0001 AS price_off, abs(m.volume - o.volume) > 100 AS volume_off, m.close / lag(m.close) OVER w - o.close / lag(o.close) OVER w AS rd FROM monthly m JOIN o USING (code, trade_date) WINDOW w AS (PARTITION BY code ORDER BY trade_date))
    SELECT code, count(*) AS compared, count(*) FILTER (price_off) AS price_differs, count(*) FILTER (volume_off) AS volume_differs, round(max(abs(rd)), 6) AS largest_return_difference FROM j GROUP BY 1""")
def cross_source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources on their common dates, within tolerances, and their returns from date to common date."""
    m = A.monthly(spark, sf_dir).select("code", "trade_date", "close", "volume")
    o = m.where("month(trade_date) <> 2").select("code", "trade_date", (F.col("close") * F.when(F.month("trade_date") == 6, 1.001).otherwise(1.0)).alias("close_2"), (F.col("volume") + F.when(F.year("trade_date") == 1999, 150).otherwise(50)).alias("volume_2"))
    j = m.join(o, ["code", "trade_date"]).withColumn("rd", F.col("close") / P.lagged("close", 1) - F.col("close_2") / P.lagged("close_2", 1))
    off = lambda a, b, t: F.count_if(F.abs(F.col(a) - F.col(b)) > t)
    return j.groupBy("code").agg(F.count("*").alias("compared"), off("close", "close_2", 0.0001).alias("price_differs"), off("volume", "volume_2", 100).alias("volume_differs"), F.round(F.max(F.abs("rd")), 6).alias("largest_return_difference"))


@query("JN17 D15 ST05", with_parts("monthly") + """, s AS (SELECT (SELECT arg_min(open, trade_date) FROM monthly WHERE code = '000002') / (SELECT arg_max(close, trade_date) FROM monthly WHERE code = '000001' AND trade_date < DATE '1998-01-01') AS k)
    SELECT '000002' AS code, trade_date, code AS source_code, round(CASE WHEN code = '000001' THEN close * k ELSE close END, 6) AS close FROM monthly, s WHERE code = '000001' AND trade_date < DATE '1998-01-01' OR code = '000002' AND trade_date >= DATE '1998-01-01'""")
def lineage_scale_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A successor's history: its own from the change on, before it the predecessor's, scaled to join."""
    m, cut = A.monthly(spark, sf_dir), F.lit("1998-01-01").cast("date")
    old, new = m.where((F.col("code") == "000001") & (F.col("trade_date") < cut)), m.where((F.col("code") == "000002") & (F.col("trade_date") >= cut))
    opened = m.where("code = '000002'").agg(F.min_by("open", "trade_date").alias("o"))
    closed = old.agg(F.max_by("close", "trade_date").alias("c"))
    scaled = old.withColumn("close", F.col("close") * (opened.scalar() / closed.scalar()))
    both = scaled.unionByName(new)
    return both.select(F.lit("000002").alias("code"), "trade_date", F.col("code").alias("source_code"), F.round("close", 6).alias("close"))


@query("JN22 JN23 AU04", "SELECT o_orderkey AS k, 'order' AS only FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'line' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return G.keys_of_one_side(a, b, "k").withColumn("only", F.when(F.col("only") == "left", "order").otherwise("line"))


@query("JN12 JN13 JN21 PF05", "SELECT n.n_name AS nation, r.r_name AS region, count(DISTINCT s.s_suppkey) AS suppliers, count(DISTINCT c.c_custkey) AS customers, count(s.s_suppkey) > 0 AS selected, CASE WHEN count(s.s_suppkey) = 0 THEN 'NO_SUPPLIER' ELSE '' END AS note FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE r.r_name NOT IN ('AFRICA') GROUP BY ALL")
def universe_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = T(spark, sf_dir, "nation"), T(spark, sf_dir, "region").where("r_name not in ('AFRICA')")
    s = T(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = T(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    j = n.join(r, n.n_regionkey == r.r_regionkey).join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return j.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), zero("suppliers"), zero("customers"), F.col("suppliers").isNotNull().alias("selected"), F.when(F.col("suppliers").isNull(), "NO_SUPPLIER").otherwise("").alias("note"))


@query("JN25", with_parts("monthly") + """, a AS (SELECT * FROM monthly WHERE month(trade_date) <> 3), b AS (SELECT code, trade_date, close * 2 AS close FROM monthly WHERE month(trade_date) IN (3, 7))
    SELECT coalesce(a.code, b.code) AS code, coalesce(a.trade_date, b.trade_date) AS trade_date, CASE WHEN a.code IS NULL OR year(b.trade_date) = 1999 THEN b.close ELSE a.close END AS close, CASE WHEN a.code IS NULL THEN 'second_gap_fill' WHEN year(b.trade_date) = 1999 THEN 'second_override' ELSE 'first' END AS row_source FROM a FULL JOIN b ON a.code = b.code AND a.trade_date = b.trade_date""")
def multi_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source, its gaps filled and its listed anomalies overridden from the second, with provenance."""
    m = A.monthly(spark, sf_dir)
    a = m.where("month(trade_date) <> 3").select("code", "trade_date", F.col("close").alias("c1"))
    b = m.where("month(trade_date) in (3, 7)").select("code", "trade_date", (F.col("close") * 2).alias("c2"))
    j = a.join(b, ["code", "trade_date"], "full_outer")
    origin = F.when(F.col("c1").isNull(), "second_gap_fill").when(F.col("c2").isNotNull() & (F.year("trade_date") == 1999), "second_override").otherwise("first")
    return j.select("code", "trade_date", F.when(origin == "first", F.col("c1")).otherwise(F.col("c2")).alias("close"), origin.alias("row_source"))


@query("JN27 AG16", with_parts("members", "bars") + ", s AS (SELECT code, min(observed_date) AS a, max(observed_date) AS b, count(*) AS n FROM members GROUP BY 1) SELECT s.code, s.a AS first_seen, s.b AS last_seen, s.n AS snapshots, count(b.trade_date) AS bars_inside FROM s LEFT JOIN bars b ON b.code = s.code AND b.trade_date BETWEEN s.a AND s.b GROUP BY ALL")
def coverage_inside_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.members(spark, sf_dir).groupBy("code").agg(F.min("observed_date").alias("first_seen"), F.max("observed_date").alias("last_seen"), F.count("*").alias("snapshots"))
    b = A.bars(spark, sf_dir).select("code", "trade_date")
    return s.join(b, (s.code == b.code) & b.trade_date.between(s.first_seen, s.last_seen), "left").groupBy(s.code, "first_seen", "last_seen", "snapshots").agg(F.count("trade_date").alias("bars_inside"))


@query("SC16 JN24", """WITH w AS (SELECT * FROM (VALUES (DATE '1995-01-01', DATE '1997-06-30'), (DATE '1997-07-01', DATE '1999-12-31'), (DATE '2000-01-01', DATE '2001-12-31')) t(a, b)), l AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1998-03-01' ELSE DATE '1990-01-01' END AS listed FROM supplier)
    SELECT k, greatest(a, listed) AS first_day, b AS last_day, basis FROM l, w, (VALUES ('raw'), ('adjusted')) v(basis) WHERE greatest(a, listed) <= b""")
def fetch_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task a code, window and basis, cut to the code's life: six rows a code, by explode."""
    day = lambda s: F.lit(s).cast("date")
    windows = F.array(*[F.struct(day(a).alias("a"), day(b).alias("b")) for a, b in (("1995-01-01", "1997-06-30"), ("1997-07-01", "1999-12-31"), ("2000-01-01", "2001-12-31"))])
    s = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, day("1998-03-01")).otherwise(day("1990-01-01")).alias("listed"))
    t = s.select("k", "listed", F.explode(windows).alias("w")).select("k", F.greatest("w.a", "listed").alias("first_day"), F.col("w.b").alias("last_day")).where("first_day <= last_day")
    return t.select("*", F.explode(F.array(F.lit("raw"), F.lit("adjusted"))).alias("basis"))


_RAW = """CASE c_custkey % 11 WHEN 0 THEN format('{:,.2f}', c_acctbal) WHEN 1 THEN printf('%.2f', c_acctbal) || '万' WHEN 2 THEN ' ' || format('{:,.2f}', c_acctbal) || '亿 ' WHEN 3 THEN printf('%.2f', c_acctbal) || '%' WHEN 4 THEN 'False' WHEN 5 THEN '--' WHEN 6 THEN 'nan'
    WHEN 7 THEN c_name WHEN 8 THEN '' WHEN 9 THEN NULL ELSE printf('%.2f', c_acctbal) END"""


@query("SF01 SF03 SF04 SF05", f"""SELECT c_custkey AS k, raw, round(CASE WHEN lower(t) NOT IN ('', 'false', 'none', 'null', 'nan', '--', '-') THEN TRY_CAST(regexp_replace(t, '[万亿%]$', '') AS DOUBLE) * CASE WHEN t LIKE '%万' THEN 1e4 WHEN t LIKE '%亿' THEN 1e8 WHEN t LIKE '%\\%' ESCAPE '\\' THEN 0.01 ELSE 1 END END, 6) AS number FROM (SELECT c_custkey, raw, replace(trim(raw), ',', '') AS t FROM (SELECT c_custkey, {_RAW} AS raw FROM customer))""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written in the spellings that reports use, read back; what is no number is null."""
    k, grouped, plain = F.col("c_custkey") % 11, F.format_number("c_acctbal", 2), F.format_string("%.2f", F.col("c_acctbal"))
    raw = (
        F.when(k == 0, grouped).when(k == 1, F.concat(plain, F.lit("万"))).when(k == 2, F.concat(F.lit(" "), grouped, F.lit("亿 "))).when(k == 3, F.concat(plain, F.lit("%")))
        .when(k == 4, "False").when(k == 5, "--").when(k == 6, "nan").when(k == 7, F.col("c_name")).when(k == 8, "").when(k == 9, None).otherwise(plain)
    )
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), raw.alias("raw"), F.round(S.parse_number(raw), 6).alias("number"))


@query("SF02 SF12 SF13 SF14", """SELECT DISTINCT d, CASE strftime(d, '%m-%d') WHEN '03-31' THEN make_date(year(d), 5, 15) WHEN '06-30' THEN make_date(year(d), 8, 31) WHEN '09-30' THEN make_date(year(d), 11, 15) WHEN '12-31' THEN make_date(year(d) + 1, 4, 30) ELSE d + 120 END AS available, CAST(d - INTERVAL 36 MONTH AS DATE) AS three_years_before FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def available_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", S.assumed_available_date(F.col("d")).alias("available"), F.add_months("d", -36).alias("three_years_before"))


@query("SF07 SF08 SF09 SF10 SF11", """WITH c AS (SELECT p_partkey, lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS code, p_partkey % 10 = 0 AS st, DATE '2026-06-01' + CAST(p_partkey % 90 AS INTEGER) AS d, CAST(p_retailprice AS DECIMAL(18,2)) AS pre FROM part),
    b AS (SELECT *, CASE WHEN left(code, 3) IN ('688', '689') THEN 'star' WHEN left(code, 3) IN ('300', '301', '302') THEN 'chinext' WHEN left(code, 3) IN ('430', '920') OR left(code, 2) IN ('83', '87') THEN 'bse' ELSE 'main' END AS board FROM c),
    r AS (SELECT *, CAST(CASE WHEN board IN ('star', 'chinext') THEN 0.2 WHEN board = 'bse' THEN 0.3 WHEN st AND d < DATE '2026-07-06' THEN 0.05 ELSE 0.1 END AS DECIMAL(4,2)) AS ratio FROM b)
    SELECT code, board, CAST(ratio AS DOUBLE) AS ratio, CAST(round(pre * (1 + ratio), 2) AS DOUBLE) AS upper_limit, CAST(round(pre * (1 - ratio), 2) AS DOUBLE) AS lower_limit, CASE WHEN left(code, 1) IN ('5', '6', '9') THEN 'sh.' ELSE 'sz.' END || code AS market FROM r""")
def board_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit prices in decimals, rounded half up as exchanges round them."""
    k = F.col("p_partkey")
    c = T(spark, sf_dir, "part").select(F.lpad((k * 7919 % 1000000).cast("string"), 6, "0").alias("code"), (k % 10 == 0).alias("st"), F.date_add(F.lit("2026-06-01").cast("date"), (k % 90).cast("int")).alias("d"), F.col("p_retailprice").cast("decimal(18,2)").alias("pre"))
    b = c.withColumn("board", S.board_of(F.col("code"))).withColumn("ratio", S.price_limit_ratio(F.col("board"), F.col("st"), F.col("d")))
    return b.select("code", "board", F.col("ratio").cast("double").alias("ratio"), S.half_up(F.col("pre") * (1 + F.col("ratio"))).cast("double").alias("upper_limit"), S.half_up(F.col("pre") * (1 - F.col("ratio"))).cast("double").alias("lower_limit"), S.market_prefix(F.col("code")).alias("market"))


@query("SF06 SF17 SF18 SF19 SF29", with_parts("fills") + """SELECT fill_id, side, CAST(g AS DOUBLE) AS gross, CAST(c AS DOUBLE) AS commission, CAST(s AS DOUBLE) AS stamp, CAST(ceil(g * 0.000137 * 100) / 100 AS DOUBLE) AS rounded_up, CAST(c + s AS DOUBLE) AS fees FROM
    (SELECT fill_id, side, g, CASE WHEN g > 0 THEN greatest(CAST(5 AS DECIMAL(18,2)), CAST(round(g * 0.0003, 2) AS DECIMAL(18,2))) ELSE 0 END AS c, CASE WHEN side = 'SELL' THEN CAST(round(g * CASE WHEN day >= DATE '2023-08-28' THEN 0.0005 ELSE 0.001 END, 2) AS DECIMAL(18,2)) ELSE 0 END AS s FROM (SELECT fill_id, side, day - CAST(fill_id % 400 AS INTEGER) AS day, CAST(price * shares * 100 AS DECIMAL(18,2)) AS g FROM fills WHERE side IS NOT NULL))""")
def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fills(spark, sf_dir).where("side is not null").withColumn("gross", (F.col("price") * F.col("shares") * 100).cast("decimal(18,2)")).withColumn("day", F.date_sub("day", (F.col("fill_id") % 400).cast("int")))
    f = f.withColumn("c", S.commission(F.col("gross"), "0.0003", "5")).withColumn("s", S.stamp_tax(F.col("gross"), F.col("day"), F.col("side")))
    up = S.round_up(F.col("gross") * F.lit("0.000137").cast("decimal(8,6)"))
    d = lambda c: c.cast("double")
    return f.select("fill_id", "side", d(F.col("gross")).alias("gross"), d(F.col("c")).alias("commission"), d(F.col("s")).alias("stamp"), d(up).alias("rounded_up"), d(F.col("c") + F.col("s")).alias("fees"))


@query("SF15 SF16 SF23", """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 + 1 AS INTEGER) AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS g FROM orders),
    b AS (SELECT *, CASE WHEN s - 1 >= CAST(a + INTERVAL 12 MONTH AS DATE) THEN 'OVER_ONE_YEAR' WHEN s - 1 >= CAST(a + INTERVAL 1 MONTH AS DATE) THEN 'ONE_MONTH_TO_ONE_YEAR' ELSE 'UP_TO_ONE_MONTH' END AS band FROM t)
    SELECT k, band, CAST(round(g * 0.2 * CASE band WHEN 'UP_TO_ONE_MONTH' THEN 1 WHEN 'ONE_MONTH_TO_ONE_YEAR' THEN 0.5 ELSE 0 END, 2) AS DOUBLE) AS tax, CASE WHEN year(a) <= 1996 THEN 'EARLY' WHEN year(a) <= 1998 THEN 'MIDDLE' WHEN year(a) <= 2000 THEN 'LATE' ELSE 'LAST' END AS phase FROM b""")
def dividend_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = T(spark, sf_dir, "orders").select(k.alias("k"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (k % 500 + 1).cast("int")).alias("s"), F.col("o_totalprice").cast("decimal(18,2)").alias("g"))
    b = t.withColumn("band", S.holding_band(F.col("a"), F.col("s")))
    return b.select("k", "band", S.dividend_tax(F.col("g"), F.col("band")).cast("double").alias("tax"), S.phase_of(F.year("a")).alias("phase"))


@query("SF20 SF21", with_parts("fills") + """, c AS (SELECT fill_id, price, price * 100 AS lot, CAST(20000 + fill_id % 977 * 13 AS DECIMAL(18,2)) AS cash FROM fills WHERE price > 0),
    g AS (SELECT *, CAST(floor((cash - 5) / lot) AS BIGINT) AS a, CAST(floor(cash / (lot * 1.0003)) AS BIGINT) AS b FROM c), t AS (SELECT fill_id, lot, cash, unnest([0, a - 1, a, a + 1, b - 1, b, b + 1]) AS n FROM g)
    SELECT fill_id, max(n) FILTER (n = 0 OR n > 0 AND CAST(lot * n AS DECIMAL(18,2)) + greatest(CAST(5 AS DECIMAL(18,2)), CAST(round(CAST(lot * n AS DECIMAL(18,2)) * 0.0003, 2) AS DECIMAL(18,2))) <= cash) * 100 AS shares FROM t GROUP BY 1""")
def affordable_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest affordable number of lots of every fill; a test tries every one."""
    c = A.fills(spark, sf_dir).where("price > 0").withColumn("cash", (20000 + F.col("fill_id") % 977 * 13).cast("decimal(18,2)"))
    return c.select("fill_id", S.affordable_lots(F.col("cash"), F.col("price"), "0.0003", "5").alias("shares"))


@query("SC19 D12 SF28", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN value <= 0 THEN 'NON_POSITIVE' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'NO_QUANTITY' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'TOO_LARGE' ELSE '' END AS reason FROM events""")
def quote_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "events").withColumn("q", F.from_json("props", "k bigint"))
    reason = F.when(F.col("value") <= 0, "NON_POSITIVE").when(F.col("q.k").isNull(), "NO_QUANTITY").when(F.col("q.k") > 90, "TOO_LARGE").otherwise("")
    return e.select("event_id", F.col("q.k").alias("k"), reason.alias("reason"))


@query("", """SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g') AS title FROM pages""")
def html_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " ").alias("title"))
