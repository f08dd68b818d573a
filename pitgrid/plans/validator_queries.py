"""Queries that validate: canonical rows, segments, snapshots, translated orders, files and lists, with planted faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S
from pitgrid.operators import decisions as D
from pitgrid.operators import ledger as L
from pitgrid.operators import validators as V
from pitgrid.plans import adapters as A
from pitgrid.plans.registry import query, with_parts

T = A.table
_MONEY = "decimal(18,2)"


def _joined(errors: str) -> F.Column:
    return F.array_join(errors, ";").alias("errors")


@query("AU09", """WITH k AS (SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date, l_suppkey * 31 + day(l_shipdate) AS h FROM lineitem),
    e AS (SELECT *, h % 41 = 0 AS lost, h % 43 = 1 AS one_basis FROM k)
    SELECT code, trade_date, concat_ws(';', CASE WHEN lost THEN 'SOURCE_ROW_LOST' WHEN one_basis THEN 'NOT_IN_SOURCE' END, CASE WHEN one_basis THEN 'BASES_DISAGREE' END, CASE WHEN NOT lost AND h % 73 = 8 THEN 'REPEATED_KEY' END,
        CASE WHEN NOT lost AND NOT one_basis THEN nullif(concat_ws(';', CASE WHEN h % 71 = 7 THEN 'SOURCE_CODE_DIFFERS' END, CASE WHEN h % 59 = 4 THEN 'SCALE_DIFFERS' END, CASE WHEN h % 47 = 2 THEN 'RAW_DIFFERS:close' END,
            CASE WHEN h % 61 = 5 THEN 'ADJUSTED_DIFFERS:low' END, CASE WHEN h % 53 = 3 THEN 'ADJUSTED_DIFFERS:close' END), '') END) AS errors FROM e WHERE errors <> ''""")
def canonical_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources and the layer built of them, with rows lost, repeated and changed in it, and a price that a source lacks: the
    validator is given the three tables alone."""
    line = T(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(_MONEY)
    raw = line.groupBy(A.code_of("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min(price).alias("low"), F.max(price).alias("close"), F.sum(F.col("l_quantity").cast(_MONEY)).cast(_MONEY).alias("volume"))
    h = F.col("code").cast("long") * 31 + F.dayofmonth("trade_date")
    raw = raw.withColumn("code_used", F.col("code"))
    scale = F.when((F.col("code").cast("long") % 10 == 3) & (F.col("trade_date") <= F.lit("1995-06-30").cast("date")), F.lit("0.75")).otherwise(F.lit("1")).cast("decimal(6,4)")
    moved = lambda c: (F.col(c) * F.lit("0.9").cast("decimal(2,1)")).cast("decimal(20,4)")
    adjusted = raw.where(h % 43 != 1).select("code", "trade_date", F.when(~(h % 61).isin(5, 6), moved("low")).alias("low"), moved("close").alias("close"), "code_used")
    canonical = raw.where(h % 41 != 0).select(
        "code", "trade_date", "low", (F.col("close") + F.when(h % 47 == 2, 0.01).otherwise(0).cast(_MONEY)).cast(_MONEY).alias("close"), "volume",
        F.when(h % 71 == 7, "999999").otherwise(F.col("code")).alias("raw_source"), F.col("code").alias("adjusted_source"), F.when(h % 59 != 4, scale).alias("adjust_scale"),
        F.when(h % 61 != 6, moved("low") * scale).alias("low_adjusted"), (moved("close") * scale + F.when(h % 53 == 3, 0.0001).otherwise(0).cast("decimal(20,4)")).alias("close_adjusted"))
    canonical = canonical.union(canonical.where(h % 73 == 8))
    return V.canonical_errors(canonical, raw, adjusted, ["code", "trade_date"], ["low", "close", "volume"], ["low", "close"], scale).select("code", "trade_date", _joined("errors"))


@query("QG05 QG09", with_parts("bars") + """, r AS (SELECT code, trade_date, year(trade_date) AS segment FROM bars UNION ALL SELECT code, trade_date, year(trade_date) FROM bars WHERE CAST(code AS BIGINT) % 9 = 4 AND day(trade_date) = 15
        UNION ALL SELECT code, trade_date, year(trade_date) - 1 FROM bars WHERE CAST(code AS BIGINT) % 7 = 3 AND month(trade_date) = 1 AND day(trade_date) <= 10)
    SELECT code, CAST(segment AS BIGINT) AS segment, count(*) AS n_rows, concat_ws(';', CASE WHEN count(*) >= 60 THEN 'TRUNCATED' END, CASE WHEN count(*) > count(DISTINCT trade_date) THEN 'REPEATED_DATE' END,
        CASE WHEN count(*) FILTER (EXISTS (SELECT 1 FROM r o WHERE o.code = r.code AND o.trade_date = r.trade_date AND o.segment <> r.segment)) > 0 THEN 'OVERLAP' END) AS errors FROM r GROUP BY 1, 2""")
def segment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of bars as fetched segments; some days come twice, and some years begin in the segment before."""
    b = A.bars(spark, sf_dir).select("code", "trade_date", F.year("trade_date").cast("long").alias("segment"))
    n, day = F.col("code").cast("long"), F.dayofmonth("trade_date")
    early = b.where((n % 7 == 3) & (F.month("trade_date") == 1) & (day <= 10)).withColumn("segment", F.col("segment") - 1)
    rows = b.union(b.where((n % 9 == 4) & (day == 15))).union(early)
    return V.segment_errors(rows, ["code"], "segment", "trade_date", limit=60).select("code", "segment", "n_rows", _joined("errors"))


@query("QG08 AU10", with_parts("members") + """, w AS (SELECT *, date_diff('day', DATE '1992-01-06', observed_date) // 7 AS i, CAST(code AS BIGINT) % 10 AS n FROM members),
    r AS (SELECT observed_date, code, observed_date + CAST(CASE WHEN i % 11 = 0 THEN 1 ELSE -3 END AS INTEGER) - CAST(CASE WHEN i % 13 = 0 AND n = 1 THEN 7 ELSE 0 END AS INTEGER) AS updated FROM w UNION ALL SELECT observed_date, code, observed_date + CAST(CASE WHEN i % 11 = 0 THEN 1 ELSE -3 END AS INTEGER) FROM w WHERE i % 17 = 0 AND n = 2)
    SELECT observed_date, count(*) AS n_members, concat_ws(';', CASE WHEN count(*) < 8 THEN 'SIZE_OUT_OF_RANGE' END, CASE WHEN count(*) > count(DISTINCT code) THEN 'REPEATED_MEMBER' END, CASE WHEN count(DISTINCT updated) > 1 THEN 'SEVERAL_UPDATE_DATES' END,
        CASE WHEN max(updated) > observed_date THEN 'FUTURE_UPDATE' END) AS errors FROM r GROUP BY 1""")
def membership_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly sets with the day on which the source last changed them; in some weeks that day is later, or differs by member."""
    i, n = F.floor(F.datediff("observed_date", F.lit("1992-01-06").cast("date")) / 7), F.col("code").cast("long") % 10
    updated = F.date_add("observed_date", F.when(i % 11 == 0, 1).otherwise(-3))
    m = A.members(spark, sf_dir)
    rows = m.select("observed_date", "code", F.date_sub(updated, F.when((i % 13 == 0) & (n == 1), 7).otherwise(0)).alias("updated"))
    rows = rows.union(m.where((i % 17 == 0) & (n == 2)).select("observed_date", "code", updated))
    return V.snapshot_errors(rows, "observed_date", "updated", "code", 8, 1 << 40).select("observed_date", "n_members", _joined("errors"))


_STAR = "CASE WHEN CAST(code AS BIGINT) % 5 = 0 THEN '688' || code ELSE code END"


def _star(code: F.Column) -> F.Column:
    return F.when(code.cast("long") % 5 == 0, F.concat(F.lit("688"), code)).otherwise(code)


@query("CQ20 JN10", with_parts("bars") + f""", o AS (SELECT o_orderkey AS order_id, lpad(CAST(o_custkey % 20 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS day, o_totalprice AS requested FROM orders),
    p AS (SELECT o.order_id, o.day, o.requested, {_STAR.replace('code', 'o.code')} AS code, CASE WHEN CAST(o.code AS BIGINT) % 5 = 0 THEN 200 ELSE 100 END AS step, b.open, CASE WHEN b.volume < 5 THEN 0 ELSE b.volume END AS volume FROM o LEFT JOIN bars b ON b.code = o.code AND b.trade_date = o.day),
    s AS (SELECT *, CASE WHEN volume > 0 THEN CAST(floor(requested / open / step) AS BIGINT) * step END AS shares FROM p)
    SELECT order_id, code, day, CASE WHEN volume > 0 THEN open END AS open, shares, CASE WHEN volume IS NULL THEN 'MISSING_UNADJUSTED_PRICE' WHEN volume = 0 THEN 'NOT_CONFIRMED_TRADABLE' WHEN shares < step THEN 'CANDIDATE_BELOW_MINIMUM_SHARES' ELSE 'CANDIDATE_NOT_FILL' END AS reason FROM s""")
def share_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's amount in whole shares of its day's open; days of little volume count as halted."""
    o = T(spark, sf_dir, "orders")
    code = F.lpad((F.col("o_custkey") % 20).cast("string"), 6, "0")
    orders = o.select(F.col("o_orderkey").alias("order_id"), _star(code).alias("code"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("requested"))
    bars = A.bars(spark, sf_dir).withColumn("code", _star(F.col("code"))).withColumn("volume", F.when(F.col("volume") < 5, 0.0).otherwise(F.col("volume")))
    return V.whole_shares(orders, bars)


_IMPACT = """, q AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre, volume < 10 AS halted, CAST(code AS BIGINT) % 8 = 5 AND day(trade_date) % 6 = 2 AS blank FROM bars),
    o AS (SELECT o_orderkey AS order_id, lpad(CAST(o_custkey % 20 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM orders),
    j AS (SELECT o.order_id, o.side, q.code IS NOT NULL AS known, CASE WHEN blank THEN NULL ELSE q.open END AS open, pre, halted FROM o LEFT JOIN q ON q.code = o.code AND q.trade_date = o.day),
    h AS (SELECT order_id, unnest([CASE WHEN NOT known THEN 'MISSING_PRICE_ROW' END, CASE WHEN known AND pre IS NULL THEN 'MISSING_RULE_INPUT' END, CASE WHEN pre IS NOT NULL AND open IS NULL THEN 'INVALID_OPEN' END, CASE WHEN open IS NOT NULL AND pre IS NOT NULL AND halted THEN 'SUSPENDED_ORDER_DAY' END,
        CASE WHEN side = 'BUY' AND abs(open - pre * 1.1) <= 50 THEN 'BUY_AT_INFERRED_LIMIT_UP' END, CASE WHEN side = 'SELL' AND abs(open - pre * 0.9) <= 50 THEN 'SELL_AT_INFERRED_LIMIT_DOWN' END]) AS reason FROM j)"""


@query("CQ19", with_parts("bars") + _IMPACT + "SELECT reason, count(*) AS n, array_to_string(list_sort(list(order_id))[1:20], ',') AS samples FROM h WHERE reason IS NOT NULL GROUP BY 1")
def order_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by what an inferred limit of a tenth means for them; prices here are far apart, so 50 counts as at the limit."""
    from pyspark.sql import Window as W

    pre = F.lag("close").over(W.partitionBy("code").orderBy("trade_date"))
    blank = (F.col("code").cast("long") % 8 == 5) & (F.dayofmonth("trade_date") % 6 == 2)
    ruled = A.bars(spark, sf_dir).select("code", "trade_date", F.when(~blank, F.col("open")).alias("open"), (F.col("volume") < 10).alias("halted"), (pre * 1.1).alias("limit_up"), (pre * 0.9).alias("limit_down"))
    o = T(spark, sf_dir, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.lpad((F.col("o_custkey") % 20).cast("string"), 6, "0").alias("code"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"))
    return V.order_impact(orders, ruled, tolerance=50.0).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


_PROFILED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts", "customer": None, "pages": None}


@query("AG27", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n_rows, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS columns, {f"'{c}'" if c else 'CAST(NULL AS VARCHAR)'} AS date_column, "
    f"{f'CAST(CAST(min({c}) AS DATE) AS VARCHAR)' if c else 'CAST(NULL AS VARCHAR)'} AS date_min, {f'CAST(CAST(max({c}) AS DATE) AS VARCHAR)' if c else 'CAST(NULL AS VARCHAR)'} AS date_max FROM {t}" for t, c in _PROFILED.items()))
def file_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ("o_orderdate", "l_shipdate", "l_commitdate", "ts")
    dated = lambda df: df.select(*[F.to_date(c).alias(c) if c in known else c for c in df.columns])
    return reduce(DataFrame.unionAll, [V.profile(dated(T(spark, sf_dir, t)), t, known) for t in _PROFILED])


_SIZED = """, c AS (SELECT fill_id, price, CAST(20000 + fill_id % 977 * 13 AS DECIMAL(18,2)) AS cash, CAST(15000 + fill_id % 613 * 29 AS DECIMAL(18,2)) AS single, CASE WHEN fill_id % 37 = 0 THEN NULL ELSE CAST(16000 + fill_id % 409 * 31 AS DECIMAL(18,2)) END AS portfolio,
        CASE WHEN fill_id % 4 = 0 THEN 200 ELSE 100 END AS minimum, CASE WHEN fill_id % 4 = 0 THEN 1 ELSE 100 END AS step FROM fills),
    u AS (SELECT *, CASE WHEN portfolio IS NOT NULL THEN least(cash, single, portfolio) END AS budget, greatest(CAST(floor((least(cash, single, portfolio) / (price * 1.0003) - minimum) / step) AS BIGINT), 0) AS a, greatest(CAST(floor(((least(cash, single, portfolio) - 5) / price - minimum) / step) AS BIGINT), 0) AS b FROM c WHERE price > 0),
    t AS (SELECT *, minimum + greatest(k, 0) * step AS n FROM (SELECT *, unnest([0, a - 2, a - 1, a, a + 1, a + 2, b - 2, b - 1, b, b + 1, b + 2]) AS k FROM u WHERE budget IS NOT NULL)),
    v AS (SELECT fill_id, n, CAST(price * n AS DECIMAL(18,2)) AS gross, greatest(CAST(5 AS DECIMAL(18,2)), CAST(round(CAST(price * n AS DECIMAL(18,2)) * 0.0003, 2) AS DECIMAL(18,2))) AS fee, budget FROM t),
    m AS (SELECT fill_id, max(n) AS shares, max(gross) AS gross, arg_max(fee, n) AS fees FROM v WHERE gross + fee <= budget GROUP BY 1)"""


@query("SF22", with_parts("fills") + _SIZED + """SELECT c.fill_id, CASE WHEN c.price IS NULL OR c.price <= 0 OR c.portfolio IS NULL THEN 'INVALID_INPUT' WHEN m.shares IS NULL THEN 'BUDGET_BELOW_MINIMUM_LOT' ELSE 'SIZED_NOT_EXECUTED' END AS status, CAST(coalesce(m.shares, 0) AS BIGINT) AS shares,
    CAST(coalesce(m.gross, 0) AS DOUBLE) AS gross, CAST(coalesce(m.fees, 0) AS DOUBLE) AS fees, CAST(coalesce(m.gross + m.fees, 0) AS DOUBLE) AS required, CAST(CASE WHEN c.portfolio IS NOT NULL THEN least(c.cash, c.single, c.portfolio) END AS DOUBLE) AS budget FROM c LEFT JOIN m USING (fill_id)""")
def opening_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest opening purchase at every event's price, within cash, a single position's budget and the portfolio's."""
    k = F.col("fill_id")
    money = lambda base, mod, by: (base + k % mod * by).cast(_MONEY)
    star = k % 4 == 0
    sized = S.opening_size(money(20000, 977, 13), money(15000, 613, 29), F.when(k % 37 != 0, money(16000, 409, 31)), F.col("price"), F.when(star, 200).otherwise(100), F.when(star, 1).otherwise(100), "0.0003", "5")
    d = lambda c: F.col(f"s.{c}").cast("double").alias(c)
    return A.fills(spark, sf_dir).select("fill_id", sized.alias("s")).select("fill_id", "s.status", "s.shares", d("gross"), d("fees"), d("required"), d("budget"))


def _watch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "customer").join(F.broadcast(T(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select(F.col("n_regionkey").alias("region"), "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("AU06")
def watchlist_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of every region, chosen anew and held against one with faults: in region 1 places are counted from 2, in
    region 2 the second is gone, in region 3 the first two change places, in region 4 the first has a fellow of its nation."""
    candidates = _watch_candidates(spark, sf_dir)
    expected = D.greedy_by_group(candidates, ["region"], [(-F.col("c_acctbal")).alias("best"), F.col("c_custkey").alias("tie")], "c_mktsegment", "c_nationkey", 2, 5).select("region", "c_custkey", "c_nationkey", "place")
    place, region = F.col("place"), F.col("region")
    moved = F.when(region == 1, place + 1).when((region == 3) & (place <= 2), 3 - place).otherwise(place)
    given = expected.where(~((region == 2) & (place == 2))).select("region", "c_custkey", moved.alias("place"))
    first = expected.where((region == 4) & (place == 1)).select("region", "c_nationkey", F.col("c_custkey").alias("head"))
    fellow = candidates.join(first, ["region", "c_nationkey"]).where("c_custkey <> head").groupBy("region").agg(F.min("c_custkey").alias("c_custkey"))
    given = given.union(fellow.select("region", "c_custkey", F.lit(6).cast("long")))
    return V.watchlist_errors(candidates, given, expected, ["region"], "c_custkey", "c_nationkey", "c_mktsegment", 2).select("region", _joined("errors"))


_AS_OF = "2024-01-20"
_JOURNAL = f""", a AS (SELECT account, fill_id, ts, day, side, price, shares, lpad(CAST(fill_id % 3 AS VARCHAR), 6, '0') AS code, epoch_us(ts) AS seq FROM fills WHERE day <= DATE '{_AS_OF}' OR fill_id % 97 = 0),
    f AS (SELECT account, fill_id, ts, day, CASE WHEN fill_id % 211 = 0 THEN 0 ELSE seq END AS seq, side, code, price, CASE WHEN side = 'BUY' THEN shares ELSE -shares END AS s, greatest(CAST(1 AS DECIMAL(18,2)), CAST(ceil(CAST(price * shares AS DECIMAL(18,2)) * 0.0025 * 100) / 100 AS DECIMAL(18,2))) AS fee, copy
        FROM a, (VALUES (0), (1)) c(copy) WHERE side IS NOT NULL AND (copy = 0 OR fill_id % 331 = 7)),
    w AS (SELECT *, sum(s) OVER (PARTITION BY account, code ORDER BY ts, fill_id, copy) AS held, lag((day, seq)) OVER (PARTITION BY account ORDER BY ts, fill_id, copy) AS prior FROM f),
    fs AS (SELECT account, sum(-s * price - fee) AS flow, bool_or(day > DATE '{_AS_OF}') AS future, bool_or(held < 0) AS neg, coalesce(bool_or((day, seq) <= prior), false) AS early, bool_or(copy = 1) AS dup FROM w GROUP BY 1),
    p AS (SELECT account, code, sum(s) AS s, sum(greatest(s, 0)) AS b, sum(greatest(-s, 0)) AS o FROM f GROUP BY 1, 2), ps AS (SELECT account, bool_or(s <> greatest(b - o, 0) + CASE WHEN code = '000000' AND CAST(account AS BIGINT) % 18 = 2 THEN 1 ELSE 0 END) AS diff FROM p GROUP BY 1),
    d AS (SELECT account, fill_id, shares * 100 AS n, price AS g, CAST(price * 0.9 AS DECIMAL(20,3)) AS q, day + CAST(fill_id % 7 AS INTEGER) AS ex, day + CAST(fill_id % 7 + fill_id % 11 AS INTEGER) AS pay FROM a WHERE side IS NULL AND fill_id % 5 = 0),
    r AS (SELECT *, pay <= DATE '{_AS_OF}' OR fill_id % 83 = 0 AS paid FROM d WHERE ex <= DATE '{_AS_OF}' OR fill_id % 89 = 0),
    ds AS (SELECT account, bool_or(ex > DATE '{_AS_OF}') AS fut, bool_or(paid AND pay > DATE '{_AS_OF}') AS ep FROM r GROUP BY 1), u AS (SELECT DISTINCT account FROM d WHERE fill_id % 101 = 0 AND ex > DATE '{_AS_OF}' AND fill_id % 89 <> 0),
    c AS (SELECT account, coalesce(sum(CASE WHEN paid THEN n * q END), 0) AS got FROM r GROUP BY 1), k AS (SELECT DISTINCT account, CAST(account AS BIGINT) AS n FROM fills)"""


@query("LG10", with_parts("fills") + _JOURNAL + """ SELECT k.account, CAST(CAST(100000 + coalesce(flow, 0) + coalesce(got, 0) AS DECIMAL(18,2)) AS DOUBLE) AS expected_cash, concat_ws(';', CASE WHEN n % 10 = 3 THEN 'CASH_MISMATCH' END, CASE WHEN n % 14 = 4 THEN 'DIVIDEND_CASH_MISMATCH' END,
        CASE WHEN dup THEN 'DUPLICATE_FILL' END, CASE WHEN ep THEN 'EARLY_PAYMENT' END, CASE WHEN early THEN 'FILL_ORDER_INVALID' END, CASE WHEN future THEN 'FUTURE_FILL' END, CASE WHEN fut THEN 'FUTURE_RECOGNITION' END, CASE WHEN neg THEN 'NEGATIVE_POSITION' END,
        CASE WHEN n % 15 = 6 THEN 'RECEIVABLE_MISMATCH' END, CASE WHEN coalesce(diff, false) THEN 'SHARES_MISMATCH' END, CASE WHEN u.account IS NOT NULL THEN 'UNKNOWN_PAID_EVENT' END, CASE WHEN n % 16 = 7 THEN 'WITHHELD_MISMATCH' END) AS errors
    FROM k LEFT JOIN fs USING (account) LEFT JOIN ps USING (account) LEFT JOIN ds USING (account) LEFT JOIN c USING (account) LEFT JOIN u ON u.account = k.account""")
def account_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as a ledger stores them (cash by signed balances, lots first in first out) held against their journals, in
    which fills come twice, late, out of order or oversold, and dividends too soon; some stored figures are changed."""
    as_of = F.lit(_AS_OF).cast("date")
    n, k = F.col("account").cast("long"), F.col("fill_id")
    every = A.fills(spark, sf_dir)
    known = every.where((F.col("day") <= as_of) | (k % 97 == 0)).withColumn("code", F.lpad((k % 3).cast("string"), 6, "0"))
    fills = known.where("side is not null").withColumn("copy", F.explode(F.when(k % 331 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gross = (F.col("price") * F.col("shares")).cast(_MONEY)
    fee = F.greatest(F.lit(1).cast(_MONEY), S.round_up(gross * F.lit("0.0025").cast("decimal(8,6)")).cast(_MONEY))
    journal = fills.select("account", F.struct("ts", "fill_id", "copy").alias("at"), "fill_id", "day", F.when(k % 211 == 0, F.lit("1970-01-01").cast(every.schema["ts"].dataType)).otherwise(F.col("ts")).alias("seq"), "code", "side", "price", "shares", fee.alias("fees"))

    named = fills.withColumn("owner", F.col("account")).withColumn("account", F.concat_ws(":", "account", "code"))
    lots = L.fifo_lots(named).select("account", "left").unionByName(named.select("account"), True).groupBy("account").agg(F.sum("left").alias("left"))  # those that only sold too
    owner, code = F.substring_index("account", ":", 1), F.substring_index("account", ":", -1)
    extra = F.when((owner.cast("long") % 18 == 2) & (code == "000000"), 1).otherwise(0)
    lots = lots.select(owner.alias("account"), code.alias("code"), (F.coalesce("left", F.lit(0)) + extra).alias("shares"))

    ex = F.date_add("day", (k % 7).cast("int"))
    declared = known.where("side is null and fill_id % 5 = 0").select(
        "account", k.alias("event_id"), ex.alias("ex_date"), F.date_add(ex, (k % 11).cast("int")).alias("pay_date"), (F.col("shares") * 100).alias("shares"), F.col("price").alias("gross_per_share"), (F.col("price") * F.lit("0.9").cast("decimal(2,1)")).cast("decimal(20,3)").alias("payment_per_share"))
    event = F.col("event_id")
    recognised = declared.where((F.col("ex_date") <= as_of) | (event % 89 == 0)).withColumn("is_paid", (F.col("pay_date") <= as_of) | (event % 83 == 0))
    never = declared.where((F.col("ex_date") > as_of) & (event % 89 != 0) & (event % 101 == 0))
    paid = recognised.where("is_paid").select("account", "event_id").union(never.select("account", "event_id"))

    total = lambda which, per: F.coalesce(F.sum(F.when(which, F.col("shares") * per)), F.lit(0)).cast("decimal(28,4)")
    is_paid = F.col("is_paid")
    sums = recognised.groupBy("account").agg(total(is_paid, F.col("payment_per_share")).alias("got"), total(~is_paid, F.col("gross_per_share")).alias("open"), total(is_paid, F.col("gross_per_share") - F.col("payment_per_share")).alias("back"))
    cash = L.balances(fills, "0.0025", "1").select("account", "cash_change")
    stored = every.select("account").distinct().join(cash, "account", "left").join(sums, "account", "left")
    plus = lambda c, m, r: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,4)") + F.when(n % m == r, 1).otherwise(0)
    accounts = stored.select(
        "account", as_of.alias("as_of"), F.lit(100000).cast(_MONEY).alias("initial_cash"), (100000 + F.coalesce("cash_change", F.lit(0)).cast("decimal(28,4)") + plus("got", 10, 3)).alias("cash"),
        plus("got", 14, 4).alias("dividend_cash"), plus("open", 15, 6).alias("receivable"), plus("back", 16, 7).alias("withheld"))
    found = V.account_errors(accounts, journal, lots, recognised.drop("is_paid"), paid)
    return found.select("account", F.col("expected_cash").cast("double").alias("expected_cash"), _joined("errors"))
