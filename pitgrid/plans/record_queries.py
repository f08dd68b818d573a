"""Queries of admissions and forward logs, journals replayed, account gaps, the model's features and the canonical layer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators import records as R
from pitgrid.plans import adapters as A
from pitgrid.plans.audit_queries import FEATURES, SAMPLE_SQL, model_rows
from pitgrid.plans.registry import REGISTRY, query, with_parts
from pitgrid.plans.validator_queries import share_translation
from pitgrid.sources import files as S

T = A.table
FROZEN = "2024-02-01"


def _joined(c: str) -> F.Column:
    return F.concat_ws(";", c).alias(c)


# ---- forward log: a list a nation; some lack their evidence, some hold a member that isn't for observation

_LISTS = """, m AS (SELECT CAST(c_nationkey AS BIGINT) AS k, 'list-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS report, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name AS name, c_mktsegment AS mechanism,
      c_nationkey % 6 = 4 AND c_custkey % 3 = 0 AS other FROM customer WHERE c_acctbal > 0),
    l AS (SELECT k, report, count(*) AS n_members, bool_or(other) AS other FROM m GROUP BY 1, 2),
    a AS (SELECT report, n_members, concat_ws(';', CASE WHEN k % 7 IN (3, 5) THEN 'VALIDATION_NOT_PASSED' END, CASE WHEN k % 8 IN (2, 6) THEN 'CROSSCHECK_NOT_CONFIRMED' END, CASE WHEN other THEN 'NOT_FORWARD_WATCH' END, CASE WHEN k = 21 THEN 'MEMBER_TWICE' END) AS reasons FROM l)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("c_nationkey").cast("long")
    c = T(spark, sf_dir, "customer").where("c_acctbal > 0")
    other = (k % 6 == 4) & (F.col("c_custkey") % 3 == 0)
    report = F.concat(F.lit("list-"), F.lpad(k.cast("string"), 2, "0")).alias("report")
    lists = c.select(report, A.code_of("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mechanism"), F.lit("2024-01-31").alias("cutoff"), F.when(other, "ORDERED").otherwise("FORWARD_WATCH_ONLY").alias("watch_status"), k.alias("k"))
    lists = lists.unionByName(lists.where("k = 21"))
    n = T(spark, sf_dir, "nation").select(F.concat(F.lit("list-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("report"), F.col("n_nationkey").alias("k"))
    validations = n.where("k % 7 <> 3").select("report", F.when(F.col("k") % 7 == 5, "FAIL").otherwise("PASS").alias("status"))
    confirmed = F.lit("H1_POSITIVE_PARENT_NETPROFIT_CONFIRMED")
    checks = n.where("k % 8 <> 6").select("report", F.lit("PASS").alias("status"), F.when(F.col("k") % 8 != 2, confirmed).alias("admission"))
    again = n.where("k % 8 = 2").select("report", F.lit("PASS").alias("status"), confirmed.alias("admission"))  # one confirms, one doesn't
    return lists, validations, checks.unionByName(again)


@query("CQ25", "WITH " + _LISTS[2:] + " SELECT report, n_members * CASE WHEN reasons LIKE '%TWICE%' THEN 2 ELSE 1 END AS n_members, reasons, CASE WHEN reasons = '' THEN 'ADMITTED_FOR_FORWARD_OBSERVATION_ONLY' ELSE 'REFUSED' END AS status FROM a")
def list_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.admissions(*_lists(spark, sf_dir)).select("report", "n_members", _joined("reasons"), "status")


@query("CQ25", "WITH " + _LISTS[2:] + f" SELECT 'signals' AS name, '{','.join(R.LOG_TABLES['signals'])}' AS columns, (SELECT CAST(coalesce(sum(n_members), 0) AS BIGINT) FROM a WHERE reasons = '') AS n_rows"
       + "".join(f" UNION ALL SELECT '{n}', '{','.join(c)}', {1 if n == 'daily_reconciliation' else 0}" for n, c in R.LOG_TABLES.items() if n != "signals"))
def forward_log_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six tables of a log over all admitted lists, written as text and read back."""
    lists, validations, checks = _lists(spark, sf_dir)
    signals = R.baseline_signals(lists, R.admissions(lists, validations, checks), f"{FROZEN}T00:00:00")
    return R.open_log(signals, f"{S.shared_folder(spark)}/forward-{uuid.uuid4().hex}", FROZEN).drop("rows_hash")


@query("CQ25", "WITH " + _LISTS[2:] + " SELECT 'BASELINE:' || mechanism || ':' || code || ':2024-01-31' AS signal_id, code AS stock_code, name, 'false' AS actionable, m.report AS source_watchlist FROM m JOIN a ON a.report = m.report WHERE reasons = ''")
def forward_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, validations, checks = _lists(spark, sf_dir)
    s = R.baseline_signals(lists, R.admissions(lists, validations, checks), f"{FROZEN}T00:00:00")
    return s.select("signal_id", "stock_code", "name", "actionable", "source_watchlist")


# ---- journals

_REPLAY = """, f AS (SELECT * FROM fills WHERE side IS NOT NULL AND price IS NOT NULL AND shares IS NOT NULL), n AS (SELECT account, CAST(account AS BIGINT) AS n, CAST(sum(CASE side WHEN 'BUY' THEN shares ELSE -shares END) AS BIGINT) AS net,
      sum(CASE side WHEN 'BUY' THEN -1 ELSE 1 END * price * shares - 1) AS flow FROM f GROUP BY 1),
    b AS (SELECT f.account, fill_id, shares, greatest(0, least(shares, net - coalesce(sum(shares) OVER (PARTITION BY f.account ORDER BY ts DESC, fill_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS open,
      row_number() OVER (PARTITION BY f.account ORDER BY fill_id) AS i FROM f JOIN n ON n.account = f.account WHERE side = 'BUY'),
    o AS (SELECT account, count(*) FILTER (open > 0) AS lots, max(CASE WHEN i = 1 THEN open END) AS first_open FROM b GROUP BY 1)
    SELECT n.account, CASE WHEN net < 0 THEN 'NOT_REPLAYABLE' WHEN d = '' THEN 'REPLAY_MATCH' ELSE 'REPLAY_DIFFERS' END AS status, d AS differences, CAST(CAST(100000 + flow AS DECIMAL(18,2)) AS DOUBLE) AS cash, net AS shares FROM n
    JOIN (SELECT n.account, concat_ws(';', CASE WHEN n % 10 = 4 THEN 'CASH_DIFFERS' END, CASE WHEN n % 15 = 6 AND coalesce(first_open, 0) > 0 THEN 'LOT_MISSING' END, CASE WHEN n % 9 = 2 THEN 'LOT_UNKNOWN' END, CASE WHEN n % 12 = 7 AND coalesce(lots, 0) > 0 THEN 'LOT_TWICE' END,
      CASE WHEN n % 14 = 3 AND coalesce(lots, 0) > 0 AND NOT (lots = 1 AND n % 15 = 6 AND coalesce(first_open, 0) > 0) THEN 'LOT_SHARES_DIFFER' END, CASE WHEN n % 13 = 5 AND coalesce(lots, 0) > 0 AND NOT (lots = 1 AND n % 15 = 6 AND coalesce(first_open, 0) > 0) THEN 'SELLABLE_DAY_DIFFERS' END) AS d
      FROM n LEFT JOIN o ON o.account = n.account) x ON x.account = n.account"""


@query("LG13", with_parts("fills") + _REPLAY)
def first_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's journal replayed and held against stored cash and lots. What is stored is got from the newest lot
    backwards, the replay goes forwards from the oldest; faults of six kinds are planted."""
    f = A.fills(spark, sf_dir).where("side is not null and price is not null and shares is not null").withColumn("fees", F.lit(1).cast("decimal(18,2)"))
    n = F.col("account").cast("long")
    signed = F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares"))
    step = (-signed * F.col("price") - F.col("fees")).cast("decimal(18,2)")
    per = f.groupBy("account").agg(F.sum(signed).alias("net"))
    by_time = W.partitionBy("account").orderBy("ts", "fill_id")
    last = f.withColumn("running", F.sum(step).over(by_time.rowsBetween(W.unboundedPreceding, 0))).groupBy("account").agg(F.max_by("running", F.struct("ts", "fill_id")).alias("running"))
    runs = last.select("account", F.lit(100000).cast("decimal(18,2)").alias("initial_cash"), (F.col("running") + 100000 + F.when(n % 10 == 4, 1).otherwise(0)).cast("decimal(18,2)").alias("cash"))
    newer = F.coalesce(F.sum("shares").over(W.partitionBy("account").orderBy(F.desc("ts"), F.desc("fill_id")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buys = f.where("side = 'BUY'").withColumn("newer", newer).withColumn("i", F.row_number().over(W.partitionBy("account").orderBy("fill_id"))).join(per, "account")
    open_lots = buys.withColumn("open", F.greatest(F.lit(0), F.least(F.col("shares"), F.col("net") - F.col("newer")))).where("open > 0")
    stored = lambda lots: lots.select("account", F.col("fill_id").alias("lot_id"), (F.col("open") + F.when(n % 14 == 3, 1).otherwise(0)).alias("shares"), F.date_add("day", F.when(n % 13 == 5, 2).otherwise(1)).alias("sellable_on"))
    lots, twice = stored(open_lots.where(~((n % 15 == 6) & (F.col("i") == 1)))), stored(open_lots.where(n % 12 == 7))
    unknown = per.where(n % 9 == 2).select("account", F.lit(-1).cast("long").alias("lot_id"), F.lit(100).cast("long").alias("shares"), F.lit(FROZEN).cast("date").alias("sellable_on"))
    found = R.replay_journals(runs, f, lots.unionByName(twice).unionByName(unknown))
    return found.select("account", "status", _joined("differences"), F.col("cash").cast("double").alias("cash"), "shares")


# ---- gaps of the account

_EVIDENCE = {"has_fill": "o_orderkey % 50 <> 1", "has_lot": "year(o_orderdate) > 1992", "has_rule": "year(o_orderdate) <> 1995 OR o_orderkey % 97 <> 3", "has_action": "year(o_orderdate) % 2 = 0", "has_fee": "year(o_orderdate) >= 1994"}


@query("CQ20", f"""WITH t AS ({REGISTRY['share_translation'].sql}), e AS (SELECT o_orderkey AS order_id, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(o_totalprice AS DECIMAL(18,2)) AS requested, {', '.join(f'{v} AS {k}' for k, v in _EVIDENCE.items())} FROM orders),
    g AS (SELECT year, count(*) AS n_orders, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, CAST(sum(requested) AS DOUBLE) AS requested, CAST(coalesce(sum(shares), 0) AS BIGINT) AS candidate_shares, CAST(coalesce(sum(shares * CAST(open AS DECIMAL(18,4))), 0) AS DOUBLE) AS candidate_notional,
      CAST(0 AS BIGINT) AS untranslated, count(*) FILTER (reason = 'MISSING_UNADJUSTED_PRICE') AS missing_price, count(*) FILTER (reason = 'NOT_CONFIRMED_TRADABLE') AS not_tradable, count(*) FILTER (reason = 'CANDIDATE_BELOW_MINIMUM_SHARES') AS below_minimum, count(*) FILTER (reason = 'CANDIDATE_NOT_FILL') AS candidates,
      concat_ws(';', CASE WHEN NOT bool_and(has_fill) THEN 'RESEARCH_ORDER_NOT_REAL_FILL' END, CASE WHEN NOT bool_and(has_lot) THEN 'NO_INITIAL_REAL_SHARE_LOTS' END, CASE WHEN NOT bool_and(has_rule) THEN 'NO_VERIFIED_PRICE_LIMIT_RULE' END, CASE WHEN NOT bool_and(has_action) THEN 'NO_COMPLETE_CORPORATE_ACTION_COVERAGE' END, CASE WHEN NOT bool_and(has_fee) THEN 'NO_FEE_SLIPPAGE_MAPPING' END) AS blockers
      FROM e JOIN t USING (order_id) GROUP BY 1)
    SELECT *, CASE WHEN blockers <> '' THEN 'NOT_READY_REAL_SHARE_ACCOUNT' WHEN candidates < n_orders THEN 'NOT_ALL_TRANSLATED' ELSE 'READY_FOR_REPLAY' END AS status FROM g""")
def yearly_account_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year's orders: candidates in whole shares, and what evidence some of them lack."""
    o = T(spark, sf_dir, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.year("o_orderdate").cast("long").alias("year"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("o_totalprice").alias("requested"))
    evidence = o.select(F.col("o_orderkey").alias("order_id"), *[F.expr(v).alias(k) for k, v in _EVIDENCE.items()])
    g = R.account_gaps(orders, share_translation(spark, sf_dir), evidence, "year")
    return g.withColumns({"requested": F.col("requested").cast("double"), "candidate_notional": F.col("candidate_notional").cast("double"), "blockers": _joined("blockers")})


# ---- the model's features

_FULL = {**{f: '"ROC20" IS NOT NULL' for f in ("MA20", "STD20", "MAX20", "MIN20", "VMA20", "VSTD20", "RSV20")}, **{f: "back4 IS NOT NULL" for f in ("amount_median_5", "volume_median_5")}}


@query("ML05", SAMPLE_SQL.rstrip() + ", s5 AS (SELECT *, lag(trade_date, 4) OVER (PARTITION BY code ORDER BY trade_date) AS back4 FROM smp) " + " UNION ALL ".join(
    f"""SELECT CAST({i + 1} AS BIGINT) AS place, '{n}' AS name, '{u}' AS unit, '{m}' AS missing, count(*) AS n_rows, count(*) FILTER (NOT ("{n}" IS NOT NULL AND {_FULL.get(n, 'true')})) AS n_missing, round(min("{n}") FILTER ({_FULL.get(n, 'true')}), 4) AS least, round(max("{n}") FILTER ({_FULL.get(n, 'true')}), 4) AS greatest FROM s5"""
    for i, (n, _, u, m) in enumerate(R.FEATURES)))
def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature is, and how many of all rows lack it."""
    r = R.feature_registry(model_rows(A.bars(spark, sf_dir)).select(*FEATURES))
    return r.drop("formula").withColumns({c: F.round(c, 4) for c in ("least", "greatest")})


# ---- the canonical layer

_QUARTER = "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS d FROM lineitem WHERE l_suppkey % 7 <> 3 GROUP BY ALL"
_LAYER = f""", u AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_suppkey AS k, s_nationkey AS nation FROM supplier), q AS ({_QUARTER}), i AS (SELECT DISTINCT 'N' || nation AS code, date_trunc('month', trade_date) AS d FROM bars JOIN u ON u.code = bars.code),
    parts AS (SELECT 'daily_prices' AS dataset, count(*) AS n_rows, count(DISTINCT code) AS n_codes, CAST(min(trade_date) AS VARCHAR) AS first, CAST(max(trade_date) AS VARCHAR) AS last, (SELECT count(*) FROM u WHERE code NOT IN (SELECT code FROM bars)) AS lacking FROM bars
    UNION ALL SELECT 'financial_reports', count(*), count(DISTINCT code), CAST(min(d) AS VARCHAR), CAST(max(d) AS VARCHAR), (SELECT count(*) FROM u WHERE code NOT IN (SELECT code FROM q)) FROM q
    UNION ALL SELECT 'trade_calendar', count(*), 0, CAST(min(trade_date) AS VARCHAR), CAST(max(trade_date) AS VARCHAR), 0 FROM cal
    UNION ALL SELECT 'benchmark', count(*), 1, CAST(min(trade_date) AS VARCHAR), CAST(max(trade_date) AS VARCHAR), 0 FROM cal
    UNION ALL SELECT 'current_universe', count(*), count(DISTINCT code), NULL, NULL, 0 FROM u
    UNION ALL SELECT 'current_industry', count(*), count(DISTINCT code), NULL, NULL, (SELECT count(*) FROM u WHERE k % 11 = 5) FROM u WHERE k % 11 <> 5
    UNION ALL SELECT 'industry_index', count(*), count(DISTINCT code), CAST(CAST(min(d) AS DATE) AS VARCHAR), CAST(CAST(max(d) AS DATE) AS VARCHAR), 0 FROM i),
    v AS (SELECT *, concat_ws(';', CASE WHEN n_rows = 0 THEN 'EMPTY' END, CASE WHEN dataset = 'industry_index' AND n_codes <> 25 THEN 'CODE_COUNT_UNEXPECTED' END, CASE WHEN lacking > 0 THEN 'UNIVERSE_NOT_COVERED' END) AS failures FROM parts)
    SELECT dataset, n_rows, n_codes, first, last, lacking, failures, CASE WHEN (SELECT max(length(failures)) FROM v) > 0 THEN 'REFUSED' ELSE 'PASS_WITH_KNOWN_LIMITS' END AS status FROM v"""


@query("CQ14", with_parts("bars", "cal") + _LAYER)
def canonical_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven datasets of the layer, held against the universe; codes that some of them lack refuse the whole."""
    bars = A.bars(spark, sf_dir)
    supplier = T(spark, sf_dir, "supplier").select(A.code_of("s_suppkey").alias("code"), "s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("industry"))
    reports = T(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 3").groupBy(A.code_of("l_suppkey").alias("code"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("report_date")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))
    index = bars.join(supplier, "code").groupBy("industry", F.to_date(F.date_trunc("month", "trade_date")).alias("month")).agg(F.avg("close").alias("close"))
    datasets = {
        "daily_prices": (bars, "code", "trade_date"), "financial_reports": (reports, "code", "report_date"), "trade_calendar": (A.days(spark, sf_dir), None, "trade_date"),
        "benchmark": (bars.groupBy("trade_date").agg(F.avg("close").alias("close")).withColumn("index_code", F.lit("000300")), "index_code", "trade_date"),
        "current_universe": (supplier, "code", None), "current_industry": (supplier.where("s_suppkey % 11 <> 5"), "code", None), "industry_index": (index, "industry", "month"),
    }
    return R.layer_summary(datasets, supplier, ("daily_prices", "financial_reports", "current_industry"), {"industry_index": 25}).withColumn("failures", _joined("failures"))
