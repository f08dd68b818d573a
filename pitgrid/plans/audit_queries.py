"""Queries that derive results a second way and compare: some stored rows are tampered with and must be found.

Stored figures are altered, and stored rows left out, for codes of certain remainders; the oracle names just these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators import ledger as L
from pitgrid.operators import metrics as M
from pitgrid.operators import panel as P
from pitgrid.plans import adapters as A
from pitgrid.plans import ledger_queries as LQ
from pitgrid.plans import panel_queries as Q
from pitgrid.plans.registry import REGISTRY, query, with_parts


def _number(code: str = "code") -> F.Column:
    return F.col(code).cast("long")


def _add(column: str, where: F.Column, by: float) -> F.Column:
    return F.when(where, F.col(column) + by).otherwise(F.col(column)).alias(column)


# ---- samples of the model

FEATURES = [*Q._K, "ROC20", "MA20", "STD20", "MAX20", "MIN20", "RSV20", "VMA20", "VSTD20", "return_5", "return_20", "volatility_20", "amount_median_5", "volume_median_5"]


def model_rows(bars: DataFrame) -> DataFrame:
    """(code, trade_date, 22 features, label); all share one partitioning, so they cost one shuffle."""
    back = lambda n: F.col("close") / P.lagged("close", n) - 1
    more = {"return_5": back(5), "return_20": back(20), "volatility_20": P.volatility("returns"), "amount_median_5": P.rolling_median("amount", 5), "volume_median_5": P.rolling_median("volume", 5)}
    features = P.candle_features() | P.position_features(20) | P.volume_features(20) | more
    windows = {"returns": ("moments", "ret", 19)} | P.position_windows(20) | P.volume_windows(20)
    return P.with_rolling(bars.withColumn("ret", P.returns()), windows).select("code", "trade_date", *[v.alias(k) for k, v in features.items()], P.forward_label().alias("label"))


SAMPLE_SQL = with_parts("bars") + """, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, nullif(high - low, 0) AS s FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    smp AS (SELECT code, trade_date, """ + ", ".join(f'{v} AS "{k}"' for k, v in Q._K.items()) + """, lag(close, 20) OVER w / close AS "ROC20", avg(close) OVER a / close AS "MA20", stddev_samp(close) OVER a / close AS "STD20", max(high) OVER a / close AS "MAX20", min(low) OVER a / close AS "MIN20",
        CASE WHEN max(high) OVER a > min(low) OVER a THEN (close - min(low) OVER a) / (max(high) OVER a - min(low) OVER a) END AS "RSV20", avg(volume) OVER a / volume AS "VMA20", stddev_samp(volume) OVER a / volume AS "VSTD20",
        close / lag(close, 5) OVER w - 1 AS return_5, close / lag(close, 20) OVER w - 1 AS return_20, CASE WHEN count(ret) OVER v = 19 THEN stddev_samp(ret) OVER v * sqrt(252) END AS volatility_20, quantile_cont(amount, 0.5) OVER b AS amount_median_5, quantile_cont(volume, 0.5) OVER b AS volume_median_5,
        lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS label FROM r
        WINDOW w AS (PARTITION BY code ORDER BY trade_date), a AS (PARTITION BY code ORDER BY trade_date ROWS 20 PRECEDING), v AS (PARTITION BY code ORDER BY trade_date ROWS 18 PRECEDING), b AS (PARTITION BY code ORDER BY trade_date ROWS 4 PRECEDING)) """
_WHOLE = " AND ".join(f'"{f}" IS NOT NULL' for f in [*FEATURES, "label"])


@query("CQ11", SAMPLE_SQL + "SELECT code, trade_date, " + ", ".join(f'round("{f}", 4) AS "{f}"' for f in [*FEATURES, "label"]) + f" FROM smp WHERE {_WHOLE}")
def model_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's input: rows that have all features and the label."""
    return Q._rounded(model_rows(A.bars(spark, sf_dir)).dropna(), *FEATURES, "label", places=4)


@query("AU07", SAMPLE_SQL + """, f AS (SELECT code, trade_date, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS back, "RSV20" FROM smp WHERE "ROC20" IS NOT NULL)
    SELECT code, CASE WHEN CAST(code AS BIGINT) % 9 = 2 AND CAST(code AS BIGINT) % 5 = 1 THEN 'KMID_DIFFERS;MA20_DIFFERS' WHEN CAST(code AS BIGINT) % 9 = 2 THEN 'MA20_DIFFERS' ELSE 'KMID_DIFFERS' END AS reasons FROM f WHERE back = 1 AND (CAST(code AS BIGINT) % 9 = 2 OR CAST(code AS BIGINT) % 5 = 1)""")
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candle and rolling features of each code's last day, again from its last 21 rows by plain aggregates."""
    b = A.bars(spark, sf_dir).withColumn("back", F.row_number().over(W.partitionBy("code").orderBy(F.desc("trade_date"))))
    columns = ["KMID", "KLEN", "ROC20", "MA20", "STD20", "MAX20", "MIN20", "RSV20", "VMA20", "VSTD20"]
    last = model_rows(A.bars(spark, sf_dir)).withColumn("back", F.row_number().over(W.partitionBy("code").orderBy(F.desc("trade_date")))).where("back = 1 and ROC20 is not null")
    n = _number()
    stored = last.select("code", *[_add(c, {"MA20": n % 9 == 2, "KMID": n % 5 == 1}.get(c, F.lit(False)), 0.001) for c in columns])
    at = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    g = b.where("back <= 21").groupBy("code").agg(
        F.count("*").alias("n"), *[at(c, 1).alias(c) for c in ("open", "high", "low", "close", "volume")], at("close", 21).alias("c20"), F.sum("close").alias("sum_c"), F.max("high").alias("hi"), F.min("low").alias("lo"),
        F.stddev_pop("close").alias("sd"), F.sum("volume").alias("sum_v"), F.stddev_pop("volume").alias("sd_v"))
    wide = F.sqrt(F.lit(21 / 20))
    c = F.col("close")
    again = g.where("n = 21").select(
        "code", ((c - F.col("open")) / F.col("open")).alias("KMID"), ((F.col("high") - F.col("low")) / F.col("open")).alias("KLEN"), (F.col("c20") / c).alias("ROC20"), (F.col("sum_c") / 21 / c).alias("MA20"), (F.col("sd") * wide / c).alias("STD20"),
        (F.col("hi") / c).alias("MAX20"), (F.col("lo") / c).alias("MIN20"), F.when(F.col("hi") > F.col("lo"), (c - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("RSV20"), (F.col("sum_v") / 21 / F.col("volume")).alias("VMA20"), (F.col("sd_v") * wide / F.col("volume")).alias("VSTD20"))
    return L.reconcile(stored, again, "code", columns, 1e-9)


# ---- factors

def month_factors(bars: DataFrame) -> DataFrame:
    """(code, m, mom, vol) of each code's last row of a month, by the places of its closes in one array a code: no window, no
    join. An array has a close a day, so the calendar bounds it, however many codes there are."""
    days = bars.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("trade_date", "close"))).alias("d"))
    days = days.select("code", F.size("d").alias("n"), F.col("d.close").alias("c"), F.transform("d.trade_date", lambda t: F.trunc(t, "month")).alias("m")).where("n > 252")
    r = days.select("*", F.zip_with("c", F.concat(F.array(F.lit(None).cast("double")), "c"), lambda c, one: c / one - 1).alias("r"))
    at = lambda c, i: F.element_at(c, i)
    ends = F.filter(F.sequence(F.lit(253), "n"), lambda i: (i == F.col("n")) | (F.get("m", i) != at("m", i)))
    spread = lambda s: s.s2 - s.s1 * s.s1 / 63  # noqa: E731  # null if any return is
    sums = lambda i: F.aggregate(F.slice("r", i - 62, 63), F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2")), lambda s, x: F.struct((s.s1 + x).alias("s1"), (s.s2 + x * x).alias("s2")),
                                 lambda s: F.when(spread(s) < 0, 0.0).otherwise(F.sqrt(spread(s) / 62 * 252)))
    rows = F.transform(ends, lambda i: F.struct(at("m", i).alias("m"), F.round(at("c", i - 21) / at("c", i - 252) - 1, 8).alias("mom"), F.round(sums(i), 8).alias("vol")))
    return r.select("code", F.inline(rows)).where("mom is not null and vol is not null")


_FACTOR_TAMPERED = "CAST(code AS BIGINT) % 7 = 3 AND month(m) = 6"


@query("AU01 AU02", Q.RANK_SQL + f"SELECT CAST(m AS DATE) AS m, code, CASE WHEN CAST(code AS BIGINT) % 11 = 5 THEN 'NOT_STORED' ELSE 'MOM_DIFFERS' END AS reasons FROM k WHERE CAST(code AS BIGINT) % 11 = 5 OR {_FACTOR_TAMPERED}")
def factor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum by the rows' numbers, volatility from sums, percentiles and places by rank: the eligible set, the values,
    the percentiles, the composite and the places of every month-end against those stored."""
    columns = ["mom", "vol", "momentum_percentile", "low_vol_percentile", "composite", "place"]
    n = _number()
    kept = Q.ranked(spark, sf_dir).select("m", "code", *[F.col(c).cast("double").alias(c) for c in columns]).where(n % 11 != 5)
    stored = kept.select("m", "code", _add("mom", (n % 7 == 3) & (F.month("m") == 6), 0.01), *columns[1:])

    e = month_factors(A.bars(spark, sf_dir))
    by = lambda *order: W.partitionBy("m").orderBy(*order)
    e = e.withColumn("momentum_percentile", F.percent_rank().over(by("mom", "code"))).withColumn("low_vol_percentile", 1 - F.percent_rank().over(by("vol", "code")))
    e = e.withColumn("composite", F.round((F.col("momentum_percentile") + F.col("low_vol_percentile")) / 2, 10))
    again = e.withColumn("place", F.rank().over(by(F.desc("composite"), "code")).cast("double")).where("code is not null")
    return L.reconcile(stored, again, ["m", "code"], columns, 1e-7)


# ---- event study

@query("AU05", Q.STUDY_SQL + """, st AS (SELECT k.code, k.mechanism, k.cal_idx, p.status FROM kept k JOIN paths p ON p.code = k.code AND p.cal_idx = k.cal_idx WHERE NOT (CAST(k.code AS BIGINT) % 13 = 5 AND p.horizon = 6)),
    v AS (SELECT code, mechanism, cal_idx, CASE WHEN CAST(code AS BIGINT) % 9 = 4 AND count(*) FILTER (status = 'OBSERVED') > 0 THEN 'RETURN_DIFFERS' END AS a, CASE WHEN CAST(code AS BIGINT) % 13 = 5 THEN 'HORIZON_MISSING' END AS b FROM st GROUP BY code, mechanism, cal_idx)
    SELECT code, mechanism, CAST(cal_idx AS BIGINT) AS cal_idx, concat_ws(';', a, b) AS reasons FROM v WHERE a IS NOT NULL OR b IS NOT NULL""")
def event_study_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored outcome again from the entry's open and the exit's close by calendar number, and that no horizon lacks."""
    n = _number()
    o = Q.observations(spark, sf_dir).select("code", "mechanism", "cal_idx", "horizon", "status", "forward_return").where(~((n % 13 == 5) & (F.col("horizon") == 6)))
    stored = o.withColumn("forward_return", _add("forward_return", n % 9 == 4, 0.01))
    m = A.monthly(spark, sf_dir)
    x = m.join(F.broadcast(P.calendar(m)), "trade_date")
    entry = x.select("code", (F.col("cal_idx") - 1).cast("long").alias("cal_idx"), F.col("open").alias("entry"))
    leave = x.select("code", F.col("cal_idx").cast("long").alias("exit_idx"), F.col("close").alias("leave"))
    j = stored.withColumn("exit_idx", (F.col("cal_idx") + F.col("horizon")).cast("long")).join(entry, ["code", "cal_idx"], "left").join(leave, ["code", "exit_idx"], "left")
    wrong = F.when(F.col("status") == "OBSERVED", F.coalesce(F.abs(F.col("leave") / F.col("entry") - 1 - F.col("forward_return")) > 1e-9, F.lit(True))).otherwise(F.col("forward_return").isNotNull())
    g = j.groupBy("code", "mechanism", "cal_idx").agg(F.bool_or(wrong).alias("wrong"), F.count_distinct("horizon").alias("horizons"))
    reasons = F.concat_ws(";", F.when(F.col("wrong"), "RETURN_DIFFERS"), F.when(F.col("horizons") != 3, "HORIZON_MISSING"))
    return g.select("code", "mechanism", "cal_idx", reasons.alias("reasons")).where("reasons <> ''")


@query("AU05", Q.STUDY_SQL + """SELECT mechanism, CAST(h AS BIGINT) AS horizon, CASE WHEN mechanism = 'R1' AND h = 12 THEN 'MEAN_EXCESS_DIFFERS' ELSE 'same' END AS verdict, signals, mean_excess FROM (SELECT mechanism, horizon AS h, count(*) AS signals, round(avg(excess), 6) AS mean_excess FROM obs GROUP BY mechanism, horizon)""")
def event_totals_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall figures by mechanism and horizon from the yearly ones, against those stored."""
    o = Q.observations(spark, sf_dir)
    g = o.groupBy("mechanism", "horizon").agg(F.count("*").alias("signals"), F.avg("excess").alias("mean_excess"))
    stored = g.withColumn("mean_excess", _add("mean_excess", (F.col("mechanism") == "R1") & (F.col("horizon") == 12), 0.01))
    years = o.groupBy("mechanism", "horizon", "y").agg(F.count("*").alias("n"), F.count("excess").alias("k"), F.sum("excess").alias("s"))
    again = years.groupBy("mechanism", "horizon").agg(F.sum("n").alias("signals"), (F.sum("s") / F.sum("k")).alias("mean_excess"))
    found = L.reconcile(stored, again, ["mechanism", "horizon"], ["signals", "mean_excess"], 1e-9)
    out = again.join(found, ["mechanism", "horizon"], "left")
    return out.select("mechanism", F.col("horizon").cast("long").alias("horizon"), F.coalesce("reasons", F.lit("same")).alias("verdict"), "signals", F.round("mean_excess", 6).alias("mean_excess"))


# ---- metrics

@query("MT04", "WITH RECURSIVE w AS (" + REGISTRY["rolling_windows"].sql.replace("WITH RECURSIVE ", "WITH ") + ") SELECT code, count(*) AS windows, round(count(*) FILTER (window_return > 0) / count(*), 6) AS positive_share, min(window_return) AS min_return, max(window_return) AS max_return, min(worst_drawdown) AS worst_drawdown FROM w GROUP BY 1")
def rolling_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._rounded(M.stability(LQ.rolling_windows(spark, sf_dir)), "positive_share", places=6)


_METRICS = "WITH RECURSIVE pm AS (" + REGISTRY["period_metrics"].sql.replace("WITH RECURSIVE ", "WITH ") + ") "


@query("CQ23", _METRICS + "SELECT pm.code, coalesce(pm.total_return <= b.total_return AND pm.max_drawdown <= b.max_drawdown AND pm.sharpe <= b.sharpe, false) AS dominated FROM pm, pm b WHERE b.code = '000001'")
def dominated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that do no better than the first code in return, drawdown and Sharpe ratio."""
    m = LQ.period_metrics(spark, sf_dir)
    return M.dominated(m, m.where("code = '000001'")).select("code", "dominated")


@query("MT05", _METRICS + """SELECT code, concat_ws(';', CASE WHEN CAST(code AS BIGINT) % 12 = 5 THEN 'TOTAL_RETURN_DIFFERS' END, CASE WHEN CAST(code AS BIGINT) % 8 = 1 THEN 'MAX_DRAWDOWN_DIFFERS' END, CASE WHEN CAST(code AS BIGINT) % 8 = 1 AND max_drawdown < 0 THEN 'CALMAR_DIFFERS' END) AS reasons
    FROM pm WHERE CAST(code AS BIGINT) % 12 = 5 OR CAST(code AS BIGINT) % 8 = 1""")
def metrics_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of period_metrics() a second way: a fold over the period's values, sums of returns and squares."""
    n, columns = _number(), ["n", "total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "calmar"]
    m = M.period_metrics(A.monthly(spark, sf_dir), "1997-01-01", "2000-12-01", value="close", per_year=12)
    stored = m.select("code", "n", _add("total_return", n % 12 == 5, 0.01), "annual_return", "volatility", "sharpe", _add("max_drawdown", n % 8 == 1, 0.01), _add("calmar", n % 8 == 1, 0.01))
    s = A.monthly(spark, sf_dir).where("trade_date <= date'2000-12-01'").select("code", "trade_date", "close", (F.col("trade_date") < F.lit("1997-01-01").cast("date")).alias("early"))
    base = s.where("early").groupBy("code").agg(F.max_by("close", "trade_date").alias("base"))
    path = s.where("not early").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("path"))  # a value a month of the period
    j = path.join(base, "code", "left").select("code", F.size("path").alias("n"), F.transform("path", lambda x: x.close).alias("v"), F.coalesce("base", F.get("path", F.lit(0)).close).alias("base"))
    zero = F.lit(0.0)
    start = F.struct(F.col("base").alias("at"), F.col("base").alias("peak"), zero.alias("worst"), zero.alias("s1"), zero.alias("s2"))

    def step(a, x):
        r, peak = x / a["at"] - 1, F.greatest(a.peak, x)
        return F.struct(x.alias("at"), peak.alias("peak"), F.least(a.worst, x / peak - 1).alias("worst"), (a.s1 + r).alias("s1"), (a.s2 + r * r).alias("s2"))

    f = j.select("code", "n", "base", F.aggregate("v", start, step).alias("f"))
    k = F.col("n")
    sd = F.when(k > 1, F.sqrt(F.greatest(zero, (F.col("f.s2") - F.col("f.s1") * F.col("f.s1") / k) / (k - 1)))).otherwise(zero)
    annual = F.exp(F.ln(F.col("f.at") / F.col("base")) * 12 / k) - 1
    again = f.select(
        "code", "n", (F.col("f.at") / F.col("base") - 1).alias("total_return"), annual.alias("annual_return"), (sd * F.sqrt(F.lit(12.0))).alias("volatility"), F.when(sd > 0, F.col("f.s1") / k / sd * F.sqrt(F.lit(12.0))).alias("sharpe"),
        F.col("f.worst").alias("max_drawdown"), F.when(F.col("f.worst") < 0, annual / -F.col("f.worst")).alias("calmar"))
    return L.reconcile(stored, again, "code", columns, 1e-9)


# ---- ledgers

@query("", with_parts("fills") + """, s AS (SELECT account, CAST(sum(CASE WHEN side = 'BUY' THEN shares ELSE -shares END) AS BIGINT) AS shares FROM fills WHERE side IS NOT NULL GROUP BY 1)
    SELECT account, CASE WHEN CAST(account AS BIGINT) % 15 = 6 THEN 'NOT_STORED' WHEN CAST(account AS BIGINT) % 10 = 4 THEN 'SHARES_DIFFERS' ELSE 'MATCH' END AS verdict, shares FROM s""")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each account's stored journal against a replay of its fills; some journals lack, some are altered."""
    n = _number("account")
    f = A.fills(spark, sf_dir).where("side is not null").withColumn("signed", F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares")))
    running = F.sum("signed").over(W.partitionBy("account").orderBy("ts", "fill_id").rowsBetween(W.unboundedPreceding, 0))
    journal = f.withColumn("running", running).groupBy("account").agg(F.max_by("running", F.struct("ts", "fill_id")).alias("shares"))
    stored = journal.where(n % 15 != 6).withColumn("shares", F.col("shares") + F.when(n % 10 == 4, 1).otherwise(0))
    replayed = f.groupBy("account").agg(F.sum("signed").alias("shares"))
    found = L.reconcile(stored, replayed, "account", ["shares"])
    return replayed.join(found, "account", "left").select("account", F.coalesce("reasons", F.lit("MATCH")).alias("verdict"), "shares")


@query("LG05", with_parts("fills") + """, d AS (SELECT DISTINCT account, day FROM fills), l AS (SELECT account, max(day) AS last_day FROM d GROUP BY 1),
    e AS (SELECT a.account, n AS event_id, DATE '2024-01-05' + CAST(n * 2 AS INTEGER) AS ex, DATE '2024-01-09' + CAST(n * 2 AS INTEGER) AS pay, CAST(a.account AS BIGINT) % 100 + n AS shares, CAST(a.account AS BIGINT) AS k FROM (SELECT DISTINCT account FROM fills) a, range(8) t(n)),
    s AS (SELECT e.*, (k + event_id) % 10 = 7 AS rewritten, (k + event_id) % 9 <> 4 AND EXISTS (SELECT 1 FROM d WHERE d.account = e.account AND d.day = ex) AS seen, (k + event_id) % 9 = 4 AS late, EXISTS (SELECT 1 FROM d WHERE d.account = e.account AND d.day = pay) AS paid, last_day FROM e JOIN l ON l.account = e.account),
    v AS (SELECT *, CASE WHEN rewritten THEN 'REWRITTEN' WHEN NOT seen AND (late OR last_day > ex) THEN 'LATE_EX' WHEN NOT seen THEN 'PENDING' WHEN paid THEN 'PAID' WHEN last_day > pay THEN 'LATE_PAY' ELSE 'RECEIVABLE' END AS status FROM s)
    SELECT account, event_id, status, CAST(CASE WHEN status = 'RECEIVABLE' THEN shares * 0.5 ELSE 0 END AS DOUBLE) AS receivable, CAST(CASE WHEN status = 'PAID' THEN shares * 0.4 ELSE 0 END AS DOUBLE) AS cash, CAST(CASE WHEN status = 'PAID' THEN shares * 0.1 ELSE 0 END AS DOUBLE) AS withheld FROM v""")
def dividend_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entitlements of every account on the days on which it has events; some are supplied late, some supplied anew with other
    contents."""
    days = A.fills(spark, sf_dir).select("account", "day")
    n, k, start = F.col("event_id"), _number("account"), F.lit("2024-01-05").cast("date")
    shares = (k % 100 + n).cast("decimal(12,2)")
    e = days.select("account").distinct().withColumn("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    e = e.select("account", "event_id", F.date_add(start, (n * 2).cast("int")).alias("ex_date"), F.date_add(start, (n * 2 + 4).cast("int")).alias("pay_date"), (shares * F.lit("0.5").cast("decimal(4,2)")).cast("decimal(18,2)").alias("gross"), (shares * F.lit("0.4").cast("decimal(4,2)")).cast("decimal(18,2)").alias("payment"))
    e = e.withColumn("supplied", F.date_add("ex_date", F.when((k + n) % 9 == 4, 1).otherwise(-1)))
    again = e.where((k + n) % 10 == 7).withColumn("gross", (F.col("gross") + 1).cast("decimal(18,2)"))
    out = L.advance(e.unionByName(again), days)
    return out.select("account", "event_id", "status", *[F.col(c).cast("double").alias(c) for c in ("receivable", "cash", "withheld")])
