"""Queries over bars: features, ranking, event study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators import panel as P
from pitgrid.plans import adapters as A
from pitgrid.plans.registry import query, with_parts

R = "round({}, 8)"


def _rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("D2 PF02 SC03", with_parts("bars") + "SELECT * FROM bars")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bars(spark, sf_dir)


@query("D2", with_parts("monthly") + "SELECT * FROM monthly")
def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly(spark, sf_dir)


@query("D4 ST01", with_parts("cal") + "SELECT trade_date, CAST(cal_idx AS BIGINT) AS cal_idx FROM cal")
def trade_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calendar(A.days(spark, sf_dir)).withColumn("cal_idx", F.col("cal_idx").cast("long"))


@query("SC18 WN26", """SELECT CAST(year(d) AS BIGINT) AS y, CAST(month(d) AS BIGINT) AS m, max(d) AS month_end, (SELECT count(DISTINCT date_trunc('week', CAST(l_shipdate AS DATE))) FROM lineitem) AS n_weeks
    FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1, 2""")
def calendar_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ends, and the number of first dates of a week."""
    days = A.days(spark, sf_dir)
    weeks = days.groupBy(F.date_trunc("week", "trade_date").alias("w")).agg(F.min("trade_date").alias("first"))
    ends = A.month_ends(days)
    return ends.select(F.year("signal_date").cast("long").alias("y"), F.month("signal_date").cast("long").alias("m"), F.col("signal_date").alias("month_end")).crossJoin(F.broadcast(weeks.agg(F.count("*").alias("n_weeks"))))


FACTOR_SQL = with_parts("bars") + """, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    f AS (SELECT code, trade_date, n, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS momentum,
        CASE WHEN count(ret) OVER v = 63 THEN stddev_samp(ret) OVER v * sqrt(252) END AS volatility,
        CASE WHEN count(amount) OVER m = 20 THEN quantile_cont(amount, 0.5) OVER m END AS median_amount
        FROM r WINDOW w AS (PARTITION BY code ORDER BY trade_date), v AS (PARTITION BY code ORDER BY trade_date ROWS 62 PRECEDING), m AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING)) """


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.with_rolling(A.bars(spark, sf_dir).withColumn("ret", P.returns()), {"returns": ("moments", "ret", 63)})
    return b.select("code", "trade_date", P.momentum().alias("momentum"), P.volatility("returns").alias("volatility"), P.rolling_median("amount", 20).alias("median_amount"))


@query("WN01 WN02 WN03 WN04 CQ01 CQ02", FACTOR_SQL + "SELECT code, trade_date, round(momentum, 8) AS momentum, round(volatility, 8) AS volatility, round(median_amount, 4) AS median_amount FROM f WHERE momentum IS NOT NULL")
def factor_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(factors(spark, sf_dir).where("momentum is not null"), "momentum", "volatility"), "median_amount", places=4)


RANK_SQL = FACTOR_SQL + """, s AS (SELECT code, last_value(trade_date) OVER x AS month_last, trade_date, date_trunc('month', trade_date) AS m, CAST(round(momentum, 8) AS DECIMAL(20,8)) AS mom, CAST(round(volatility, 8) AS DECIMAL(20,8)) AS vol
        FROM f WINDOW x AS (PARTITION BY code, date_trunc('month', trade_date) ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, count(*) OVER (PARTITION BY m) AS eligible FROM s WHERE trade_date = month_last AND mom IS NOT NULL AND vol IS NOT NULL),
    p AS (SELECT *, (row_number() OVER (PARTITION BY m ORDER BY mom, code) - 1) / CAST(greatest(1, eligible - 1) AS DOUBLE) AS momentum_percentile, 1 - (row_number() OVER (PARTITION BY m ORDER BY vol, code) - 1) / CAST(greatest(1, eligible - 1) AS DOUBLE) AS low_vol_percentile FROM e),
    c AS (SELECT *, round((momentum_percentile + low_vol_percentile) / 2, 10) AS composite FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY composite DESC, code) AS place FROM c) """


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end rows of each code that have momentum and volatility."""
    m = F.trunc("trade_date", "month")
    after = F.lead(m).over(P.series())  # the order that the factors have, so that the rows aren't sorted anew by month
    s = factors(spark, sf_dir).select("*", m.alias("m"), after.alias("after")).where("after is null or after <> m")
    return s.select("code", "trade_date", "m", F.round("momentum", 8).cast("decimal(20,8)").alias("mom"), F.round("volatility", 8).cast("decimal(20,8)").alias("vol")).where("mom is not null and vol is not null")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible rows, ranked across codes by momentum and low volatility."""
    s = eligible(spark, sf_dir)
    p = s.withColumn("eligible", F.count("*").over(W.partitionBy("m"))).withColumn("momentum_percentile", P.ordinal_percentile(["m"], "mom", "code")).withColumn("low_vol_percentile", 1 - P.ordinal_percentile(["m"], "vol", "code"))
    c = p.withColumn("composite", F.round((F.col("momentum_percentile") + F.col("low_vol_percentile")) / 2, 10))
    return c.withColumn("place", F.row_number().over(W.partitionBy("m").orderBy(F.desc("composite"), "code")))


@query("RK01 RK02 RK03 RK08 CQ03", RANK_SQL + "SELECT code, trade_date, CAST(eligible AS BIGINT) AS eligible, round(momentum_percentile, 8) AS momentum_percentile, round(low_vol_percentile, 8) AS low_vol_percentile, round(composite, 8) AS composite, CAST(place AS BIGINT) AS place, round(0.95 / least(10, eligible), 8) AS weight FROM k WHERE place <= 10")
def factor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranked(spark, sf_dir).where("place <= 10")
    out = top.select("code", "trade_date", F.col("eligible").cast("long").alias("eligible"), "momentum_percentile", "low_vol_percentile", "composite", F.col("place").cast("long").alias("place"), (F.lit(0.95) / F.least(F.lit(10), "eligible")).alias("weight"))
    return _rounded(out, "momentum_percentile", "low_vol_percentile", "composite", "weight")


@query("RK04 RK09", RANK_SQL + """SELECT m AS month, 'equal' AS schedule, code FROM (SELECT CAST(m AS DATE) AS m, code FROM e) UNION ALL
    SELECT CAST(m AS DATE), 'momentum', code FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY mom DESC, code) AS n FROM e) WHERE n <= 5 UNION ALL
    SELECT CAST(m AS DATE), 'low_vol', code FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY vol, code) AS n FROM e) WHERE n <= 5""")
def diagnostic_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three schedules from one pass over the eligible rows."""
    place = lambda order: F.row_number().over(W.partitionBy("m").orderBy(order, "code"))
    e = eligible(spark, sf_dir).select("m", "code", place(F.desc("mom")).alias("by_mom"), place(F.asc("vol")).alias("by_vol"))
    schedules = F.array_compact(F.array(F.lit("equal"), F.when(F.col("by_mom") <= 5, F.lit("momentum")), F.when(F.col("by_vol") <= 5, F.lit("low_vol"))))
    return e.select(F.col("m").alias("month"), F.explode(schedules).alias("schedule"), "code")


@query("WN15 WN17", with_parts("bars") + """, x AS (SELECT *, count(*) OVER a AS n, avg(close) OVER a AS ma, stddev_samp(close) OVER a AS sd, max(high) OVER a AS hi, min(low) OVER a AS lo, lag(close, 20) OVER w AS c20
        FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date), a AS (PARTITION BY code ORDER BY trade_date ROWS 20 PRECEDING))
    SELECT code, trade_date, round(c20 / close, 6) AS "ROC20", round(ma / close, 6) AS "MA20", round(sd / close, 6) AS "STD20", round(hi / close, 6) AS "MAX20", round(lo / close, 6) AS "MIN20", round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END, 6) AS "RSV20" FROM x WHERE n = 21""")
def alpha_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.position_features(20)
    out = P.with_rolling(A.bars(spark, sf_dir), P.position_windows(20)).select("code", "trade_date", *[v.alias(k) for k, v in f.items()]).where("ROC20 is not null")
    return _rounded(out, *f, places=6)


@query("WN16 WN19", with_parts("bars") + """SELECT code, trade_date, round(CASE WHEN n = 21 AND volume > 0 THEN ma / volume END, 6) AS "VMA20", round(CASE WHEN n = 21 AND volume > 0 THEN sd / volume END, 6) AS "VSTD20", round(CASE WHEN k = 5 THEN ma5 END, 4) AS amount_median_5, round(CASE WHEN k = 5 THEN mv5 END, 4) AS volume_median_5 FROM
    (SELECT *, count(*) OVER a AS n, avg(volume) OVER a AS ma, stddev_samp(volume) OVER a AS sd, count(*) OVER b AS k, quantile_cont(amount, 0.5) OVER b AS ma5, quantile_cont(volume, 0.5) OVER b AS mv5 FROM bars WINDOW a AS (PARTITION BY code ORDER BY trade_date ROWS 20 PRECEDING), b AS (PARTITION BY code ORDER BY trade_date ROWS 4 PRECEDING))""")
def alpha_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.volume_features(20) | {"amount_median_5": P.rolling_median("amount", 5), "volume_median_5": P.rolling_median("volume", 5)}
    out = P.with_rolling(A.bars(spark, sf_dir), P.volume_windows(20)).select("code", "trade_date", *[v.alias(k) for k, v in f.items()])
    return _rounded(_rounded(out, "VMA20", "VSTD20", places=6), "amount_median_5", "volume_median_5", places=4)


_K = {"KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / s", "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / s", "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / s", "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / s"}


@query("WN21", with_parts("monthly") + "SELECT code, trade_date, " + ", ".join(f'round({v}, 6) AS "{k}"' for k, v in _K.items()) + " FROM (SELECT *, nullif(high - low, 0) AS s FROM monthly)")
def kbar(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.candle_features()
    return _rounded(A.monthly(spark, sf_dir).select("code", "trade_date", *[v.alias(k) for k, v in f.items()]), *f, places=6)


@query("WN18 WN20", with_parts("bars") + """, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date))
    SELECT code, trade_date, round(close / lag(close, 5) OVER w - 1, 6) AS return_5, round(close / lag(close, 20) OVER w - 1, 6) AS return_20, round(CASE WHEN count(ret) OVER v = 19 THEN stddev_samp(ret) OVER v * sqrt(252) END, 6) AS volatility_20, round(lead(close, 2) OVER w / lead(close, 1) OVER w - 1, 6) AS label
    FROM r WINDOW w AS (PARTITION BY code ORDER BY trade_date), v AS (PARTITION BY code ORDER BY trade_date ROWS 18 PRECEDING)""")
def returns_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.with_rolling(A.bars(spark, sf_dir).withColumn("ret", P.returns()), {"returns": ("moments", "ret", 19)})
    back = lambda n: F.col("close") / P.lagged("close", n) - 1
    out = b.select("code", "trade_date", back(5).alias("return_5"), back(20).alias("return_20"), P.volatility("returns").alias("volatility_20"), P.forward_label().alias("label"))
    return _rounded(out, "return_5", "return_20", "volatility_20", "label", places=6)


HALT_SQL = with_parts("bars") + """, h AS (SELECT code, trade_date, volume < 12 AS halted, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS n FROM bars),
    g AS (SELECT *, max(CASE WHEN halted THEN n END) OVER (PARTITION BY code ORDER BY n) AS last_halt, max(CASE WHEN NOT halted THEN n END) OVER (PARTITION BY code ORDER BY n) AS last_live FROM h),
    q AS (SELECT *, CASE WHEN halted THEN n - coalesce(last_live, 0) ELSE 0 END AS run FROM g) """


@query("WN06 WN07 WN08 WN09", HALT_SQL + """SELECT a.code, a.trade_date, (SELECT count(*) FILTER (b.halted) FROM q b WHERE b.code = a.code AND b.n BETWEEN a.n - 19 AND a.n) AS halts,
    (SELECT max(CASE WHEN b.halted THEN least(b.run, b.n - greatest(1, a.n - 19) + 1) ELSE 0 END) FROM q b WHERE b.code = a.code AND b.n BETWEEN a.n - 19 AND a.n) AS longest_halt,
    (SELECT count(*) FILTER (b.halted) FROM q b WHERE b.code = a.code AND b.n BETWEEN a.n - 5 AND a.n - 1) AS recent_halts, a.n - coalesce(a.last_halt, 0) AS tradable_run FROM q a""")
def halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of little volume counts as halted."""
    b = A.bars(spark, sf_dir).select("code", "trade_date", (F.col("volume") < 12).alias("halted"))
    f = P.halt_features("halted", 20, 5)
    b = b.withColumn("row_no", f.pop("row_no"))
    return b.select("code", "trade_date", *[v.cast("long").alias(k) for k, v in f.items()])


@query("WN10 CQ12", with_parts("bars") + "SELECT code, trade_date, close > ma AS above, CASE WHEN close > ma THEN 1 ELSE 0 END AS target_position FROM (SELECT *, CAST(avg(CAST(close AS DECIMAL(18,4))) OVER a AS DOUBLE) AS ma, count(*) OVER a AS n FROM bars WINDOW a AS (PARTITION BY code ORDER BY trade_date ROWS 49 PRECEDING)) WHERE n = 50")
def sma_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bars(spark, sf_dir).withColumn("ma", P.moving_average("close", 50)).where("ma is not null")
    return b.select("code", "trade_date", (F.col("close") > F.col("ma")).alias("above"), F.when(F.col("close") > F.col("ma"), 1).otherwise(0).alias("target_position"))


FLAG_SQL = with_parts("monthly", "months") + """, d AS (SELECT m.code, m.trade_date, c.cal_idx, m.open, m.high, m.low, m.close FROM monthly m JOIN months c USING (trade_date)),
    sp AS (SELECT code, min(cal_idx) AS a, max(cal_idx) AS b FROM d GROUP BY code),
    grid AS (SELECT sp.code, c.trade_date, c.cal_idx FROM sp JOIN months c ON c.cal_idx BETWEEN sp.a AND sp.b),
    x AS (SELECT g.code, g.trade_date, g.cal_idx, d.open, d.high, d.low, d.close FROM grid g LEFT JOIN d ON d.code = g.code AND d.cal_idx = g.cal_idx),
    fl AS (SELECT *, CASE WHEN count(close) OVER p12 = 12 THEN max(close) OVER p12 END AS high12, CASE WHEN count(close) OVER p6 = 6 THEN max(close) OVER p6 END AS high6, CASE WHEN count(close) OVER a3 = 3 THEN avg(close) OVER a3 END AS ma_now, CASE WHEN count(close) OVER b3 = 3 THEN avg(close) OVER b3 END AS ma_then
        FROM x WINDOW p12 AS (PARTITION BY code ORDER BY cal_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), p6 AS (PARTITION BY code ORDER BY cal_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), a3 AS (PARTITION BY code ORDER BY cal_idx ROWS 2 PRECEDING), b3 AS (PARTITION BY code ORDER BY cal_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    flags AS (SELECT code, trade_date, cal_idx, coalesce(close / high12 - 1 <= -0.2, false) AS l1, coalesce(close > high6 AND ma_now > ma_then, false) AS r1, open, high, low, close FROM fl) """


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars on the month calendar, with the drop (L1) and breakout (R1) flags."""
    m = A.monthly(spark, sf_dir)
    x = P.on_calendar(m, P.calendar(m))
    drop = F.col("close") / P.prior_high("close", 12) - 1 <= -0.2
    rise = (F.col("close") > P.prior_high("close", 6)) & (P.moving_average("close", 3) > P.moving_average("close", 3, -1))
    return x.withColumn("l1", F.coalesce(drop, F.lit(False))).withColumn("r1", F.coalesce(rise, F.lit(False)))


@query("WN11 WN12 CQ05 JN07", FLAG_SQL + "SELECT code, trade_date, l1, r1 FROM flags")
def mechanism_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("code", "trade_date", "l1", "r1")


PATH_SQL = FLAG_SQL + """, hz AS (SELECT unnest([3, 6, 12]) AS h),
    pw AS (SELECT f.code, f.trade_date, f.cal_idx, f.l1, f.r1, hz.h, lead(f.open, 1) OVER (PARTITION BY f.code, hz.h ORDER BY f.cal_idx) AS entry, lead(f.close, hz.h) OVER (PARTITION BY f.code, hz.h ORDER BY f.cal_idx) AS leave FROM flags f, hz),
    pa AS (SELECT p.code, p.trade_date, p.cal_idx, p.l1, p.r1, p.h, p.entry, p.leave, count(*) FILTER (g.code IS NOT NULL) AS there, count(g.close) AS seen, max(g.high) AS hi, min(g.low) AS lo
        FROM pw p LEFT JOIN flags g ON g.code = p.code AND g.cal_idx BETWEEN p.cal_idx + 1 AND p.cal_idx + p.h GROUP BY ALL),
    pt AS (SELECT *, CASE WHEN there < h THEN 'INSUFFICIENT_FUTURE' WHEN entry IS NULL OR entry <= 0 THEN 'ENTRY_UNOBSERVABLE' WHEN seen < h THEN 'PATH_INCOMPLETE' ELSE 'OBSERVED' END AS status FROM pa),
    paths AS (SELECT code, trade_date, cal_idx, l1, r1, h AS horizon, status, CASE WHEN status = 'OBSERVED' THEN leave / entry - 1 END AS forward_return, CASE WHEN status = 'OBSERVED' THEN hi / entry - 1 END AS best, CASE WHEN status = 'OBSERVED' THEN lo / entry - 1 END AS worst FROM pt) """


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    horizons = (3, 6, 12)
    f = flagged(spark, sf_dir).withColumns({f"h{h}": P.forward_path(h) for h in horizons})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("p")) for h in horizons]))
    return f.select("code", "trade_date", "cal_idx", "l1", "r1", each.alias("x")).select("code", "trade_date", "cal_idx", "l1", "r1", "x.horizon", "x.p.*")


@query("WN13 JN08", PATH_SQL + "SELECT code, trade_date, CAST(horizon AS BIGINT) AS horizon, status, round(forward_return, 6) AS forward_return, round(best, 6) AS best, round(worst, 6) AS worst FROM paths")
def forward_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths(spark, sf_dir).select("code", "trade_date", F.col("horizon").cast("long").alias("horizon"), "status", "forward_return", "best", "worst")
    return _rounded(out, "forward_return", "best", "worst", places=6)


COOL_SQL = FLAG_SQL + """, sg AS (SELECT code, 'L1' AS mechanism, cal_idx FROM flags WHERE l1 UNION ALL SELECT code, 'R1', cal_idx FROM flags WHERE r1),
    kept AS (SELECT code, mechanism, min(cal_idx) AS cal_idx FROM sg GROUP BY 1, 2 UNION ALL
        SELECT k.code, k.mechanism, (SELECT min(s.cal_idx) FROM sg s WHERE s.code = k.code AND s.mechanism = k.mechanism AND s.cal_idx > k.cal_idx + 6) FROM kept k WHERE k.cal_idx IS NOT NULL) """


def cooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged(spark, sf_dir)
    each = F.explode(F.array_compact(F.array(F.when(F.col("l1"), F.lit("L1")), F.when(F.col("r1"), F.lit("R1"))))).alias("mechanism")
    return P.thin_by_cooldown(f.select("code", "cal_idx", each), ["code", "mechanism"], "cal_idx", 6)


@query("WN23", COOL_SQL + "SELECT code, mechanism, CAST(cal_idx AS BIGINT) AS cal_idx FROM kept WHERE cal_idx IS NOT NULL")
def cooldown_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooled(spark, sf_dir)


STUDY_SQL = PATH_SQL + COOL_SQL.removeprefix(FLAG_SQL) + """, bench AS (SELECT trade_date, horizon, avg(forward_return) AS bm, count(forward_return) AS bn FROM paths GROUP BY ALL),
    obs AS (SELECT k.code, k.mechanism, p.horizon, year(p.trade_date) AS y, p.status, p.forward_return, p.forward_return - b.bm AS excess FROM kept k JOIN paths p ON p.code = k.code AND p.cal_idx = k.cal_idx JOIN bench b ON b.trade_date = p.trade_date AND b.horizon = p.horizon) """


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals after cooldown with their paths, and what they exceed the mean of all codes of the date by."""
    p = paths(spark, sf_dir).withColumn("excess", F.col("forward_return") - F.avg("forward_return").over(W.partitionBy("trade_date", "horizon")))
    return cooled(spark, sf_dir).join(p, ["code", "cal_idx"]).withColumn("y", F.year("trade_date"))


@query("CQ06 JN09 AG10", STUDY_SQL + "SELECT code, mechanism, CAST(horizon AS BIGINT) AS horizon, CAST(y AS BIGINT) AS y, status, round(excess, 6) AS excess FROM obs")
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("code", "mechanism", F.col("horizon").cast("long").alias("horizon"), F.col("y").cast("long").alias("y"), "status", F.round("excess", 6).alias("excess"))


@query("CQ07 AG03 AG04 AG05 AG08 AG09", STUDY_SQL + """SELECT mechanism, CAST(horizon AS BIGINT) AS horizon, CAST(y AS BIGINT) AS y, count(*) AS signals, count(forward_return) AS observed, round(count(forward_return) / count(*), 6) AS coverage,
    round(avg(forward_return), 6) AS mean_return, round(quantile_cont(forward_return, 0.5), 6) AS median_return, round(quantile_cont(forward_return, 0.2), 6) AS p20, round(quantile_cont(forward_return, 0.8), 6) AS p80, count(*) FILTER (forward_return > 0) AS winners, round(quantile_cont(excess, 0.5), 6) AS median_excess
    FROM obs GROUP BY GROUPING SETS ((mechanism, horizon), (mechanism, horizon, y))""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    m, h, y = F.col("mechanism"), F.col("horizon"), F.col("y")
    return o.groupingSets([[m, h], [m, h, y]], m, h, y).agg(
        F.count("*").alias("signals"), F.count("forward_return").alias("observed"), F.round(F.count("forward_return") / F.count("*"), 6).alias("coverage"),
        F.round(F.avg("forward_return"), 6).alias("mean_return"), q("forward_return", 0.5).alias("median_return"), q("forward_return", 0.2).alias("p20"), q("forward_return", 0.8).alias("p80"),
        F.count_if(F.col("forward_return") > 0).alias("winners"), q("excess", 0.5).alias("median_excess"),
    ).withColumn("horizon", F.col("horizon").cast("long")).withColumn("y", F.col("y").cast("long"))
