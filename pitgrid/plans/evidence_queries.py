"""Queries that hold evidence against evidence, replay step by step, and retrain year by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S
from pitgrid.operators import evidence as E
from pitgrid.operators import metrics as M
from pitgrid.operators import panel as P
from pitgrid.operators import ridge as R
from pitgrid.plans import adapters as A
from pitgrid.plans import audit_queries as AQ
from pitgrid.plans.registry import query, with_parts

T = A.table


@query("JN14", """WITH RECURSIVE e AS (SELECT o_custkey AS c, o_orderkey % 3 AS amount, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 2 = 1),
    i AS (SELECT o_custkey AS c, o_orderkey % 3 AS amount, o_orderkey AS interval_id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(100 + o_orderkey % 400 AS INTEGER) AS z FROM orders WHERE o_orderkey % 2 = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY c, amount ORDER BY day, event_id) AS k FROM e),
    f(c, amount, k, event_id, used, one) AS (
        SELECT DISTINCT c, amount, 0::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::STRUCT(m BIGINT, s BIGINT) FROM e
        UNION ALL SELECT c, amount, k, event_id, CASE WHEN one.m = 1 THEN list_append(used, one.s) ELSE used END, one FROM (
            SELECT n.c, n.amount, n.k, n.event_id, f.used, (SELECT {'m': count(*), 's': CAST(max(i.interval_id) AS BIGINT)} FROM i WHERE i.c = n.c AND i.amount = n.amount AND n.day BETWEEN i.a AND i.z AND NOT list_contains(f.used, i.interval_id)) AS one
            FROM f JOIN n ON n.c = f.c AND n.amount = f.amount AND n.k = f.k + 1)),
    m AS (SELECT c, amount, event_id, CASE WHEN one.m = 1 THEN one.s END AS interval_id, CASE WHEN one.m = 1 THEN 'MATCHED' WHEN one.m = 0 THEN 'NONE' ELSE 'SEVERAL' END AS status FROM f WHERE k > 0)
    SELECT * FROM m UNION ALL SELECT c, amount, NULL, interval_id, 'UNUSED' FROM i WHERE interval_id NOT IN (SELECT interval_id FROM m WHERE interval_id IS NOT NULL)""")
def consumed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd orders as events, even ones as intervals of the same customer and amount; each interval is used once."""
    o = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 3).alias("amount"), "o_orderkey", F.to_date("o_orderdate").alias("day"))
    k = F.col("o_orderkey")
    events = o.where(k % 2 == 1).select("c", "amount", k.alias("event_id"), "day")
    intervals = o.where(k % 2 == 0).select("c", "amount", k.alias("interval_id"), F.col("day").alias("start"), F.date_add("day", (100 + k % 400).cast("int")).alias("end"))
    return E.match_by_consumption(events, intervals, ["c", "amount"])


@query("JN26", with_parts("monthly") + """, k AS (SELECT code, trade_date, CAST(code AS BIGINT) AS n, month(trade_date) AS m FROM monthly),
    v AS (SELECT code, trade_date, CASE WHEN m = 2 THEN 'MISSING' WHEN n % 5 = 1 AND m = 3 THEN 'SHAPE_DIFFERS' WHEN n % 4 = 2 AND m = 8 THEN 'VOLUME_DIFFERS' ELSE 'AGREES' END AS second, CASE WHEN n % 5 = 1 AND m IN (3, 4) THEN 'SHAPE_DIFFERS' ELSE 'AGREES' END AS third FROM k)
    SELECT *, CASE WHEN second = 'AGREES' AND third = 'AGREES' THEN 'CORROBORATED' WHEN second <> 'AGREES' AND third <> 'AGREES' THEN 'DISPUTED' ELSE 'PARTLY' END AS verdict FROM v""")
def three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two other sources of every monthly bar, on other bases: some bars lack, of some one price or the volume is another."""
    m, n, month = A.monthly(spark, sf_dir), F.col("code").cast("long"), F.month("trade_date")
    moved = lambda by, off: [(F.col(c) + by + (F.when(off, 0.01).otherwise(0.0) if c == "low" else 0.0)).alias(c) for c in ("open", "high", "low", "close")]
    second = m.where(month != 2).select("code", "trade_date", *moved(2.5, (n % 5 == 1) & (month == 3)), (F.col("volume") + F.when((n % 4 == 2) & (month == 8), 101).otherwise(100)).alias("volume"))
    third = m.select("code", "trade_date", *moved(-1.25, (n % 5 == 1) & month.isin(3, 4)), "volume")
    out = E.corroborate(m, {"second": second, "third": third}, ["code", "trade_date"])
    return out.select("code", "trade_date", "second", "third", "verdict")


@query("LG12", """WITH e AS (SELECT user_id * 10 + event_id % 10 AS order_id, event_id, ts AS checked_at, CASE WHEN event_id % 37 = 0 THEN 'x' ELSE 'c' END AS code,
        CASE WHEN event_id % 41 = 0 THEN 'LOST' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'SIMULATED_BOOKED' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'REJECTED' WHEN event_type = 'signup' AND event_id % 6 = 0 THEN 'EXPIRED' WHEN event_type = 'view' THEN 'WAITING_EVIDENCE' ELSE 'WAITING' END AS status,
        CASE WHEN event_id % 29 = 0 THEN 99 ELSE 100 END AS cash FROM events),
    c AS (SELECT *, checked_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00' AS in_time, status = 'SIMULATED_BOOKED' OR cash = 100 AS keeps FROM e),
    t AS (SELECT *, coalesce(bool_or(in_time AND code = 'c' AND keeps AND status IN ('SIMULATED_BOOKED', 'REJECTED', 'EXPIRED')) OVER (PARTITION BY order_id ORDER BY checked_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM c),
    x AS (SELECT *, CASE WHEN NOT in_time THEN 'INVALID_TIME' WHEN code <> 'c' THEN 'IDENTITY_MISMATCH' WHEN ended THEN 'AFTER_TERMINAL' WHEN status = 'LOST' THEN 'UNKNOWN_STATUS' WHEN NOT keeps THEN 'CHANGES_ACCOUNT' ELSE '' END AS error FROM t)
    SELECT order_id, count(*) AS events, count(*) FILTER (error <> '') AS errors, max(status) FILTER (error = '' AND status IN ('SIMULATED_BOOKED', 'REJECTED', 'EXPIRED')) AS terminal, arg_min(error, (checked_at, event_id)) FILTER (error <> '') AS first_error, arg_max(status, (checked_at, event_id)) FILTER (error = '') AS latest,
        CASE WHEN count(*) FILTER (error <> '') > 0 THEN 'REFUSED' WHEN max(status) FILTER (error = '' AND status IN ('SIMULATED_BOOKED', 'REJECTED', 'EXPIRED')) IS NOT NULL THEN 'FINAL' ELSE 'OPEN' END AS report FROM x GROUP BY 1""")
def journal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry of an order's journal: at most one terminal state, and nothing after it."""
    e, i, kind = T(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    status = (
        F.when(i % 41 == 0, "LOST").when((kind == "purchase") & (i % 4 == 0), "SIMULATED_BOOKED").when((kind == "error") & (i % 5 == 0), "REJECTED")
        .when((kind == "signup") & (i % 6 == 0), "EXPIRED").when(kind == "view", "WAITING_EVIDENCE").otherwise("WAITING"))
    events = e.select((F.col("user_id") * 10 + i % 10).alias("order_id"), "event_id", F.col("ts").alias("checked_at"), F.when(i % 37 == 0, "x").otherwise("c").alias("code"), status.alias("status"), F.when(i % 29 == 0, 99).otherwise(100).alias("cash"))
    launches = events.select("order_id").distinct().select("order_id", F.lit("c").alias("code"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("generated_at"), F.lit(100).alias("cash"))
    return E.journal_reports(E.journal_errors(events, launches, "2024-01-28 00:00:00"))


_BOARDS = "['688', '300', '430', '600', '000']"


@query("CQ18 PF15 JN18", with_parts("bars") + f""", b AS (SELECT {_BOARDS}[1 + CAST(code AS BIGINT) % 5] || right(code, 3) AS code, trade_date, CAST(round(lag(close) OVER w, 2) AS DECIMAL(18,4)) AS pre_close, volume, CAST(code AS BIGINT) AS n, close AS raw FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    r AS (SELECT *, CASE WHEN code LIKE '688%' THEN 'star' WHEN code LIKE '300%' THEN 'chinext' WHEN code LIKE '430%' THEN 'bse' ELSE 'main' END AS board, CAST(CASE WHEN code LIKE '688%' OR code LIKE '300%' THEN 0.2 WHEN code LIKE '430%' THEN 0.3 WHEN n % 10 = 3 AND trade_date < DATE '2026-07-06' THEN 0.05 ELSE 0.1 END AS DECIMAL(4,2)) AS ratio, dayofyear(trade_date) AS dn FROM b),
    l AS (SELECT *, CAST(round(pre_close * (1 + ratio), 2) AS DECIMAL(18,2)) AS u, CAST(round(pre_close * (1 - ratio), 2) AS DECIMAL(18,2)) AS d FROM r),
    c AS (SELECT *, CASE WHEN dn % 7 = 0 THEN CAST(u AS DOUBLE) WHEN dn % 7 = 1 THEN CAST(d AS DOUBLE) WHEN dn % 19 = 5 THEN 0.0 ELSE raw END AS close, CASE WHEN dn % 11 = 4 THEN 0.0 ELSE volume END AS vol, dn % 13 <> 6 AS traded FROM l),
    x AS (SELECT *, coalesce(pre_close > 0 AND close > 0, false) AS said, abs(close - CAST(u AS DOUBLE)) <= 0.001 AS up, abs(close - CAST(d AS DOUBLE)) <= 0.001 AS down, NOT traded OR vol <= 0 AS idle, dn % 5 <> 2 AS stated, dn % 17 = 8 AS other FROM c)
    SELECT board, CASE WHEN GROUPING(st) = 0 THEN st END AS status, count(*) AS "rows", count(*) FILTER (said) AS eligible, count(*) FILTER (said AND up) AS limit_up, count(*) FILTER (said AND down) AS limit_down, count(*) FILTER (said AND idle) AS suspended, count(*) FILTER (said AND idle <> (NOT traded)) AS halts_differ,
        count(*) FILTER (said AND stated AND NOT other) AS stated_same, count(*) FILTER (said AND stated AND other) AS stated_other, count(*) FILTER (said AND NOT stated) AS not_stated FROM (SELECT *, CASE WHEN traded THEN 'TRADED' ELSE 'HALTED' END AS st FROM x) GROUP BY GROUPING SETS ((board), (st), ())""")
def rule_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits inferred from the close before against those that a snapshot states: some days lie at a limit, some are halted,
    of some the snapshot says nothing or something else."""
    n, dn = F.col("code").cast("long"), F.dayofyear("trade_date")
    prefix = F.get(F.array(*[F.lit(p) for p in ("688", "300", "430", "600", "000")]), (n % 5).cast("int"))
    b = A.bars(spark, sf_dir).withColumn("pre_close", S.round_binary(P.lagged("close", 1), 2).cast("decimal(18,4)"))
    # own: codes that share their last three digits are one code on a board, but not one row
    b = b.select(F.col("code").alias("own"), F.concat(prefix, F.right("code", F.lit(3))).alias("code"), "trade_date", "pre_close", F.col("close").alias("raw"), "volume", (n % 10 == 3).alias("special"), (dn % 13 != 6).alias("traded"))
    limits = E.rule_flags(b.withColumn("close", F.lit(1.0))).select("own", "code", "trade_date", "upper", "lower", *b.columns[3:])
    close = F.when(dn % 7 == 0, F.col("upper").cast("double")).when(dn % 7 == 1, F.col("lower").cast("double")).when(dn % 19 == 5, 0.0).otherwise(F.col("raw"))
    bars = limits.select("own", "code", "trade_date", "pre_close", close.alias("close"), F.when(dn % 11 == 4, 0.0).otherwise(F.col("volume")).alias("volume"), "special", "traded")
    stated = limits.where(dn % 5 != 2).select("own", "trade_date", (F.col("upper") + F.when(dn % 17 == 8, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.lit("0").cast("decimal(18,2)"))).cast("decimal(18,2)").alias("stated_upper"), F.col("lower").alias("stated_lower"))
    stated = stated.where("stated_upper is not null")
    return E.rule_alignment(E.rule_flags(bars), stated, ("own", "trade_date"))


@query("AU08", with_parts("fills") + """, s AS (SELECT account, count(*) AS steps FROM fills WHERE side IS NOT NULL GROUP BY 1)
    SELECT account, steps, CASE WHEN CAST(account AS BIGINT) % 11 = 4 THEN steps WHEN CAST(account AS BIGINT) % 10 = 3 AND steps >= 5 THEN 5 WHEN CAST(account AS BIGINT) % 15 = 6 AND steps >= 3 THEN 3 END AS first_divergence FROM s""")
def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash and shares after each fill, stored by a fold over an account's fills and replayed by running sums; of some
    accounts one stored step, or all from one on, are others, of some the last is missing."""
    f = A.fills(spark, sf_dir).where("side is not null").withColumn("sign", F.when(F.col("side") == "SELL", 1).otherwise(-1)).withColumn("gross", (F.col("price") * F.col("shares")).cast("decimal(18,2)"))
    moves = f.select("account", "ts", "fill_id", (F.col("sign") * F.col("gross")).cast("decimal(18,2)").alias("cash_move"), (-F.col("sign") * F.col("shares")).alias("share_move"))
    by = W.partitionBy("account").orderBy("ts", "fill_id").rowsBetween(W.unboundedPreceding, 0)
    replay = moves.select("account", "ts", "fill_id", F.sum("cash_move").over(by).cast("decimal(18,2)").alias("cash"), F.sum("share_move").over(by).alias("shares"))
    listed = moves.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("ts", "fill_id", "cash_move", "share_move"))).alias("m"))  # an account's fills
    empty = F.array().cast("array<struct<step:bigint,cash:decimal(18,2),shares:bigint>>")

    def step(a, x):
        last = F.element_at(a, -1)
        cash = F.when(F.size(a) > 0, last["cash"]).otherwise(F.lit(0).cast("decimal(18,2)")) + x["cash_move"]
        shares = F.when(F.size(a) > 0, last["shares"]).otherwise(F.lit(0)) + x["share_move"]
        return F.concat(a, F.array(F.struct((F.size(a) + 1).cast("long").alias("step"), cash.cast("decimal(18,2)").alias("cash"), shares.cast("long").alias("shares"))))

    n = F.col("account").cast("long")
    stored = listed.select("account", F.size("m").alias("steps"), F.explode(F.when(F.size("m") > 0, F.aggregate("m", empty, step))).alias("s")).select("account", "steps", "s.*")
    stored = stored.where(~((n % 11 == 4) & (F.col("step") == F.col("steps"))))
    untouched = n % 11 != 4
    wrong_cash = untouched & (n % 10 == 3) & (F.col("step") == 5)
    wrong_shares = untouched & (n % 15 == 6) & (F.col("step") >= 3)
    stored = stored.select("account", "step", (F.col("cash") + F.when(wrong_cash, 1).otherwise(0)).cast("decimal(18,2)").alias("cash"), (F.col("shares") + F.when(wrong_shares, 1).otherwise(0)).alias("shares"))
    a = E.state_chain(stored.withColumn("at", F.col("step")).drop("step"), "account", ["at"], ["cash", "shares"])
    b = E.state_chain(replay, "account", ["ts", "fill_id"], ["cash", "shares"])
    return E.first_divergence(a, b, "account")


_GRAM = ("KMID", "ROC20")


@query("ML01 ML02 ML05 AG22", AQ.SAMPLE_SQL + f""", w AS (SELECT * FROM smp WHERE {AQ._WHOLE}) SELECT CAST(year(trade_date) AS BIGINT) AS y, count(*) AS n, round(sum("KMID"), 3) AS "s_KMID", round(sum("ROC20"), 3) AS "s_ROC20", round(sum("KMID" * "ROC20"), 3) AS "p_KMID_ROC20", round(sum("ROC20" * label), 3) AS "p_ROC20_label" FROM w GROUP BY 1""")
def yearly_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gram matrices by year of all 22 features; some of their sums are shown."""
    g = R.yearly_grams(AQ.model_rows(A.bars(spark, sf_dir)), AQ.FEATURES, "label", "trade_date")
    return g.select("y", "n", *[F.round(c, 3).alias(c) for c in ("s_KMID", "s_ROC20", "p_KMID_ROC20", "p_ROC20_label")])


@query("ML01 ML02 ML03")
def yearly_retraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For 1997 and each year after: the rows fitted on and scored, and the rank correlation of score and label by date, mean and
    median. A test compares models and scores with numpy."""
    rows = AQ.model_rows(A.bars(spark, sf_dir)).dropna()
    years = list(range(1997, 2002))
    found = R.yearly_grams(rows, AQ.FEATURES, "label", "trade_date")
    grams = spark.createDataFrame(found.collect(), found.schema)  # a row a year: read for the models and for the counts
    models = R.expanding_fits(grams, AQ.FEATURES, "label", 1995, years)
    scored = R.score_by_year(rows, models, "trade_date").select("code", "trade_date", "score", "label")
    ic = M.rank_correlation(scored, "trade_date", "score", "label", "code").groupBy(F.year("trade_date").cast("long").alias("y"))
    by_year = ic.agg(F.count("rank_ic").alias("dates"), F.sum("n").alias("scored"), F.round(F.avg("rank_ic"), 6).alias("mean_ic"), F.round(F.percentile("rank_ic", F.lit(0.5)), 6).alias("median_ic"))
    fitted = grams.select("y", F.col("n").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy(F.lit(0)).orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a year
    return by_year.join(F.broadcast(fitted.withColumn("fitted", before).drop("own")), "y")
