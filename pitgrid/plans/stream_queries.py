"""Account rules as streams with keyed state, over the events table and over bars that Spark derives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.plans import adapters as A
from pitgrid.plans import panel_queries as Q
from pitgrid.plans.registry import REGISTRY, query, with_parts
from pitgrid.plans.source_queries import _MARK, _new
from pitgrid.streaming import accounts as R
from pitgrid.streaming import stateful as S

CASH = "1500.00"

_SENT = """sent AS (SELECT account, fill_id * 2 + copy AS arrival, fill_id, CASE WHEN fill_id % 17 = 0 THEN day - 2 ELSE day END AS day, fill_id AS sequence, side, lpad(CAST(fill_id % 3 AS VARCHAR), 6, '0') AS code,
        shares + CASE WHEN copy = 1 AND fill_id % 7 = 0 THEN 1 ELSE 0 END AS shares, price FROM fills, (VALUES (0), (1)) t(copy) WHERE side IS NOT NULL AND (copy = 0 OR fill_id % 3 = 0)),
    f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account ORDER BY arrival) AS n FROM sent)"""


@query("SS01 SS02 LG02 LG01", with_parts("fills") + f""", {_SENT},
    b(account, n, arrival, fill_id, status, cash, booked, last_day, last_seq) AS (
        SELECT DISTINCT account, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, ''::VARCHAR, {CASH}::DECIMAL(18,2), []::STRUCT(id BIGINT, shares BIGINT, code VARCHAR, signed BIGINT, free DATE)[], NULL::DATE, NULL::BIGINT FROM f
        UNION ALL
        SELECT account, n, arrival, fill_id, status, CASE WHEN status = 'BOOKED' THEN after ELSE cash END::DECIMAL(18,2),
            CASE WHEN status = 'BOOKED' THEN list_append(booked, {{'id': fill_id, 'shares': shares, 'code': code, 'signed': CASE WHEN side = 'BUY' THEN shares ELSE -shares END, 'free': CASE WHEN side = 'BUY' THEN CAST(day + 1 AS DATE) END}}) ELSE booked END,
            CASE WHEN status = 'BOOKED' THEN day ELSE last_day END, CASE WHEN status = 'BOOKED' THEN sequence ELSE last_seq END
        FROM (SELECT *, CASE WHEN shares <= 0 OR price <= 0 THEN 'INVALID' WHEN prior IS NOT NULL THEN CASE WHEN prior.shares = shares THEN 'REPEATED' ELSE 'CONFLICT' END
                WHEN day < last_day OR day = last_day AND sequence <= last_seq THEN 'OUT_OF_ORDER' WHEN side = 'SELL' AND sellable < shares THEN 'NO_SHARES' WHEN after < 0 THEN 'NO_CASH' ELSE 'BOOKED' END AS status
            FROM (SELECT f.*, b.cash, b.booked, b.last_day, b.last_seq, list_filter(b.booked, lambda x: x.id = f.fill_id)[1] AS prior,
                CAST(b.cash + CASE WHEN f.side = 'SELL' THEN f.price * f.shares ELSE -f.price * f.shares END - 5 AS DECIMAL(18,2)) AS after,
                coalesce(list_sum(list_transform(list_filter(b.booked, lambda x: x.code = f.code AND (x.signed < 0 OR x.free <= f.day)), lambda x: x.signed)), 0) AS sellable
                FROM b JOIN f ON f.account = b.account AND f.n = b.n + 1)))
    SELECT account, arrival, fill_id, status, CAST(cash AS DOUBLE) AS cash FROM b WHERE n > 0""")
def stream_booking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fill as it comes: some are sent again, some with other contents, some of an earlier day."""
    e = R.event_stream(spark, sf_dir).where("event_type in ('purchase', 'error')")
    i, day, buy = F.col("event_id"), F.to_date("ts"), F.col("event_type") == "purchase"
    copies = F.explode(F.when(i % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    sent = e.withColumn("copy", copies).withColumn("day", F.when(i % 17 == 0, F.date_sub(day, 2)).otherwise(day))
    again = F.when((F.col("copy") == 1) & (i % 7 == 0), 1).otherwise(0)
    fills = sent.select(
        A.code_of("user_id").alias("account"), (i * 2 + F.col("copy")).alias("arrival"), i.alias("fill_id"), "day", i.alias("sequence"), F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.lpad((i % 3).cast("string"), 6, "0").alias("code"), (F.get_json_object("props", "$.k").cast("long") + again).alias("shares"), F.col("value").cast("decimal(18,2)").alias("price"),
        F.lit(5).cast("decimal(18,2)").alias("fees"), F.when(buy, F.date_add("day", 1)).alias("sellable_on"))
    return S.run_with_state(S.book_stream(fills, CASH), _new(spark, "booking")).withColumn("cash", F.col("cash").cast("double"))


@query("SS03 LG05", with_parts("fills") + f""", d AS (SELECT DISTINCT account, day FROM fills WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= {_MARK.format('')}), l AS (SELECT account, max(day) AS last_day FROM d GROUP BY 1),
    s AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS account, event_id, CAST(ts AS DATE) AS supplied, CAST(CAST(ts AS DATE) + CAST(CASE WHEN event_id % 9 = 4 THEN -1 ELSE event_id % 3 END AS INTEGER) AS DATE) AS ex, CAST(event_id % 50 + 2 AS DECIMAL(18,2)) AS gross FROM events WHERE event_type = 'signup'),
    e AS (SELECT *, CAST(ex + CAST(event_id % 4 AS INTEGER) AS DATE) AS pay, event_id % 10 = 7 AS rewritten FROM s),
    j AS (SELECT e.*, supplied <= ex AND EXISTS (SELECT 1 FROM d WHERE d.account = e.account AND d.day = ex) AS seen, EXISTS (SELECT 1 FROM d WHERE d.account = e.account AND d.day = pay) AS paid, last_day FROM e LEFT JOIN l ON l.account = e.account),
    v AS (SELECT *, CASE WHEN rewritten THEN 'REWRITTEN' WHEN NOT seen AND (supplied > ex OR last_day > ex) THEN 'LATE_EX' WHEN NOT seen THEN 'PENDING' WHEN paid THEN 'PAID' WHEN last_day > pay THEN 'LATE_PAY' ELSE 'RECEIVABLE' END AS status FROM j)
    SELECT account, event_id, status, CAST(CASE WHEN status = 'RECEIVABLE' THEN gross ELSE 0 END AS DOUBLE) AS receivable, CAST(CASE WHEN status = 'PAID' THEN gross - 1 ELSE 0 END AS DOUBLE) AS cash, CAST(CASE WHEN status = 'PAID' THEN 1 ELSE 0 END AS DOUBLE) AS withheld FROM v WHERE status <> 'PENDING'""")
def stream_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup supplies an entitlement; any event of an account has it processed on that day. Days that the watermark has
    closed count."""
    e = R.event_stream(spark, sf_dir)
    i, day, account = F.col("event_id"), F.to_date("ts"), A.code_of("user_id").alias("account")
    ex = F.date_add(day, F.when(i % 9 == 4, -1).otherwise(i % 3).cast("int"))
    none = {"event_id": "long", "supplied": "date", "ex_date": "date", "pay_date": "date", "gross": "decimal(18,2)", "payment": "decimal(18,2)"}
    processed = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    gross = lambda more: (i % 50 + 2 + more).cast("decimal(18,2)")
    entitled = lambda more: F.struct(i.alias("event_id"), day.alias("supplied"), ex.alias("ex_date"), F.date_add(ex, (i % 4).cast("int")).alias("pay_date"), gross(more).alias("gross"), gross(more - 1).alias("payment"))
    what = F.when(F.col("event_type") != "signup", F.array(processed)).when(i % 10 == 7, F.array(processed, entitled(0), entitled(1))).otherwise(F.array(processed, entitled(0)))
    rows = e.select(account, F.col("ts").alias("at"), F.explode(what).alias("w")).select("account", "at", "w.*")
    steps = S.run_with_state(S.advance_stream(rows), _new(spark, "dividends"))
    return S.last_steps(steps).select("account", "event_id", "status", *[F.col(c).cast("double").alias(c) for c in ("receivable", "cash", "withheld")])


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read as a file stream."""
    spark = df.sparkSession
    path = _new(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("SS06", REGISTRY["cooldown_signals"].sql)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query's signals, kept apart by a state that holds the last position kept."""
    f = Q.flagged(spark, sf_dir)
    each = F.explode(F.array_compact(F.array(F.when(F.col("l1"), F.lit("L1")), F.when(F.col("r1"), F.lit("R1"))))).alias("mechanism")
    signals = f.select("code", "cal_idx", each).select(F.concat_ws(":", "code", "mechanism").alias("key"), F.col("cal_idx").cast("long").alias("position"))
    out = S.run_with_state(S.cooldown_stream(_as_stream(signals, "signals"), 6), _new(spark, "cooldown"))
    parts = F.split("key", ":")
    return out.where("status = 'KEPT'").select(parts[0].alias("code"), parts[1].alias("mechanism"), F.col("position").alias("cal_idx"))


@query("SS09", REGISTRY["stale_quotes"].sql)
def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query's stale days, counted by a state that holds the run."""
    quotes = A.bars(spark, sf_dir).select("code", "trade_date", (F.col("volume") < 12).alias("stale"))
    out = S.run_with_state(S.stale_stream(_as_stream(quotes, "quotes"), 3), _new(spark, "stale"))
    return out.where("run > 0").select("code", "trade_date", "run", "gated")
