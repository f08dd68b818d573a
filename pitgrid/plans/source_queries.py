"""Queries of sources, sinks, snapshots and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.functions import scalars as N
from pitgrid.operators import gates as G
from pitgrid.plans import adapters as A
from pitgrid.plans.registry import query, with_parts
from pitgrid.sources import files as S
from pitgrid.sources.pages import read_pages
from pitgrid.streaming import accounts as R

T = A.table


def _new(spark: SparkSession, name: str) -> str:
    return f"{S.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SC01 SC02 SK01 SK02", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS c_mktsegment FROM customer")
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back; a null comes back as an empty string."""
    path, columns = _new(spark, "text"), ["c_custkey", "c_name", "c_mktsegment"]
    S.write_text_table(T(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))), path, columns)
    return S.read_text_table(spark, path, columns)


@query("SC08 SC09 SC10", "SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(c_nationkey AS VARCHAR) AS kind FROM customer")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of a JSON interface, listed and read by Spark."""
    path = _new(spark, "pages")
    row = F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    page = T(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("page")).agg(F.collect_list(row).alias("rows"))
    answer = F.to_json(F.struct(F.lit("0").alias("error"), F.array(F.lit("code"), F.lit("kind")).alias("fields"), "rows"))
    page.select("page", answer.alias("value")).repartition("page").write.option("maxRecordsPerFile", 1).partitionBy("page").text(path)
    return read_pages(spark, f"{path}/page=*", ["code", "kind"])


_ENTRIES = [(f"{i:06d}", f"{i + 900000:06d}" if i % 3 == 0 else f"{i:06d}", "raw" if i % 5 else "adjusted", "1995-01-01", f"{1996 + i % 4}-12-31") for i in range(10)]


@query("SC05 QG03", with_parts("bars") + f""", e(source_code, code, basis, a, b) AS (VALUES {", ".join(f"('{s}', '{c}', '{x}', DATE '{a}', DATE '{b}')" for s, c, x, a, b in _ENTRIES)})
    SELECT coalesce(e.code, r.code) AS code, r.code AS _source_code, r.trade_date, r.close, CASE WHEN e.code IS NULL THEN 'OUTSIDE_ENTRIES' WHEN e.basis <> 'raw' THEN 'WRONG_BASIS' ELSE '' END AS problem
    FROM bars r LEFT JOIN e ON r.code = e.source_code AND r.trade_date BETWEEN e.a AND e.b""")
def entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.bars(spark, sf_dir).select("code", "trade_date", "close", F.lit("raw").alias("basis"))
    entries = spark.createDataFrame(_ENTRIES, "source_code string, code string, basis string, start string, end string")
    entries = entries.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end"))
    return S.rows_of_entries(raw, entries).drop("basis")


@query("SC06 SK03", with_parts("bars", "members", "cal", "fills") + """SELECT 'bars' AS dataset, count(*) AS n_rows, 'SEALED' AS status FROM bars UNION ALL SELECT 'members', count(*), 'SEALED' FROM members
    UNION ALL SELECT 'calendar', count(*), 'SEALED' FROM cal UNION ALL SELECT 'fills', count(*), 'SEALED' FROM fills""")
def canonical_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each canonical table is written, sealed by the hashes of its files and checked against the seal."""
    tables = {"bars": A.bars, "members": A.members, "calendar": A.days, "fills": A.fills}
    out = None
    for name, make in tables.items():
        path = _new(spark, f"canonical-{name}")
        bad = G.first_reason((F.col("n") > 0, "REJECTED"), otherwise="SEALED")
        rows = S.seal(make(spark, sf_dir), path).agg(F.sum("n_rows").alias("n_rows"))
        problems = S.check_seal(spark, path).agg(F.count("*").alias("n"))
        one = rows.crossJoin(problems).select(F.lit(name).alias("dataset"), "n_rows", bad.alias("status"))  # a row each
        out = one if out is None else out.union(one)
    return out


@query("SC15", """WITH r AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 6 END, '0') AS code,
      CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, o_orderkey % 13 - 1 AS lo, o_orderkey % 11 + 2 AS hi,
      CASE WHEN o_orderkey % 29 = 0 THEN 'yes' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS tradable, CAST(o_orderkey % 31 AS VARCHAR) AS minimum FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY code, d) AS times FROM r)
    SELECT CASE WHEN d = '' THEN 'MISSING_FIELD' WHEN length(code) <> 6 THEN 'BAD_CODE' WHEN length(d) <> 10 THEN 'BAD_DATE' WHEN times > 1 THEN 'DUPLICATE_KEY' WHEN lo <= 0 OR hi < lo THEN 'BAD_LIMITS'
      WHEN tradable = 'yes' THEN 'BAD_TRADABLE' WHEN minimum = '0' THEN 'BAD_QUANTITY' ELSE '' END AS reason, count(*) AS n FROM n GROUP BY 1""")
def rule_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = T(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").substr(F.when(k % 17 == 0, 2).otherwise(1), F.lit(6)).alias("code"),
        F.when(k % 19 == 0, "").when(k % 23 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("trade_date"),
        (k % 13 - 1).cast("string").alias("lower"), (k % 11 + 2).cast("string").alias("upper"), F.when(k % 29 == 0, "yes").otherwise((k % 2).cast("string")).alias("tradable"),
        (k % 31).cast("string").alias("minimum"), F.lit("100").alias("step"))
    return S.rule_rows(raw).groupBy("reason").agg(F.count("*").alias("n"))


@query("SC17 SF25", "SELECT page_id, url FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0 AND length(html) > 0")
def resumable_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were not fetched yet, or that came back with other content than the manifest names."""
    p = T(spark, sf_dir, "pages")
    wanted = p.select("page_id", "url", F.sha2("html", 256).alias("sha"))
    have = p.where("page_id % 3 <> 0").select("page_id", F.sha2(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("sha"))
    return S.still_to_fetch(wanted, have, ["page_id", "sha"]).select("page_id", "url")


@query("SK05 SK06", "SELECT '| ' || n_name || ' | ' || printf('%.2f%%', n_nationkey / 40.0 * 100) || ' | ' || CASE WHEN n_regionkey = 0 THEN '—' ELSE printf('%.4f', CAST(n_regionkey AS DOUBLE)) END || ' |' AS line FROM nation")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published twice: the second time adds nothing."""
    n = T(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") / 40.0).alias("share"), F.nullif("n_regionkey", F.lit(0)).alias("region"))
    lines = S.markdown_rows(n, {"n_name": "text", "share": "percent", "region": "number"}).select("line", S.identity(F.col("n_name"), F.col("share")).alias("identity"))
    registry = _new(spark, "reports")
    S.publish_once(lines, registry)
    return S.publish_once(lines, registry).select("line")


@query("PF01", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS balance, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS missing FROM supplier")
def parsed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns renamed and parsed from text; what can't be parsed is missing."""
    raw = T(spark, sf_dir, "supplier").select(A.code_of("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 4 == 0, "--").otherwise(F.col("s_acctbal").cast("string")).alias("raw balance"))
    parsed = raw.select("code", N.parse_number(F.col("raw balance")).cast("double").alias("balance"))
    return parsed.withColumn("missing", F.col("balance").isNull().cast("int"))


@query("PF03 PF04", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date, CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS in_range, false AS historical_use_allowed FROM lineitem")
def calendar_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date, and whether it lies in a range to which both ends belong."""
    days = T(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    inside = F.col("trade_date").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return G.require_unique(days, "trade_date").withColumn("in_range", inside).withColumn("historical_use_allowed", F.lit(False))


_EXPECTED = {"region": 5, "nation": 25, "part": 7, "supplier": None}


@query("QG04", "SELECT t, n, CASE WHEN n = expected THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, {'NULL' if n is None else n} AS expected FROM {t}" for t, n in _EXPECTED.items()) + ")")
def cardinality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose count isn't configured fails."""
    out = None
    for t, n in _EXPECTED.items():
        one = T(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n", F.when(F.coalesce(F.col("n") == F.lit(n).cast("long"), F.lit(False)), "PASS").otherwise("FAIL").alias("verdict"))
        out = one if out is None else out.union(one)
    return out


@query("AU10", " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, count(*) FILTER ({k} IS NULL) AS null_keys, count({k}) - count(DISTINCT {k}) AS repeats FROM {t}" for t, k in (("customer", "c_custkey"), ("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey"), ("pages", "page_id"))))
def snapshot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, k in (("customer", "c_custkey"), ("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey"), ("pages", "page_id")):
        keys = T(spark, sf_dir, t).groupBy(k).agg(F.count("*").alias("n"))
        one = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col(k).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(F.col(k).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeats"))
        one = one.select(F.lit(t).alias("t"), "n", "null_keys", "repeats")
        out = one if out is None else out.union(one)
    return out


_MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events{})"


@query("SS08 SS07", f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-05 12:00:00' AND date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK.format('')} GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed, from the freeze on."""
    counts = R.daily_counts(R.after_freeze(R.event_stream(spark, sf_dir), "2024-01-05 12:00:00"))
    return R.run_to_table(counts, _new(spark, "daily"))


@query("SS04 SS05", f"""WITH o AS (SELECT user_id, event_id AS order_id, CAST(ts AS DATE) + 1 AS d FROM events WHERE event_type = 'purchase'),
    c AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS t FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT o.user_id, order_id, CAST(o.d AS DATE) AS day, CASE WHEN t IS NULL THEN 'EXPIRED' ELSE 'BOOKED' END AS status, t AS filled_at FROM o LEFT JOIN c ON o.user_id = c.user_id AND o.d = c.d
    WHERE t IS NOT NULL OR CAST(o.d AS TIMESTAMP) + INTERVAL 1 DAY <= {_MARK.format(" WHERE event_type IN ('purchase', 'click')")}""")
def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are booked or expired; those of the last days still wait."""
    out = R.run_to_table(R.order_lifecycle(R.event_stream(spark, sf_dir)), _new(spark, "orders"))
    return out.withColumn("filled_at", F.col("filled_at").cast("timestamp_ntz"))


@query("SS10 SK07", "SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, true AS all_steps_ran FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A close cycle a batch: the journal's rows, then balances by account."""
    folder = _new(spark, "cycle")
    steps = {
        "journal": lambda b: b.where("value is not null"),
        "balances": lambda b: b.where("value is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")),
    }
    codes = R.close_cycle(R.event_stream(spark, sf_dir), folder, steps)
    ran = codes.agg((F.max("code") == 0).alias("all_steps_ran"))
    sums = spark.read.parquet(f"{folder}/balances").groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
    return sums.withColumn("all_steps_ran", ran.scalar())


@query("WN07", with_parts("bars") + """, h AS (SELECT code, trade_date, volume < 12 AS stale, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS n FROM bars),
    r AS (SELECT *, n - coalesce(max(CASE WHEN NOT stale THEN n END) OVER (PARTITION BY code ORDER BY n), 0) AS run FROM h)
    SELECT code, trade_date, CAST(run AS BIGINT) AS run, run >= 3 AS gated FROM r WHERE stale""")
def stale_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the run of stale days up to each; from the third on the code is gated."""
    by_day = W.partitionBy("code").orderBy("trade_date")
    b = A.bars(spark, sf_dir).select("code", "trade_date", (F.col("volume") < 12).alias("stale")).withColumn("n", F.row_number().over(by_day))
    run = F.col("n") - F.coalesce(F.max(F.when(~F.col("stale"), F.col("n"))).over(by_day), F.lit(0))
    return b.withColumn("run", run.cast("long")).where("stale").select("code", "trade_date", "run", (F.col("run") >= 3).alias("gated"))
