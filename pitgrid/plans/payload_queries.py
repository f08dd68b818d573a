"""Queries of raw payloads, tables in HTML and sealed evidence. Payloads are built by Spark from the tables, with faults
planted by code, and read back; what the oracle gives is what was put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S
from pitgrid.plans import adapters as A
from pitgrid.plans.registry import query, with_parts
from pitgrid.plans.source_queries import _new
from pitgrid.sources import payloads as P
from pitgrid.sources import sealing as E

T = A.table
SYMBOL = "sh000001"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of a code in an array by date (84 at most), prices as text: rounded once, to the four places that are
    shown, and written with six."""
    text = lambda c: S.round_binary(F.col(c), 4).cast("decimal(18,6)").cast("string").alias(c)
    m = A.monthly(spark, sf_dir).select("code", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), *[text(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"))
    rows = F.array_sort(F.collect_list(F.struct("day", "open", "high", "low", "close", "volume")))
    return m.groupBy("code").agg(rows.alias("rows")).withColumn("k", F.col("code").cast("long"))


_SIX = "CAST(round(CAST({0} AS DECIMAL(38,18)), 6) AS DOUBLE) AS {0}"
_GOOD = "SELECT code AS payload_id, row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS position, trade_date AS day, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, CAST(volume AS BIGINT) AS volume, '' AS reason FROM monthly"


def _refused_sql(faults: str) -> str:
    return f""", fault AS (SELECT code, CAST(code AS BIGINT) AS k, {faults} AS reason FROM (SELECT DISTINCT code FROM monthly))
    SELECT g.* FROM ({_GOOD}) g JOIN fault ON fault.code = g.payload_id AND fault.reason = ''
    UNION ALL SELECT code, 0, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM fault WHERE reason <> ''"""


def _shown(days: DataFrame) -> DataFrame:
    return days.select("payload_id", F.col("position").cast("long").alias("position"), "day", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("open", "high", "low", "close")], "volume", "reason")


@query("SC11", with_parts("monthly") + _refused_sql("CASE WHEN k % 13 = 5 THEN 'API_ERROR' WHEN k % 11 = 4 THEN 'SHORT_ROW' WHEN k % 7 = 3 THEN 'LOTS_NOT_WHOLE' WHEN k % 17 = 2 THEN 'DAYS_NOT_RISING' WHEN k % 19 = 6 THEN 'EMPTY' WHEN k % 23 = 7 THEN 'NOT_JSON' ELSE '' END"))
def payload_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of arrays, volumes in lots of a hundred."""
    b, k = _bars(spark, sf_dir), F.col("k")
    lots = lambda r: (r.volume / 100).cast("decimal(18,4)").cast("string")
    whole = F.transform("rows", lambda r: F.array(r.day, r.open, r.close, r.high, r.low, lots(r)))
    short = F.transform("rows", lambda r: F.array(r.day, r.open, r.close, r.high, r.low))
    part = F.transform("rows", lambda r: F.array(r.day, r.open, r.close, r.high, r.low, F.concat(lots(r), F.lit("5"))))
    values = F.when(k % 11 == 4, short).when(k % 7 == 3, part).when(k % 17 == 2, F.reverse(whole)).when(k % 19 == 6, F.array().cast("array<array<string>>")).otherwise(whole)
    raw = F.to_json(F.struct(F.when(k % 13 == 5, 7).otherwise(0).alias("code"), F.struct(F.struct(values.alias("day")).alias(SYMBOL)).alias("data")))
    return _shown(P.array_days(b.select(F.col("code").alias("payload_id"), F.when((k % 23 == 7) & ~((k % 13 == 5) | (k % 11 == 4) | (k % 7 == 3) | (k % 17 == 2) | (k % 19 == 6)), F.lit("<html>busy</html>")).otherwise(raw).alias("raw")), SYMBOL))


@query("SC12", with_parts("monthly") + _refused_sql("CASE WHEN k % 13 = 5 THEN 'BAD_WRAPPER' WHEN k % 11 = 4 THEN 'NOT_JSON' WHEN k % 7 = 3 THEN 'BAD_PRICE' WHEN k % 17 = 2 THEN 'DAYS_NOT_RISING' WHEN k % 19 = 6 THEN 'BAD_DAY' ELSE '' END"))
def payload_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script around an array of objects."""
    b, k = _bars(spark, sf_dir), F.col("k")
    each = lambda **new: F.transform("rows", lambda r: F.struct(*[(new[n](r) if n in new else r[n]).cast("string").alias(n) for n in ("day", "open", "high", "low", "close", "volume")]))
    values = F.when(k % 7 == 3, each(high=lambda r: F.lit("--"))).when(k % 17 == 2, F.concat(each(), each())).when(k % 19 == 6, each(day=lambda r: F.regexp_replace(r.day, "-", ""))).otherwise(each())
    inner = F.when(k % 11 == 4, F.lit("[{broken]")).otherwise(F.to_json(values))
    raw = F.concat(F.lit("/*x*/\nvar _data=("), inner, F.when(k % 13 == 5, F.lit(") + 1")).otherwise(F.lit(");\n")))
    return _shown(P.wrapped_days(b.select(F.col("code").alias("payload_id"), raw.alias("raw"))))


@query("SC13", with_parts("monthly") + """, fault AS (SELECT code, CAST(code AS BIGINT) AS k, CASE WHEN k % 13 = 5 THEN 'API_ERROR' WHEN k % 17 = 2 THEN 'NOT_ONE_RESULT' WHEN k % 7 = 3 THEN 'WRONG_SYMBOL' WHEN k % 11 = 4 THEN 'LENGTHS_DIFFER' ELSE '' END AS reason FROM (SELECT DISTINCT code FROM monthly)),
    g AS (""" + _GOOD + """), h AS (SELECT g.*, month(day) = 7 AS lost FROM g JOIN fault ON fault.code = g.payload_id AND fault.reason = '')
    SELECT payload_id, position, day, CASE WHEN NOT lost THEN open END AS open, CASE WHEN NOT lost THEN high END AS high, CASE WHEN NOT lost THEN low END AS low, CASE WHEN NOT lost THEN close END AS close, CASE WHEN NOT lost THEN volume END AS volume, CASE WHEN lost THEN 'MISSING' ELSE '' END AS reason FROM h
    UNION ALL SELECT code, 0, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM fault WHERE reason <> ''""")
def payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays; of every July one value is null, and so the day is missing."""
    b, k = _bars(spark, sf_dir), F.col("k")
    number = lambda n: F.transform("rows", lambda r: r[n].cast("double"))
    holed = F.transform("rows", lambda r: F.when(F.substring(r.day, 6, 2) != "07", r.low.cast("double")))
    stamps = F.transform("rows", lambda r: F.unix_timestamp(F.to_timestamp(r.day)) + 34_200)
    quote = F.struct(number("open").alias("open"), number("high").alias("high"), holed.alias("low"), F.when(k % 11 == 4, F.slice(number("close"), 1, 1)).otherwise(number("close")).alias("close"), F.transform("rows", lambda r: r.volume).alias("volume"))
    meta = F.struct(F.when(k % 7 == 3, "other").otherwise(SYMBOL).alias("symbol"))
    result = F.struct(meta.alias("meta"), stamps.alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    results = F.when(k % 17 == 2, F.array(result, result)).otherwise(F.array(result))
    raw = F.to_json(F.struct(F.struct(F.when(k % 13 == 5, F.lit("down")).alias("error"), results.alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return _shown(P.column_days(b.select(F.col("code").alias("payload_id"), raw.alias("raw")), SYMBOL))


def _gb18030(text: str) -> F.Column:
    """The text's bytes in GB18030, as Latin-1 characters: encoded as Latin-1, they are these bytes again."""
    return F.lit(text.encode("gb18030").decode("latin-1"))


LABEL = "历史 record"


@query("SC14 SF26", """WITH o AS (SELECT o_custkey AS payload_id, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders), r AS (SELECT payload_id, d AS record_date, CAST(d + 20 AS DATE) AS payment_date, CAST(k % 97 / 100.0 AS DOUBLE) AS cash FROM o WHERE k % 97 > 0 AND k % 10 <> 3),
    p AS (SELECT payload_id, count(*) FILTER (k % 97 > 0 AND k % 10 <> 3) AS n FROM o GROUP BY 1), v AS (SELECT payload_id, CASE WHEN payload_id % 13 = 5 THEN 'BAD_BYTES' WHEN payload_id % 11 = 4 THEN 'NO_LABEL' WHEN n < 3 THEN 'TOO_FEW_ROWS' ELSE '' END AS reason FROM p)
    SELECT payload_id, record_date, payment_date, cash, '' AS reason FROM r JOIN v USING (payload_id) WHERE reason = '' UNION ALL SELECT payload_id, NULL, NULL, NULL, reason FROM v WHERE reason <> ''""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a customer, its orders in a table of a Chinese encoding: cells with tags and entities, headings, notes."""
    o, k = T(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = lambda d: F.concat_ws("/", F.year(d), F.month(d), F.dayofmonth(d))
    d = F.to_date("o_orderdate")
    cash = F.when(k % 10 == 3, F.lit("about 1")).otherwise(F.concat(F.lit("0&#46;"), F.lpad((k % 97).cast("string"), 2, "0")))
    line = F.concat(F.lit('<TR class="x">\n<td><b>'), day(d), F.lit("</b></td><td align=right>&nbsp;"), day(F.date_add(d, 20)), F.lit(" </td>\n<td>"), cash, _gb18030("</td><td>分红 &amp; 其他</td></tr>"))
    rows = o.select(F.col("o_custkey").alias("payload_id"), line.alias("line")).groupBy("payload_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    page = F.concat(F.lit("<html><table><tr><td>1999/1/1</td><td>1999/1/2</td><td>9.5</td></tr></table><h2>"), F.when(F.col("payload_id") % 11 == 4, _gb18030("其他")).otherwise(_gb18030(LABEL)), _gb18030("</h2><table><tr><th>日期</th></tr><tr><td>登记日</td><td>到账日</td><td>元</td></tr>"), "lines", F.lit("</table></html>"))
    raw = F.when(F.col("payload_id") % 13 == 5, F.concat(F.col("raw"), F.lit(b"\xff\xff"))).otherwise(F.col("raw"))
    pages = rows.select("payload_id", F.encode(page, "ISO-8859-1").alias("raw")).select("payload_id", raw.alias("raw"))
    return P.dividend_rows(pages, LABEL, least=3).withColumn("cash", F.col("cash").cast("double"))


@query("SK03 SC06 LG14", """WITH f AS (SELECT 'n' || c_nationkey AS name, c_nationkey AS n, string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey || ',' || c_name) AS content FROM customer GROUP BY ALL),
    v AS (SELECT *, CASE WHEN n % 7 = 3 THEN 'SIZE_DIFFERS' WHEN n % 11 = 5 THEN 'MISSING' WHEN n % 5 = 1 THEN 'HASH_DIFFERS' ELSE '' END AS problem FROM f)
    SELECT name, strlen(content) AS n_bytes, sha256(content) AS sha256, problem, 'SEALED' AS status, 'BOUND' AS review FROM v UNION ALL SELECT 'n99', NULL, NULL, 'NOT_IN_MANIFEST', 'SEALED', 'BOUND'""")
def sealed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file a nation, sealed; then what a changed copy of the folder differs in, file by file, and a review that is
    bound to the root of the sealed one."""
    name = F.concat(F.lit("n"), F.regexp_extract("path", "nation=([0-9]+)", 1))
    c = T(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.concat_ws(",", "c_custkey", "c_name").alias("line"))
    files = lambda df, path: df.repartition("nation").sortWithinPartitions("nation", "line").write.partitionBy("nation").text(path)
    root, other, seal = _new(spark, "evidence"), _new(spark, "evidence"), _new(spark, "seal")
    files(c, root)
    n = F.col("nation")
    kept = c.where(~((n % 11 == 5) & (n % 7 != 3)))
    more = c.select("nation").distinct().where(n % 7 == 3).select("nation", F.lit("added").alias("line")).union(spark.range(1).select(F.lit(99).cast("long"), F.lit("new")))
    line = F.when((n % 5 == 1) & (n % 7 != 3), F.translate("line", "C", "K")).otherwise(F.col("line")).alias("line")
    files(kept.select("nation", line).unionByName(more.select(F.col("nation").cast(c.schema["nation"].dataType), "line")), other)
    entries = E.open_seal(spark, root, seal, name)
    status = E.close_seal(spark, root, seal, name)
    root_hash = E.require_sealed(spark, root, seal, name)
    review = E.bound_reviews(spark.range(1).select(F.lit(root_hash).alias("root_hash")), root_hash).select(F.col("binding").alias("review"))
    bad = E.problems(spark, other, entries, name)
    out = entries.drop("path").join(bad, "name", "full").withColumn("problem", F.coalesce("problem", F.lit("")))
    return out.withColumn("status", F.lit(status)).withColumn("review", review.scalar())
