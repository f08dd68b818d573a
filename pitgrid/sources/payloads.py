"""Daily prices from raw payloads: arrays of arrays, script-wrapped objects, parallel arrays, and tables in HTML pages.

A payload is a row (payload_id, raw). The result has a row for each of its days, or, where the payload is refused as a
whole, one row with the reason and nothing else: nothing is read from half a payload.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PRICE = "decimal(18,6)"
_DAY = "struct<day:date,open:decimal(18,6),high:decimal(18,6),low:decimal(18,6),close:decimal(18,6),volume:bigint,reason:string>"


def price(text: Column) -> Column:
    """Six places, halves to even; null if it is no finite number."""
    return F.bround(text.try_cast("decimal(38,18)"), 6).cast(PRICE)


def iso_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text.try_cast("date"))


def _rising(days: Column) -> Column:
    """Whether an array of days holds some, none of them null, each after the one before."""
    later = F.forall(F.sequence(F.lit(1), F.size(days) - 1), lambda i: F.get(days, i) > F.get(days, i - 1))
    return (F.size(days) > 0) & F.forall(days, lambda d: d.isNotNull()) & ((F.size(days) < 2) | F.coalesce(later, F.lit(False)))


def _explode(parsed: DataFrame, refused: Column) -> DataFrame:
    """parsed has payload_id and rows (array of days); rows may lack days, but a problem of any refuses the whole."""
    first = F.get(F.filter(F.transform("rows", lambda r: r.reason), lambda x: x != ""), F.lit(0))
    reason = F.coalesce(refused, first, F.when(~_rising(F.transform("rows", lambda r: r.day)), "DAYS_NOT_RISING"))
    whole = F.when(reason.isNull(), F.col("rows")).otherwise(F.array(F.struct(*[F.lit(None).alias(n) for n in ("day", "open", "high", "low", "close", "volume")], reason.alias("reason")).cast(_DAY)))
    return parsed.select("payload_id", F.posexplode(whole).alias("position", "r")).select("payload_id", "position", "r.*")


def _day(day: Column, o: Column, h: Column, lo: Column, c: Column, volume: Column, reason: Column) -> Column:
    bad = F.when(day.isNull(), "BAD_DAY").when(o.isNull() | h.isNull() | lo.isNull() | c.isNull(), "BAD_PRICE").when(volume.isNull(), "BAD_VOLUME")
    return F.struct(day.alias("day"), o.alias("open"), h.alias("high"), lo.alias("low"), c.alias("close"), volume.alias("volume"), F.coalesce(reason, bad, F.lit("")).alias("reason")).cast(_DAY)


def array_days(payloads: DataFrame, symbol: str, lot: int = 100) -> DataFrame:
    """{"code": 0, "data": {symbol: {"day": [[day, open, close, high, low, lots], ...]}}}: volumes in lots of `lot` shares.

    Refused: NOT_JSON, API_ERROR (another code), EMPTY, SHORT_ROW (under six values), BAD_DAY, BAD_PRICE, LOTS_NOT_WHOLE
    (no whole number of shares), DAYS_NOT_RISING.
    """
    parsed = payloads.select("payload_id", F.from_json("raw", f"code string, data struct<`{symbol}`:struct<day:array<array<string>>>>").alias("j"))
    days = F.col("j.data").getField(symbol).getField("day")
    at = lambda v, i: F.get(v, F.lit(i))

    def row(v: Column) -> Column:
        shares = at(v, 5).try_cast("decimal(38,10)") * lot
        whole = F.when(shares == F.floor(shares), shares.cast("long"))
        problem = F.when(F.size(v) < 6, "SHORT_ROW").when(whole.isNull(), "LOTS_NOT_WHOLE")
        return _day(iso_day(at(v, 0)), price(at(v, 1)), price(at(v, 3)), price(at(v, 4)), price(at(v, 2)), whole, problem)

    refused = F.when(F.col("j").isNull() | F.col("j.code").isNull(), "NOT_JSON").when(F.col("j.code") != "0", "API_ERROR").when(F.coalesce(F.size(days), F.lit(0)) <= 0, "EMPTY")
    return _explode(parsed.select("payload_id", F.coalesce(F.transform(days, row), F.array().cast(f"array<{_DAY}>")).alias("rows"), refused.alias("refused")), F.col("refused"))


def wrapped_days(payloads: DataFrame, variable: str = "_data") -> DataFrame:
    """A script that assigns a call with an array of {"day", "open", "high", "low", "close", "volume"} to a variable.

    Refused: BAD_WRAPPER (text before or after it that isn't the assignment), NOT_JSON, EMPTY, BAD_DAY, BAD_PRICE,
    BAD_VOLUME (not whole), DAYS_NOT_RISING.
    """
    inner = F.regexp_extract("raw", rf"(?s)var\s+{variable}=\((\[.*\])\);\s*$", 1)
    record = "array<struct<day:string,open:string,high:string,low:string,close:string,volume:string>>"
    parsed = payloads.select("payload_id", inner.alias("inner")).select("payload_id", "inner", F.from_json("inner", record).alias("j"))
    row = lambda r: _day(iso_day(r.day), price(r.open), price(r.high), price(r.low), price(r.close), r.volume.try_cast("bigint"), F.lit(None))
    refused = F.when(F.coalesce(F.col("inner"), F.lit("")) == "", "BAD_WRAPPER").when(F.col("j").isNull(), "NOT_JSON").when(F.size("j") == 0, "EMPTY")
    return _explode(parsed.select("payload_id", F.coalesce(F.transform("j", row), F.array().cast(f"array<{_DAY}>")).alias("rows"), refused.alias("refused")), F.col("refused"))


def column_days(payloads: DataFrame, symbol: str) -> DataFrame:
    """{"chart": {"error": null, "result": [{"meta": {"symbol"}, "timestamp": [...], "indicators": {"quote": [{"open": [...],
    ...}]}}]}}: parallel arrays, put together by index; days are those of the seconds since 1970 in UTC.

    A day of which any value is null is a row with reason MISSING, not a refusal. Refused: NOT_JSON, API_ERROR,
    NOT_ONE_RESULT, WRONG_SYMBOL, LENGTHS_DIFFER, EMPTY, BAD_PRICE (a value is no number), DAYS_NOT_RISING.
    """
    fields = ("open", "high", "low", "close", "volume")
    quote = "struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">"
    schema = f"chart struct<error:string,result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<{quote}>>>>>"
    parsed = payloads.select("payload_id", F.from_json("raw", schema).alias("j")).select("payload_id", "j", F.get("j.chart.result", F.lit(0)).alias("r"))
    parsed = parsed.select("*", F.get("r.indicators.quote", F.lit(0)).alias("q"), F.col("r.timestamp").alias("stamp"))
    n = F.size("stamp")
    unequal = F.lit(False)
    for f in fields:
        unequal = unequal | F.coalesce(F.size(F.col(f"q.{f}")) != n, F.lit(True))
    refused = (
        F.when(F.col("j.chart").isNull(), "NOT_JSON").when(F.col("j.chart.error").isNotNull(), "API_ERROR").when(F.coalesce(F.size("j.chart.result"), F.lit(0)) != 1, "NOT_ONE_RESULT")
        .when(~F.col("r.meta.symbol").eqNullSafe(F.lit(symbol)), "WRONG_SYMBOL").when(F.coalesce(F.size("r.indicators.quote"), F.lit(0)) != 1, "LENGTHS_DIFFER").when(unequal, "LENGTHS_DIFFER").when(n == 0, "EMPTY")
    )
    zipped = F.arrays_zip(F.col("stamp").alias("stamp"), *[F.col(f"q.{f}").alias(f) for f in fields])

    def row(v: Column) -> Column:
        lost = v.open.isNull() | v.high.isNull() | v.low.isNull() | v.close.isNull() | v.volume.isNull()
        day = F.to_date(F.timestamp_seconds(v.stamp))
        values = [price(v[f]) for f in fields[:4]]
        number = F.floor(v.volume.try_cast("decimal(38,6)")).cast("long")
        bad = F.when(values[0].isNull() | values[1].isNull() | values[2].isNull() | values[3].isNull() | number.isNull(), "BAD_PRICE").otherwise("")
        keep = lambda x: F.when(~lost, x)
        return F.struct(day.alias("day"), *[keep(x).alias(f) for f, x in zip(fields, [*values, number])], F.when(lost, "MISSING").otherwise(bad).alias("reason")).cast(_DAY)

    rows = F.coalesce(F.transform(zipped, row), F.array().cast(f"array<{_DAY}>"))
    first = F.get(F.filter(F.transform("rows", lambda r: r.reason), lambda x: ~x.isin("", "MISSING")), F.lit(0))
    ready = parsed.select("payload_id", rows.alias("rows"), refused.alias("refused"))
    whole = F.coalesce(F.col("refused"), first, F.when(~_rising(F.transform("rows", lambda r: r.day)), "DAYS_NOT_RISING"))
    empty = F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in ("day", *fields)], F.lit("").alias("reason")))
    out = _explode(ready.select("payload_id", empty.alias("rows"), whole.alias("whole")), F.col("whole"))
    return out.withColumn("reason", F.when((F.col("reason") == "") & F.col("open").isNull(), "MISSING").otherwise(F.col("reason")))


# ---- HTML

def _decoder(encoding: str):
    @F.pandas_udf(StringType())
    def decode(raw: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> str | None:
            try:
                return None if x is None else bytes(x).decode(encoding, errors="strict")
            except UnicodeDecodeError:
                return None

        return raw.map(one)

    return decode


@F.pandas_udf(ArrayType(StringType()))
def unescaped(cells: pd.Series) -> pd.Series:
    """Character references of all names and numbers, as browsers read them."""
    return cells.map(lambda row: None if row is None else [html.unescape(c).strip() if c is not None else None for c in row])


def table_rows(pages: DataFrame, label: str, encoding: str = "gb18030") -> DataFrame:
    """(payload_id, position, cells, reason): the rows of the tables after the first `label` in pages (payload_id, raw
    binary), tags within cells stripped and entities unescaped. A page with other bytes than the encoding's is refused
    (BAD_BYTES), as is one without the label (NO_LABEL)."""
    text = pages.select("payload_id", F.col("raw").isNull().alias("none"), _decoder(encoding)("raw").alias("text"))
    at = F.instr("text", label)
    reason = F.when(F.col("text").isNull(), "BAD_BYTES").when(at == 0, "NO_LABEL").otherwise("")
    after = F.when(at > 0, F.expr(f"substring(text, instr(text, '{label}'))"))
    found = text.select("payload_id", reason.alias("reason"), F.regexp_extract_all(after, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)).alias("trs"))
    each = found.select("payload_id", "reason", F.posexplode_outer("trs").alias("position", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.regexp_replace(c, r"<[^>]+>", ""))
    return each.select("payload_id", "position", unescaped(cells).alias("cells"), "reason")


def dividend_rows(pages: DataFrame, label: str, least: int = 10, encoding: str = "gb18030") -> DataFrame:
    """(payload_id, record_date, payment_date, cash, reason): rows whose first cell is a date y/m/d and whose third is a
    positive number, by full match; other rows are headings or notes and are passed over. A page with fewer than `least`
    is refused (TOO_FEW_ROWS), as is one with a payment date that is none (BAD_DAY)."""
    rows = table_rows(pages, label, encoding)
    cell = lambda i: F.get("cells", F.lit(i))
    number = F.when(cell(2).rlike(r"^\d+(\.\d+)?$"), cell(2).try_cast("decimal(18,6)"))
    day = lambda c: F.when(c.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(c, F.lit("yyyy/M/d")).cast("date"))
    is_row = F.coalesce((F.size("cells") >= 3) & cell(0).rlike(r"^\d{4}/\d{1,2}/\d{1,2}$") & (number > 0), F.lit(False))
    kept = rows.select("payload_id", "reason", F.when(is_row, F.struct(day(cell(0)).alias("record_date"), day(cell(1)).alias("payment_date"), number.alias("cash"))).alias("r"))
    pages_of = kept.groupBy("payload_id").agg(F.max("reason").alias("reason"), F.collect_list("r").alias("rs"))
    bad = F.exists("rs", lambda r: r.record_date.isNull() | r.payment_date.isNull())
    verdict = F.when(F.col("reason") != "", F.col("reason")).when(bad, "BAD_DAY").when(F.size("rs") < least, "TOO_FEW_ROWS").otherwise("")
    verdicts = pages_of.select("payload_id", "rs", verdict.alias("reason"))
    nothing = F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("record_date", "date"), ("payment_date", "date"), ("cash", "decimal(18,6)"))]))
    each = F.explode(F.when(F.col("reason") == "", F.col("rs")).otherwise(nothing)).alias("r")
    return verdicts.select("payload_id", each, "reason").select("payload_id", "r.*", "reason")
