"""Queries by name, each with the inventory entries that it covers and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    covers: str
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTRY[f.__name__] = Entry(f, covers, sql)
        return f

    return register


def with_parts(*parts: str) -> str:
    """WITH clause of named oracle parts."""
    return "WITH RECURSIVE " + ", ".join(f"{p} AS ({PARTS[p]})" for p in parts) + " "


_PRICE = "l_extendedprice / l_quantity"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
PARTS = {
    "bars": f"""SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date,
        first({_PRICE} ORDER BY {_ORDER}) AS open, max({_PRICE}) AS high, min({_PRICE}) AS low, last({_PRICE} ORDER BY {_ORDER}) AS close,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM lineitem GROUP BY ALL""",
    "monthly": f"""SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
        first({_PRICE} ORDER BY l_shipdate, {_ORDER}) AS open, max({_PRICE}) AS high, min({_PRICE}) AS low, last({_PRICE} ORDER BY l_shipdate, {_ORDER}) AS close,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM lineitem GROUP BY ALL""",
    "cal": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS cal_idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem)",
    "months": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS cal_idx FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date FROM lineitem)",
    "members": "SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS observed_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code FROM lineitem",
    "month_ends": "SELECT max(CAST(l_shipdate AS DATE)) AS signal_date FROM lineitem GROUP BY date_trunc('month', l_shipdate)",
    "fills": "SELECT event_id AS fill_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS account, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' END AS side, CAST(value AS DECIMAL(18,2)) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS shares FROM events",
}
