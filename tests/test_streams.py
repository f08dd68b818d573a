"""Streams with keyed state: the same rows in one batch, in many, and after restarts; what comes late is refused."""

import datetime
from decimal import Decimal

import pytest

from pitgrid.operators import ledger
from pitgrid.sources import files
from pitgrid.streaming import stateful as S


def feed(spark, tmp_path, schema, batches, make):
    """Run a stream batch by batch, each time as a new query on the same folder."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], schema).write.parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = S.run_with_state(make(spark.readStream.schema(schema).parquet(source)), folder)
    return out


def fill(arrival, fill_id, day, sequence, side, shares, price="10.00", code="000001", account="a"):
    day = datetime.date.fromisoformat(day)
    return (account, arrival, fill_id, day, sequence, side, code, shares, Decimal(price), Decimal("1.00"), day + S.DAY if side == "BUY" else None)


FILLS = [
    fill(1, 1, "2024-01-02", 1, "BUY", 10), fill(2, 1, "2024-01-02", 1, "BUY", 10), fill(3, 1, "2024-01-02", 1, "BUY", 11),
    fill(4, 2, "2024-01-02", 2, "SELL", 5), fill(5, 3, "2024-01-03", 0, "SELL", 4), fill(6, 4, "2024-01-02", 9, "BUY", 1),
    fill(7, 5, "2024-01-03", 0, "BUY", 1), fill(8, 6, "2024-01-03", 5, "BUY", 1000), fill(9, 6, "2024-01-03", 6, "BUY", 20),
    fill(10, 7, "2024-01-04", 1, "SELL", 7, price="20.00"), fill(11, 7, "2024-01-04", 1, "SELL", 7, price="20.00"), fill(12, 8, "2024-01-05", 1, "SELL", 20),
    fill(13, 9, "2024-01-05", 2, "BUY", 0), fill(14, 10, "2024-01-05", 3, "SELL", 1, code="000002"), fill(1, 1, "2024-01-02", 1, "BUY", 10, account="b"),
]
BOOKED = {1: "BOOKED", 2: "REPEATED", 3: "CONFLICT", 4: "NO_SHARES", 5: "BOOKED", 6: "OUT_OF_ORDER", 7: "OUT_OF_ORDER", 8: "NO_CASH", 9: "BOOKED", 10: "BOOKED", 11: "REPEATED", 12: "NO_SHARES", 13: "INVALID", 14: "NO_SHARES"}


@pytest.mark.parametrize("cuts", [[15], [3, 5, 9, 10, 15]])
def test_booking(spark, tmp_path, cuts):
    batches = [FILLS[a:b] for a, b in zip([0, *cuts], cuts)]
    got = feed(spark, tmp_path, S.FILL, batches, lambda s: S.book_stream(s, "300.00")).collect()
    assert {r.arrival: r.status for r in got if r.account == "a"} == BOOKED and len(got) == 15
    cash = {r.arrival: r.cash for r in got if r.account == "a"}
    # 300 - 101, + 39, - 201, + 139
    assert [str(cash[i]) for i in (1, 5, 9, 10, 14)] == ["199.00", "238.00", "37.00", "176.00", "176.00"]


def at(day, hour=9):
    return datetime.datetime.fromisoformat(f"{day}T{hour:02}:00:00+00:00")


def entitled(event_id, supplied, ex, pay, payment="8.00", account="a"):
    day = datetime.date.fromisoformat
    return (account, at(supplied, 8), event_id, day(supplied), day(ex), day(pay), Decimal("10.00"), Decimal(payment))


def processed(day, account="a"):
    return (account, at(day, 10), None, None, None, None, None, None)


def test_dividends_are_not_made_up_for(spark, tmp_path):
    """A day that is missed is refused by the timer of a later one, across restarts; days that are open wait."""
    batches = [
        [entitled(1, "2024-01-01", "2024-01-02", "2024-01-04"), entitled(2, "2024-01-01", "2024-01-02", "2024-01-03"), entitled(3, "2024-01-03", "2024-01-02", "2024-01-04"), processed("2024-01-02")],
        [entitled(4, "2024-01-03", "2024-01-03", "2024-01-04"), processed("2024-01-04"), processed("2024-01-04")],
        [entitled(5, "2024-01-05", "2024-01-06", "2024-01-06"), entitled(6, "2024-01-05", "2024-01-06", "2024-01-08"), entitled(6, "2024-01-05", "2024-01-06", "2024-01-08", "7.00"), processed("2024-01-06"), entitled(7, "2024-01-05", "2024-01-09", "2024-01-09")],
        [processed("2024-01-20", "b")],
    ]
    steps = feed(spark, tmp_path, S.ENTITLEMENT, batches, lambda s: S.advance_stream(s.withWatermark("at", "1 hour")))
    got = {r.event_id: (r.status, float(r.receivable), float(r.cash), float(r.withheld)) for r in S.last_steps(steps).collect()}
    nothing = (0.0, 0.0, 0.0)
    assert got == {1: ("PAID", 0.0, 8.0, 2.0), 2: ("LATE_PAY", *nothing), 3: ("LATE_EX", *nothing), 4: ("LATE_EX", *nothing), 5: ("PAID", 0.0, 8.0, 2.0), 6: ("REWRITTEN", *nothing)}


def test_cooldown_survives_restarts(spark, tmp_path):
    batches = [[("x", 0), ("x", 5), ("y", 3)], [("x", 6), ("x", 7)], [("x", 7), ("x", 2), ("x", 13), ("x", 14)]]
    got = feed(spark, tmp_path, "key string, position long", batches, lambda s: S.cooldown_stream(s, 6)).collect()
    assert sorted(map(tuple, got)) == sorted([("x", 0, "KEPT"), ("x", 5, "COOLING"), ("y", 3, "KEPT"), ("x", 6, "COOLING"), ("x", 7, "KEPT"), ("x", 7, "REFUSED"), ("x", 2, "REFUSED"), ("x", 13, "COOLING"), ("x", 14, "KEPT")])


def test_stale_runs_survive_restarts(spark, tmp_path):
    day = lambda n: datetime.date(2024, 1, n)
    batches = [[("x", day(2), True), ("x", day(1), True)], [("x", day(3), True)], [("x", day(2), False), ("x", day(4), False), ("x", day(5), True)]]
    got = feed(spark, tmp_path, "code string, trade_date date, stale boolean", batches, lambda s: S.stale_stream(s, 3)).collect()
    assert sorted((r.trade_date.day, r.run, r.gated, r.refused) for r in got if not r.refused) == [(1, 1, False, False), (2, 2, False, False), (3, 3, True, False), (4, 0, False, False), (5, 1, False, False)]
    assert [r.trade_date.day for r in got if r.refused] == [2]


def test_values_that_move_between_null_columns(spark, tmp_path):
    """A hash that skips nulls would take these for the same row."""
    f = spark.createDataFrame([(1, None, "1.00", None), (1, None, None, "1.00")], "fill_id long, side string, price string, shares string")
    assert ledger.book(f, ["side", "price", "shares"]).first().status == "CONFLICT"
    e = spark.sql("SELECT 'a' AS account, 1 AS event_id, date'2024-01-01' AS supplied, x AS ex_date, y AS pay_date, cast(1 AS decimal(18,2)) AS gross, cast(1 AS decimal(18,2)) AS payment FROM VALUES (date'2024-01-02', null), (null, date'2024-01-02') t(x, y)")
    assert ledger.advance(e, spark.sql("SELECT 'a' AS account, date'2024-01-02' AS day")).first().status == "REWRITTEN"
    path = f"{tmp_path}/sealed"
    files.seal(spark.createDataFrame([("x", None)], "a string, b string").coalesce(1), path)
    (name,) = [r.file_name for r in spark.read.parquet(f"{path}/manifest").collect()]
    other = f"{tmp_path}/other"
    spark.createDataFrame([(None, "x")], "a string, b string").coalesce(1).write.parquet(other)
    import glob
    import os
    import shutil

    shutil.copy(glob.glob(f"{other}/part-*")[0], f"{path}/data/{name}")
    os.path.exists(f"{path}/data/.{name}.crc") and os.remove(f"{path}/data/.{name}.crc")
    assert [(r.file_name, r.problem) for r in files.check_seal(spark, path).collect()] == [(name, "CONTENT_DIFFERS")]
