"""Records: admissions, logs, replays, gaps, features and layers, the cases that must fail among them."""

import datetime
import json
from decimal import Decimal

import pytest

from pitgrid.operators import records as R
from pitgrid.sources.pages import read_pages

OK = "H1_POSITIVE_PARENT_NETPROFIT_CONFIRMED"
DAY = datetime.date(2024, 1, 2)


def lists(spark, rows):
    return spark.createDataFrame(rows, "report string, code string, watch_status string")


def test_admission_needs_all_evidence(spark):
    watch = "FORWARD_WATCH_ONLY"
    own = lists(spark, [("a", "1", watch), ("a", "2", watch), ("b", "1", watch), ("c", "1", None), ("d", "1", watch), ("d", "1", watch), ("e", "1", watch)])
    validations = spark.createDataFrame([("a", "PASS"), ("c", "PASS"), ("d", "PASS"), ("e", "PASS"), ("e", None), ("z", "PASS")], "report string, status string")
    checks = spark.createDataFrame([(r, "PASS", OK) for r in "abcd"] + [("e", "PASS", OK), ("e", "PASS", "OTHER")], "report string, status string, admission string")
    got = {r.report: (r.n_members, r.reasons, r.status) for r in R.admissions(own, validations, checks).collect()}
    assert got == {
        "a": (2, [], R.ADMITTED), "b": (1, ["VALIDATION_NOT_PASSED"], "REFUSED"), "c": (1, ["NOT_FORWARD_WATCH"], "REFUSED"), "d": (2, ["MEMBER_TWICE"], "REFUSED"),
        "e": (1, ["VALIDATION_NOT_PASSED", "CROSSCHECK_NOT_CONFIRMED"], "REFUSED"),
    }
    none = spark.createDataFrame([], "report string, status string, admission string")
    assert [r.reasons for r in R.admissions(lists(spark, [("a", "1", watch)]), none, none).collect()] == [["VALIDATION_NOT_PASSED", "CROSSCHECK_NOT_CONFIRMED"]]
    assert R.admissions(lists(spark, []), validations, checks).count() == 0


def test_log_is_opened_once(spark, tmp_path):
    own = spark.createDataFrame([("a", "000001", 'N, "1"', "L1", "2024-01-31"), ("b", "000002", "x", "R1", "2024-01-31")], "report string, code string, name string, mechanism string, cutoff string")
    admitted = spark.createDataFrame([("a", R.ADMITTED), ("b", "REFUSED")], "report string, status string")
    signals = R.baseline_signals(own, admitted, "2024-02-01T00:00:00")
    assert [(r.signal_id, r.name, r.actionable) for r in signals.collect()] == [("BASELINE:L1:000001:2024-01-31", 'N, "1"', "false")]
    manifest = {r.name: (r.columns.count(",") + 1, r.n_rows) for r in R.open_log(signals, f"{tmp_path}/log", "2024-02-01").collect()}
    assert manifest == {"signals": (11, 1), "orders": (9, 0), "trades": (11, 0), "rejections": (7, 0), "positions": (7, 0), "daily_reconciliation": (9, 1)}
    with pytest.raises(Exception, match="(?i)exists"):
        R.open_log(signals, f"{tmp_path}/log", "2024-02-01")


def fold(fills):
    """Cash and open lots of one account, fill by fill."""
    cash, lots = Decimal(0), []
    for _, fid, _, day, side, price, shares, fees in sorted(fills, key=lambda f: (f[2], f[1])):
        cash += (1 if side == "SELL" else -1) * price * shares - fees
        if side == "BUY":
            lots.append([fid, shares, day + datetime.timedelta(1)])
        while side == "SELL" and shares:
            take = min(shares, lots[0][1])
            lots[0][1] -= take
            shares -= take
            lots = [x for x in lots if x[1]]
    return cash, lots


def test_replay_against_a_fold(spark):
    money, fills, runs, lots = Decimal("1.25"), [], [], []
    for a in range(12):
        own = [(f"{a}", i, i, DAY + datetime.timedelta(i // 3), "SELL" if i % 4 == 3 else "BUY", money * (i + 1), 100 * (1 + (i * 7 + a) % 5), Decimal("5.00")) for i in range(9)]
        cash, left = fold(own)
        fills += own
        runs.append((f"{a}", Decimal(1000), Decimal(1000) + cash + (a == 1)))
        lots += [(f"{a}", fid, n + (a == 2 and k == 0), day + datetime.timedelta(a == 3 and k == 0)) for k, (fid, n, day) in enumerate(left) if (a, k) != (4, 0)] + [(f"{a}", 99, 1, DAY)] * (a == 5) + [(f"{a}", *left[0])] * (a == 6)
    fills.append(("7", 100, 100, DAY, "SELL", money, 100_000, Decimal(0)))  # more than was ever bought
    runs.append(("idle", Decimal(10), Decimal(10)))
    runs.append(("idle-wrong", Decimal(10), None))
    lots.append(("idle-wrong", 1, 5, DAY))
    got = R.replay_journals(
        spark.createDataFrame(runs, "account string, initial_cash decimal(18,2), cash decimal(18,2)"),
        spark.createDataFrame(fills, "account string, fill_id long, ts long, day date, side string, price decimal(18,2), shares long, fees decimal(18,2)"),
        spark.createDataFrame(lots, "account string, lot_id long, shares long, sellable_on date"),
    )
    got = {r.account: (r.status, r.differences) for r in got.collect()}
    assert got.pop("7")[0] == "NOT_REPLAYABLE"
    faults = {"1": "CASH_DIFFERS", "2": "LOT_SHARES_DIFFER", "3": "SELLABLE_DAY_DIFFERS", "4": "LOT_MISSING", "5": "LOT_UNKNOWN", "6": "LOT_TWICE"}
    assert {a: d for a, (_, d) in got.items() if d} == {**{a: [f] for a, f in faults.items()}, "idle-wrong": ["CASH_DIFFERS", "LOT_UNKNOWN"]}
    assert all((s == "REPLAY_MATCH") == (not d) for s, d in got.values()) and len(got) == 13


def test_gaps_name_every_lack(spark):
    orders = spark.createDataFrame([(1, 2023, "BUY", 10.0), (2, 2023, "SELL", 20.0), (3, 2024, "BUY", 30.0), (4, 2025, "BUY", 5.0)], "order_id long, year int, side string, requested double")
    translated = spark.createDataFrame([(1, 100, 1.5, "CANDIDATE_NOT_FILL"), (3, None, None, "MISSING_UNADJUSTED_PRICE"), (4, 100, 2.0, "CANDIDATE_NOT_FILL")], "order_id long, shares long, open double, reason string")
    flags = "has_fill boolean, has_lot boolean, has_rule boolean, has_action boolean, has_fee boolean"
    evidence = spark.createDataFrame([(1, True, True, True, True, True), (3, True, True, None, True, True), (4, True, True, True, True, True)], f"order_id long, {flags}")
    got = {r.year: r for r in R.account_gaps(orders, translated, evidence, "year").collect()}
    assert (got[2023].untranslated, got[2023].candidates, got[2023].candidate_shares, len(got[2023].blockers)) == (1, 1, 100, 5)
    assert got[2024].blockers == ["NO_VERIFIED_PRICE_LIMIT_RULE"] and got[2024].candidate_shares == 0
    assert (got[2025].status, got[2023].status) == ("READY_FOR_REPLAY", "NOT_READY_REAL_SHARE_ACCOUNT")


def test_registry_refuses_samples_that_lack_a_feature(spark):
    names = [f[0] for f in R.FEATURES]
    assert len(set(names)) == 22
    df = spark.createDataFrame([tuple(float(i) for i in range(22)), (None, *[1.0] * 21)], ", ".join(f"{n} double" for n in names))
    rows = R.feature_registry(df).collect()
    assert [r.name for r in rows] == names and [(r.n_rows, r.n_missing) for r in rows] == [(2, 1)] + [(2, 0)] * 21
    assert R.feature_registry(df.limit(0)).first().n_rows == 0
    with pytest.raises(ValueError, match="RSV20"):
        R.feature_registry(df.drop("RSV20"))


def test_one_failure_refuses_the_layer(spark):
    codes = spark.createDataFrame([("1",), ("2",)], "code string")
    days = spark.createDataFrame([("1", "2024-01-01"), ("2", "2024-01-03"), ("9", "2024-01-02")], "code string, d string")
    summary = lambda **more: {r.dataset: r for r in R.layer_summary({"days": (days, "code", "d"), "codes": (codes, "code", None), **more}, codes, ("days", "thin"), {"codes": 2}).collect()}
    good = summary()
    assert (good["days"].n_rows, good["days"].n_codes, good["days"]["first"], good["days"].last, good["days"].lacking) == (3, 3, "2024-01-01", "2024-01-03", 0)
    assert {r.status for r in good.values()} == {"PASS_WITH_KNOWN_LIMITS"}
    bad = summary(thin=(days.where("code = '2'"), "code", "d"), none=(days.limit(0), None, "d"))
    assert (bad["thin"].failures, bad["none"].failures) == (["UNIVERSE_NOT_COVERED"], ["EMPTY"]) and {r.status for r in bad.values()} == {"REFUSED"}


@pytest.mark.parametrize("page, why", [("{", "no page"), ('{"error": "0"}', "no page"), ('{"error": "7", "fields": ["a"], "rows": []}', "error 7"), ('{"error": "0", "fields": ["b"], "rows": []}', "other fields"), ('{"error": "0", "fields": ["a"], "rows": [["1", "2"]]}', "another length")])
def test_pages_read_by_spark_fail_closed(spark, tmp_path, page, why):
    (tmp_path / "1.json").write_text(json.dumps({"error": "0", "fields": ["a"], "rows": [["x\ny"], [None]]}))
    assert [tuple(r) for r in read_pages(spark, str(tmp_path), ["a"]).collect()] == [("x\ny",), (None,)]
    (tmp_path / "2.json").write_text(page)
    with pytest.raises(Exception, match=f"2.json: .*{why}"):
        read_pages(spark, str(tmp_path), ["a"]).collect()
