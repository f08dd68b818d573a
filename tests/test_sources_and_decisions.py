"""Sources fail closed, seals notice changes, and plans of openings equal a fold over the list."""

import json
from collections import defaultdict
from decimal import ROUND_DOWN, Decimal

import pytest

from pitgrid.operators.decisions import plan_openings
from pitgrid.plans.decision_queries import opening_inputs
from pitgrid.sources import files
from pitgrid.sources.pages import PageFolder

SF = "/root/testdata/sf0.001"


def folded(signals, account):
    """One account's list, candidate by candidate."""
    held, industries = list(account.held), set(account.industries)
    equity, reserved, plans, out = account.cash + account.market_value, Decimal(0), 0, {}
    for s in sorted(signals, key=lambda s: (-s.roe, -s.cash_ratio, s.code)):
        if s.code in held:
            out[s.code] = ("ALREADY_HELD_ADD_NOT_IMPLEMENTED", None)
        elif s.industry in industries:
            out[s.code] = ("INDUSTRY_LIMIT", None)
        elif len(held) >= 4:
            out[s.code] = ("POSITION_LIMIT", None)
        elif account.monthly_buys + plans >= 2:
            out[s.code] = ("MONTHLY_BUY_LIMIT", None)
        else:
            budget = min(equity * Decimal("0.1"), account.cash - reserved, equity * Decimal("0.8") - account.market_value - reserved)
            budget = max(Decimal(0), budget).quantize(Decimal("0.01"), rounding=ROUND_DOWN)
            if budget <= 0:
                out[s.code] = ("NO_AVAILABLE_BUDGET", None)
                continue
            out[s.code] = ("PLANNED_NOT_EXECUTED", budget)
            reserved, plans = reserved + budget, plans + 1
            industries.add(s.industry)
            held.append(s.code)
    return out


def test_openings_equal_a_fold(spark):
    signals, accounts = opening_inputs(spark, SF)
    by_account = defaultdict(list)
    for s in signals.collect():
        by_account[s.account].append(s)
    want = {(a.account, code): v for a in accounts.collect() for code, v in folded(by_account[a.account], a).items()}
    got = {(r.account, r.code): (r.verdict, r.budget) for r in plan_openings(signals, accounts, "account").collect()}
    assert got == want
    assert {v for v, _ in got.values()} >= {"PLANNED_NOT_EXECUTED", "INDUSTRY_LIMIT", "MONTHLY_BUY_LIMIT", "NO_AVAILABLE_BUDGET"}


def test_seal_notices_changes(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.seal(spark.range(100).repartition(2), path)
    assert files.read_sealed(spark, path).count() == 100
    spark.range(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="NOT_IN_MANIFEST"):
        files.read_sealed(spark, path)
    with pytest.raises(Exception, match="already exists"):
        files.seal(spark.range(1), path)


def test_text_table_refuses_other_headers(spark, tmp_path):
    files.write_text_table(spark.createDataFrame([("é", None), ('a "b"', "c,d")], "a string, b string"), f"{tmp_path}/t", ["b", "a"])
    assert sorted(map(tuple, files.read_text_table(spark, f"{tmp_path}/t", ["b", "a"]).collect())) == [("", "é"), ("c,d", 'a "b"')]
    with pytest.raises(Exception):
        files.read_text_table(spark, f"{tmp_path}/t", ["b", "x"]).collect()


def test_byte_order_mark_is_no_part_of_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,2\n")
    assert files.read_text_table(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect() == [("1", "2")]


@pytest.mark.parametrize("answer", [{"error": "7", "fields": ["a"], "rows": []}, {"error": "0", "fields": ["b"], "rows": []}, {"error": "0", "fields": ["a"], "rows": [["1", "2"]]}])
def test_pages_fail_closed(spark, tmp_path, answer):
    (tmp_path / "1.json").write_text(json.dumps({"error": "0", "fields": ["a"], "rows": [["x"]]}))
    spark.dataSource.register(PageFolder)
    read = spark.read.format("pitgrid_pages").schema("a string").option("path", f"{tmp_path}/*.json")
    assert [tuple(r) for r in read.load().collect()] == [("x",)]
    (tmp_path / "2.json").write_text(json.dumps(answer))
    with pytest.raises(Exception, match="2.json"):
        read.load().collect()


def test_hashes_of_files(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(b"evidence")
    assert [(r.n_bytes, r.sha256[:8]) for r in files.file_hashes(spark, str(tmp_path)).collect()] == [(8, __import__("hashlib").sha256(b"evidence").hexdigest()[:8])]
