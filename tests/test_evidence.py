"""Payloads are refused whole, seals fail closed, replays name the first step that differs, models equal numpy's."""

import datetime
import html
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgrid.operators import evidence as E
from pitgrid.operators import ridge as R
from pitgrid.plans import adapters as A
from pitgrid.plans import audit_queries as AQ
from pitgrid.sources import payloads as P
from pitgrid.sources import sealing as S

SF = "/root/testdata/sf0.001"


def days(df):
    return [(r.payload_id, str(r.day) if r.day else None, None if r.open is None else str(r.open), r.volume, r.reason) for r in df.orderBy("payload_id", "position").collect()]


def payloads(spark, raws):
    return spark.createDataFrame(list(enumerate(raws)), "payload_id long, raw string")


def test_arrays_of_arrays(spark):
    body = lambda *rows, code=0: json.dumps({"code": code, "data": {"s": {"day": list(rows)}}})
    row = ["2024-01-02", "1.0000005", "2", "3", "0.5", "12.34"]
    raws = [
        body(row, ["2024-01-03", 1, 2, 3, 4, 5, "more"]), body(row, code=1), body(), body(row[:5]), body([*row[:5], "1.005"]), body(["20240102", *row[1:]]), body(row, row),
        body(row, [None, *row[1:]]), "no json", None, body([row[0], "x", *row[2:]]), json.dumps({"code": 0, "data": {"other": {}}}),
    ]
    got = days(P.array_days(payloads(spark, raws), "s"))
    assert got[:2] == [(0, "2024-01-02", "1.000000", 1234, ""), (0, "2024-01-03", "1.000000", 500, "")]
    assert [(i, reason) for i, *_, reason in got[2:]] == [(1, "API_ERROR"), (2, "EMPTY"), (3, "SHORT_ROW"), (4, "LOTS_NOT_WHOLE"), (5, "BAD_DAY"), (6, "DAYS_NOT_RISING"), (7, "BAD_DAY"), (8, "NOT_JSON"), (9, "NOT_JSON"), (10, "BAD_PRICE"), (11, "EMPTY")]


def test_wrapped_objects(spark):
    row = {"day": "2024-01-02", "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "7"}
    wrap = lambda x: f"/* note */ var _data=({x});  "
    raws = [wrap(json.dumps([row])), wrap(json.dumps([row])) + "x", "var other=([]);", wrap("[]"), wrap("[1,"), wrap(json.dumps([row | {"volume": "7.5"}])), wrap(json.dumps([row | {"day": "2024-13-01"}])), None]
    got = days(P.wrapped_days(payloads(spark, raws)))
    assert got[0] == (0, "2024-01-02", "1.000000", 7, "")
    assert [x[-1] for x in got[1:]] == ["BAD_WRAPPER", "BAD_WRAPPER", "EMPTY", "BAD_WRAPPER", "BAD_VOLUME", "BAD_DAY", "BAD_WRAPPER"]


def test_parallel_arrays(spark):
    stamps = [int(datetime.datetime(2024, 1, d, 1, 30, tzinfo=datetime.timezone.utc).timestamp()) for d in (2, 3)]

    def body(symbol="s", error=None, copies=1, **new):
        quote = {"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, 2], "volume": [10, 20]} | new
        result = {"meta": {"symbol": symbol}, "timestamp": stamps, "indicators": {"quote": [quote]}}
        return json.dumps({"chart": {"error": error, "result": [result] * copies}})

    raws = [body(), body(low=[None, 2]), body(close=[1]), body(symbol="t"), body(error="down"), body(copies=2), body(copies=0), body(open=["x", 2]), "{", None]
    got = days(P.column_days(payloads(spark, raws), "s"))
    assert got[:4] == [(0, "2024-01-02", "1.000000", 10, ""), (0, "2024-01-03", "2.000000", 20, ""), (1, "2024-01-02", None, None, "MISSING"), (1, "2024-01-03", "2.000000", 20, "")]
    assert [x[-1] for x in got[4:]] == ["LENGTHS_DIFFER", "WRONG_SYMBOL", "API_ERROR", "NOT_ONE_RESULT", "NOT_ONE_RESULT", "BAD_PRICE", "NOT_JSON", "NOT_JSON"]


def test_tables_in_pages(spark):
    row = lambda a, b, c: f"<tr><td><a href='x'>{a}</a></td><td> {b}\n</td><TD class=n>{c}</TD></tr>"
    page = lambda *rows, label="分红": ("<table>" + row("2001/1/1", "2001/1/2", "9") + f"</table><p>{label}</p><table><tr><th>日</th></tr>" + "".join(rows) + "</table>").encode("gb18030")
    good = page(row("2024/1/2", "2024/1/15", "0&#46;5"), row("2024/02/30x", "2024/2/1", "1"), row("2024/3/4", "2024/3/5", "0"), row("2024/5/6", "2024/5/7", html.escape("1.25")))
    raws = [good, page(row("2024/1/2", "2024/1/3", "1")), page(row("2024/1/2", "later", "1"), row("2024/1/3", "2024/1/4", "1")), page(label="其他"), b"\xff\xff", None]
    df = spark.createDataFrame(list(enumerate(raws)), "payload_id long, raw binary")
    got = sorted((r.payload_id, str(r.record_date), str(r.payment_date), str(r.cash), r.reason) for r in P.dividend_rows(df, "分红", least=2).collect())
    assert got == [
        (0, "2024-01-02", "2024-01-15", "0.500000", ""), (0, "2024-05-06", "2024-05-07", "1.250000", ""),
        (1, "None", "None", "None", "TOO_FEW_ROWS"), (2, "None", "None", "None", "BAD_DAY"), (3, "None", "None", "None", "NO_LABEL"), (4, "None", "None", "None", "BAD_BYTES"), (5, "None", "None", "None", "BAD_BYTES"),
    ]
    cells = P.table_rows(spark.createDataFrame([(1, "分红<tr><td>a &amp; <i>b</i>&nbsp;</td><td>&lt;c&gt;</td></tr>".encode("gb18030"))], "payload_id long, raw binary"), "分红").first().cells
    assert cells == ["a & b", "<c>"]


def test_seals_move_forward_only(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"one")
    (root / "sub" / "b.txt").write_bytes(b"two")
    seal = lambda n: f"{tmp_path}/seal{n}"
    entries = S.open_seal(spark, str(root), seal(1))
    assert sorted((r.path, r.n_bytes) for r in entries.collect()) == [("a.txt", 3), ("sub/b.txt", 3)]
    assert S.seal_status(spark, seal(1))[0] == "PENDING"
    with pytest.raises(ValueError, match="not SEALED"):
        S.require_sealed(spark, str(root), seal(1))
    assert S.close_seal(spark, str(root), seal(1)) == "SEALED"
    with pytest.raises(ValueError, match="already"):
        S.close_seal(spark, str(root), seal(1))
    root_hash = S.require_sealed(spark, str(root), seal(1))
    reviews = spark.createDataFrame([(1, root_hash), (2, "0" * 64), (3, None)], "id long, root_hash string")
    assert {r.id: r.binding for r in S.bound_reviews(reviews, root_hash).collect()} == {1: "BOUND", 2: "OTHER_EVIDENCE", 3: "UNBOUND"}
    S.open_seal(spark, str(root), seal(2))
    (root / "a.txt").write_bytes(b"0ne")
    assert S.close_seal(spark, str(root), seal(2)) == "REJECTED"
    with pytest.raises(ValueError, match="HASH_DIFFERS"):
        S.require_sealed(spark, str(root), seal(1))
    os.remove(root / "sub" / "b.txt")
    (root / "c.txt").write_bytes(b"x")
    assert {r.name: r.problem for r in S.problems(spark, str(root), entries).collect()} == {"a.txt": "HASH_DIFFERS", "sub/b.txt": "MISSING", "c.txt": "NOT_IN_MANIFEST"}


def test_paths_outside_the_root(spark):
    paths = ["a/b", "..a/b", "/a", "../a", "a/../../b", "a/..", "C:\\a", "file:/a", "a\\..\\b", ""]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [p for p, in df.where(~S.escapes(F.col("path"))).collect()] == ["a/b", "..a/b"]


def test_tree_roots(spark):
    """Any change of a name, a size or a hash changes the root; order and partitions don't."""
    rows = [(f"n{i}", i, f"{i:064x}") for i in range(700)]
    root = lambda rows, n=1: S.tree_root(spark.createDataFrame(rows, "name string, n_bytes long, sha256 string").repartition(n))
    first = root(rows)
    assert first == root(rows[::-1], 5)
    assert len({first, root(rows[1:]), root([("x", *rows[0][1:]), *rows[1:]]), root([(rows[0][0], 9, rows[0][2]), *rows[1:]]), root([(*rows[0][:2], "f" * 64), *rows[1:]]), root(rows[:0])}) == 6


def test_matches_use_intervals_up(spark):
    day = lambda n: datetime.date(2024, 1, n)
    events = spark.createDataFrame([(1, 11, day(5)), (1, 12, day(6)), (1, 13, day(20)), (2, 14, day(1))], "g long, event_id long, day date")
    intervals = spark.createDataFrame([(1, 21, day(4), day(5)), (1, 22, day(5), day(9)), (1, 23, day(6), day(6)), (3, 24, day(1), day(2))], "g long, interval_id long, start date, end date")
    got = {(r.event_id, r.interval_id, r.status) for r in E.match_by_consumption(events, intervals, ["g"]).collect()}
    assert got == {(11, None, "SEVERAL"), (12, None, "SEVERAL"), (13, None, "NONE"), (14, None, "NONE"), (None, 21, "UNUSED"), (None, 22, "UNUSED"), (None, 23, "UNUSED"), (None, 24, "UNUSED")}
    fewer = intervals.where("interval_id <> 21")  # 11 takes 22, and what is left for 12 is one
    assert {(r.event_id, r.interval_id) for r in E.match_by_consumption(events, fewer, ["g"]).where("status = 'MATCHED'").collect()} == {(11, 22), (12, 23)}


def test_first_divergence(spark):
    rows = [("a", i, float(i), i) for i in range(5)] + [("b", 0, None, 1)]
    steps = lambda rows: E.state_chain(spark.createDataFrame(rows, "k string, at long, cash double, shares long"), "k", ["at"], ["cash", "shares"])
    find = lambda other: {r.k: (r.steps, r.first_divergence) for r in E.first_divergence(steps(other), steps(rows), "k").collect()}
    assert find(rows) == {"a": (5, None), "b": (1, None)}
    assert find([r if r[1] != 2 else ("a", 2, 2.5, 2) for r in rows])["a"] == (5, 3)
    swapped = [("a", 0, 1.0, 1), ("a", 1, 0.0, 0), *rows[2:5], ("b", 0, 1.0, None)]
    assert find(swapped) == {"a": (5, 1), "b": (1, 1)}
    assert find(rows[:4]) == {"a": (5, 5), "b": (1, 1)}


def test_models_of_every_window_equal_numpy(spark):
    rows = AQ.model_rows(A.bars(spark, SF)).dropna()
    names = AQ.FEATURES
    grams = R.yearly_grams(rows, names, "label", "trade_date")
    models = R.expanding_fits(grams, names, "label", 1995, [1995, 1998, 2000])
    assert set(models) == {1998, 2000}
    pdf = rows.toPandas()
    year = np.array([d.year for d in pdf.trade_date])
    scored = {(r.code, r.trade_date): r.score for r in R.score_by_year(rows, models, "trade_date").collect()}
    assert len(scored) == np.isin(year, [1998, 2000]).sum() > 100
    for y in models:
        x, label = pdf[names].to_numpy(float)[year < y], pdf.label.to_numpy(float)[year < y]
        mean, scale = x.mean(0), x.std(0)
        u = (x - mean) / scale
        w = np.linalg.solve(u.T @ u + 10 * np.eye(len(names)), u.T @ (label - label.mean()))
        later = pdf[year == y]
        want = (later[names].to_numpy(float) - mean) / scale @ w + label.mean()
        assert np.allclose(want, [scored[c, d] for c, d in zip(later.code, later.trade_date)], atol=1e-7)
