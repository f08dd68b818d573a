"""Every registered query against its oracle, on the smallest tables; the others for a stable schema."""

import pytest

from pitgrid.plans import queries as panel
from pitgrid.plans.registry import REGISTRY

from .oracle import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(panel.oracle_sql()))
def test_same_as_oracle(spark, con, name):
    assert differences(spark, name, REGISTRY[name].run, REGISTRY[name].sql, SF, con) == ""


@pytest.mark.parametrize("name", sorted(panel.queries().keys() - panel.oracle_sql().keys()))
def test_runs_twice_alike(spark, name):
    """Queries that SQL cannot express: same schema and same rows each time."""
    a, b = (REGISTRY[name].run(spark, SF) for _ in range(2))
    assert a.schema == b.schema
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_affordable_shares_of_every_fill(spark):
    """Against trying every number of lots, in cents: no row with a price is left out."""
    from decimal import ROUND_HALF_UP, Decimal

    from pitgrid.plans import adapters

    fills = [r for r in adapters.fills(spark, SF).select("fill_id", "price").collect() if r.price is not None and r.price > 0]

    def plain(r):
        cash, n = Decimal(20000 + r.fill_id % 977 * 13), 0
        while True:
            gross = r.price * (n + 1) * 100
            if gross + max(Decimal(5), (gross * Decimal("0.0003")).quantize(Decimal("0.01"), ROUND_HALF_UP)) > cash:
                return n * 100
            n += 1

    want = {r.fill_id: plain(r) for r in fills}
    got = {r.fill_id: r.shares for r in REGISTRY["affordable_shares"].run(spark, SF).collect()}
    assert got == want and len(want) > 500


def test_ridge_scores_against_numpy(spark):
    """The same features from pandas, the same system from numpy; places follow the scores."""
    import numpy as np

    from pitgrid.plans import adapters

    b = adapters.bars(spark, SF).select("code", "trade_date", "close", "volume").toPandas().sort_values(["code", "trade_date"])
    close = b.groupby("code").close
    b["x"], b["z"], b["y"] = b.close / close.shift(5) - 1, b.volume / 100, close.shift(-2) / close.shift(-1) - 1
    b = b.dropna()
    early = b.trade_date.astype(str) < "1999-01-01"
    train, later = b[early], b[~early]
    x, y = train[["x", "z"]].to_numpy(), train.y.to_numpy()
    mean, scale = x.mean(0), x.std(0)
    u = (x - mean) / scale
    w = np.linalg.solve(u.T @ u + 10 * np.eye(2), u.T @ (y - y.mean()))
    want = dict(zip(zip(later.code, later.trade_date), (later[["x", "z"]].to_numpy() - mean) / scale @ w + y.mean()))
    got = REGISTRY["ridge_scores"].run(spark, SF).collect()
    assert len(got) == len(want) > 100
    assert all(abs(r.score - want[r.code, r.trade_date]) <= 2e-6 for r in got)
    for day in {r.trade_date for r in got}:
        ordered = sorted((r for r in got if r.trade_date == day), key=lambda r: r.place)
        assert [r.place for r in ordered] == list(range(1, len(ordered) + 1))
        assert all(a.score >= b.score for a, b in zip(ordered, ordered[1:]))


def test_watchlist_equals_a_fold(spark):
    """Candidate by candidate: one a nation, two a segment, five a region."""
    import pandas as pd

    n = pd.read_parquet(f"{SF}/nation.parquet")
    c = pd.read_parquet(f"{SF}/customer.parquet").merge(n, left_on="c_nationkey", right_on="n_nationkey")
    want = {}
    for region, rows in c.groupby("n_regionkey"):
        taken, nations, segments = [], set(), []
        for r in rows.sort_values(["c_acctbal", "c_custkey"], ascending=[False, True]).itertuples():
            if len(taken) < 5 and r.c_nationkey not in nations and segments.count(r.c_mktsegment) < 2:
                taken.append(r.c_custkey)
                nations.add(r.c_nationkey)
                segments.append(r.c_mktsegment)
        want |= {(region, i + 1): k for i, k in enumerate(taken)}
    assert {(r.region, r.place): r.c_custkey for r in REGISTRY["watchlist_greedy"].run(spark, SF).collect()} == want


def test_rolling_windows_against_plain_ones(spark):
    import numpy as np

    from pitgrid.operators.metrics import rolling_windows

    rng = np.random.default_rng(3)
    values = {k: rng.uniform(1, 9, n).tolist() for k, n in (("a", 50), ("b", 31), ("c", 30), ("d", 5), ("e", 1))}
    df = spark.createDataFrame([(k, i, x) for k, v in values.items() for i, x in enumerate(v)], "code string, trade_date int, close double")
    want = {}
    for k, v in values.items():
        for i in range(30, len(v), 10):
            path = np.array(v[i - 30 : i + 1])
            want[k, i] = (v[i] / v[i - 30] - 1, float((path / np.maximum.accumulate(path) - 1).min()))
    got = {(r.code, r.trade_date): (r.window_return, r.worst_drawdown) for r in rolling_windows(df, 30, 10).collect()}
    assert got == want and len(got) == 3
    with pytest.raises(ValueError, match="whole blocks"):
        rolling_windows(df, 31, 10)


def test_advance_refuses_what_was_missed(spark):
    from pitgrid.operators.ledger import advance

    e = spark.sql("""SELECT account, event_id, date(supplied) AS supplied, date(ex) AS ex_date, date(pay) AS pay_date, cast(10 AS decimal(18,2)) AS gross, cast(payment AS decimal(18,2)) AS payment FROM VALUES
        ('a', 1, '2024-01-01', '2024-01-02', '2024-01-04', 8), ('a', 1, '2024-01-02', '2024-01-02', '2024-01-04', 8), ('a', 2, '2024-01-01', '2024-01-02', '2024-01-03', 8), ('a', 3, '2024-01-03', '2024-01-02', '2024-01-04', 8), ('a', 4, '2024-01-01', '2024-01-03', '2024-01-04', 8),
        ('a', 5, '2024-01-01', '2024-01-02', '2024-01-04', 8), ('a', 5, '2024-01-01', '2024-01-02', '2024-01-04', 7), ('a', 6, '2024-01-01', '2024-01-04', '2024-01-09', 8), ('a', 7, '2024-01-01', '2024-01-07', '2024-01-09', 8), ('b', 8, '2024-01-01', '2024-01-02', '2024-01-04', 8) AS t(account, event_id, supplied, ex, pay, payment)""")
    d = spark.sql("SELECT 'a' AS account, date(day) AS day FROM VALUES ('2024-01-02'), ('2024-01-04'), ('2024-01-04') AS t(day)")
    got = {r.event_id: (r.status, float(r.receivable), float(r.cash), float(r.withheld)) for r in advance(e, d).collect()}
    nothing = (0.0, 0.0, 0.0)
    assert got == {1: ("PAID", 0.0, 8.0, 2.0), 2: ("LATE_PAY", *nothing), 3: ("LATE_EX", *nothing), 4: ("LATE_EX", *nothing), 5: ("REWRITTEN", *nothing), 6: ("RECEIVABLE", 10.0, 0.0, 0.0), 7: ("PENDING", *nothing), 8: ("PENDING", *nothing)}
