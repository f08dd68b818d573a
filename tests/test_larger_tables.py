"""Faults that show only on larger tables: codes of more than three digits, prices on the edge of rounding."""

import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitgrid.functions import scalars
from pitgrid.plans import queries  # noqa: F401  fills the registry
from pitgrid.plans.registry import REGISTRY

from .oracle import differences, duck

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def tables(spark, path, lines):
    """A folder whose lineitem has (supplier, day, quantity, price) and nothing else."""
    import os

    os.makedirs(path)
    rows = [(i, 1, s, 1, float(q), float(p), 0.0, 0.0, "N", "O", datetime.datetime.fromisoformat(d)) for i, (s, d, q, p) in enumerate(lines)]
    spark.createDataFrame(rows, LINE).toPandas().to_parquet(f"{path}/lineitem.parquet", coerce_timestamps="us")
    import shutil

    for t in "region nation customer supplier part orders events documents embeddings pages benchmark labels conversations".split():
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", path)
    return path


def same(spark, name, path):
    return differences(spark, name, REGISTRY[name].run, REGISTRY[name].sql, path, duck(path))


def test_codes_that_end_alike_are_rows_of_their_own(spark, tmp_path):
    days = [f"1997-01-{d:02}" for d in range(1, 15)]
    path = tables(spark, f"{tmp_path}/sf", [(s, d, 2, 20 + s % 7 + i) for s in (1, 1001, 2001, 7) for i, d in enumerate(days)])
    assert same(spark, "rule_alignment", path) == ""


def edge(price, quantity):
    """A price a piece whose product with 10**4 falls short of the half that its text shows."""
    x = price / quantity
    return repr(x).endswith("5") and len(repr(x).split(".")[1]) == 5 and x * 1e4 - math.floor(x * 1e4) < 0.5


@pytest.mark.parametrize("name", ["payload_arrays", "payload_wrapped", "payload_columns"])
def test_prices_are_rounded_once(spark, tmp_path, name):
    prices = [k / 100 for k in range(4001, 60000) if edge(k / 100, 40)][:12]
    assert len(prices) == 12
    path = tables(spark, f"{tmp_path}/sf", [(1, f"1997-{m + 1:02}-05", 40, p) for m, p in enumerate(prices)])
    assert same(spark, name, path) == ""


def test_binary_rounding(spark):
    x = [1.005, -1.005, 2.5, 0.0, 1234.565, 0.125]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(scalars.round_binary(F.col("x"), 2).alias("y")).collect()]
    away = lambda v: math.copysign(math.floor(abs(v) * 100) + (abs(v) * 100 - math.floor(abs(v) * 100) >= 0.5), v) / 100
    assert got == [away(v) for v in x]


SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sizes_are_worked_out_once(spark):
    """The size's expression is not written out anew wherever its result is read."""
    assert len(REGISTRY["opening_sizes"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toJSON()) < 2_000_000


def test_retraining_passes_over_the_samples_twice(spark):
    """Once for the models, which are made before, and once for the scores."""
    assert plan(REGISTRY["yearly_retraining"].run(spark, SF)).count("FileScan parquet") == 1


def test_schedules_come_from_one_pass(spark):
    assert plan(REGISTRY["diagnostic_schedules"].run(spark, SF)).count("FileScan parquet") == 1


def test_keys_of_one_side(spark):
    """As two anti-joins of the distinct keys, nulls included, but by one grouping."""
    from pitgrid.operators import gates

    a, b = (spark.createDataFrame([(x,) for x in xs], "k long") for xs in ([1, 2, 2, None], [2, 3, 3, None]))
    want = sorted(map(repr, gates.both_ways(a.distinct(), b.distinct(), ["k"]).collect()))
    assert sorted(map(repr, gates.keys_of_one_side(a, b, "k").collect())) == want and len(want) == 4
    text = plan(REGISTRY["orders_without_lines"].run(spark, SF))
    assert "Join" not in text and "Sort" not in text


def test_rolling_windows_from_blocks(spark):
    """The same values as from frames of all rows, and no frame of more than a median's rows."""
    from pitgrid.operators import panel

    x = [3.5, 1e6 + 0.25, 2.0, 2.0, 2.0, 2.0, None, *[float(i * i % 17) for i in range(60)], *[7.1] * 30]
    df = spark.createDataFrame([(c, i, None if v is None else v + k) for k, c in enumerate("ab") for i, v in enumerate(x)], "code string, trade_date int, x double")
    sizes = (1, 2, 5, 19, 21)
    got = panel.with_rolling(df, {f"{kind}{n}": (kind, "x", n) for n in sizes for kind in ("moments", "max", "min")} | {"moments63": ("moments", "x", 63)})
    got = got.withColumn("median6", panel.rolling_median("x", 6))
    frame = lambda f, n: panel.whole(f("x").over(panel.rows(1 - n, 0)), F.col("x"), 1 - n, 0)
    for n in (*sizes, 63):
        got = got.withColumns({f"mean_{n}": frame(F.avg, n), f"deviation_{n}": frame(F.stddev_samp, n), f"max_{n}": frame(F.max, n), f"min_{n}": frame(F.min, n)})
    got = got.withColumn("median_6", panel.whole(F.percentile("x", F.lit(0.5)).over(panel.rows(-5, 0)), F.col("x"), -5, 0))
    near = lambda a, b: a == b or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))
    rows = got.collect()
    assert len(rows) == 2 * len(x)
    for r in rows:
        for n in (*sizes, 63):
            m = r[f"moments{n}"]
            assert near(m and m.mean, r[f"mean_{n}"])
            if n > 1:
                assert near(m and m.deviation, r[f"deviation_{n}"])
            if n < 63:
                assert (r[f"max{n}"], r[f"min{n}"]) == (r[f"max_{n}"], r[f"min_{n}"])
        assert near(r.median6, r.median_6)


@pytest.mark.parametrize("name", ["factor_observations", "model_samples", "feature_registry"])
def test_features_come_from_short_frames(spark, name):
    text = plan(REGISTRY[name].run(spark, SF))
    assert "percentile" not in text and "stddev" not in text and "-62" not in text and "-20, currentrow" not in text


class State:
    """A map, list or value of one key, counting the calls; as a handle, one that remembers timers."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def getMapState(self, *_):
        return State()

    getListState = getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept.get(None)

    def put(self, value):
        self.kept[None] = value

    update = put


def test_a_new_account_is_not_looked_up():
    from pitgrid.streaming import stateful as S

    from .test_streams import BOOKED, FILLS

    booking = S.BookFills("300.00")
    booking.init(State())
    names = [x.split()[0] for x in S.FILL.split(", ")]
    rows = [S.Row(**dict(zip(names, f))) for f in FILLS if f[0] == "a"]
    got = {r.arrival: r.status for r in booking.handleInputRows(("a",), iter(rows), None)}
    assert got == BOOKED and booking.known.calls == 0
    again = list(booking.handleInputRows(("a",), iter(rows[:3]), None))
    assert [r.status for r in again] == ["REPEATED", "REPEATED", "CONFLICT"] and booking.known.calls == 1


def test_an_account_waits_for_one_day_at_a_time():
    from pitgrid.streaming import stateful as S

    handle, dividends = State(), S.AdvanceDividends()
    dividends.init(handle)
    names = [x.split()[0] for x in S.ENTITLEMENT.split(", ")]
    days = [datetime.datetime(2024, 1, d, 9, tzinfo=datetime.timezone.utc) for d in (5, 2, 3, 3)]
    list(dividends.handleInputRows(("a",), iter([S.Row(**dict(zip(names, ("a", d, *[None] * 6)))) for d in days]), None))
    assert handle.timers == [S._end_ms(datetime.date(2024, 1, 2))] and len(dividends.ends.get()) == 3


def test_pages_pass_through_python_once(spark):
    """A page is decoded once and its cells unescaped once; its bytes are made without Python."""
    text = plan(REGISTRY["html_tables"].run(spark, SF))
    assert text.count("FileScan parquet") == 1 and text.count("ArrowEvalPython") == 2 and "Join" not in text


def test_a_row_without_a_code_counts_in_the_places(spark, tmp_path):
    """Lines without a supplier are ranked among the others on both sides, as in the SQL, and are no finding themselves."""
    first = datetime.date(1997, 1, 1)
    price = lambda k, i: 20 + (i * i * (k + 3) + 7 * i * k) % (19 + k)
    path = tables(spark, f"{tmp_path}/sf", [(s, str(first + datetime.timedelta(i)), 2, price(k, i)) for k, s in enumerate((1, 3, 5, 7, 10, 0)) for i in range(300 + k)])
    lines = pd.read_parquet(f"{path}/lineitem.parquet")
    lines.assign(l_suppkey=lines.l_suppkey.astype("Int64").where(lines.l_suppkey > 0)).to_parquet(f"{path}/lineitem.parquet", coerce_timestamps="us")
    assert same(spark, "factor_audit", path) == ""
    assert REGISTRY["factor_audit"].run(spark, path).count() > 0


def test_month_factors_against_numpy(spark):
    import numpy as np

    from pitgrid.plans import audit_queries as Q

    rng = np.random.default_rng(3)
    first = datetime.date(2001, 3, 5)
    series = {c: np.round(rng.uniform(5, 60, n), 2).tolist() for c, n in (("a", 252), ("b", 253), ("c", 700))}
    series["d"] = [*series["c"][:300], None, *series["c"][301:]]
    rows = [(c, first + datetime.timedelta(2 * i), x) for c, xs in series.items() for i, x in enumerate(xs)]
    got = {(r.code, r.m): (r.mom, r.vol) for r in Q.month_factors(spark.createDataFrame(rows, "code string, trade_date date, close double")).collect()}
    want = {}
    for c, xs in series.items():
        days = [first + datetime.timedelta(2 * i) for i in range(len(xs))]
        for i in range(252, len(xs)):
            window = xs[i - 63 : i + 1]
            if (i + 1 == len(xs) or days[i + 1].month != days[i].month) and None not in (*window, xs[i - 21], xs[i - 252]):
                x = np.array(window)
                want[c, days[i].replace(day=1)] = (xs[i - 21] / xs[i - 252] - 1, float(np.std(x[1:] / x[:-1] - 1, ddof=1) * 252**0.5))
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(g - w) <= 2e-8 for k in want for g, w in zip(got[k], want[k]))


def test_factors_are_audited_without_joins_of_bars(spark):
    """Bars are read once a side, and only the finished places are joined."""
    text = plan(REGISTRY["factor_audit"].run(spark, SF))
    assert text.count("FileScan parquet") == 2 and text.count("SortMergeJoin") + text.count("HashJoin") == 1 and "-62" not in text


def test_parts_of_an_account_go_through_one_grouping(spark):
    """Joined one by one, their sorts and maps stand side by side in one task: 19 joins before."""
    text = plan(REGISTRY["account_audit"].run(spark, SF))
    assert text.count("SortMergeJoin") + text.count("HashJoin") <= 4


def test_events_without_an_id_are_not_paid(spark):
    from .test_validators import ledger_case

    assert ledger_case(spark, dividends=[(None, 4, 5, 10)], paid=[None], receivable="10") == ["UNKNOWN_PAID_EVENT"]
    assert ledger_case(spark, dividends=[(None, 4, 5, 10)], receivable="10") == []
