"""Look-ahead-safe window features over a long panel (code, trade_date, ...).

A window is a run of rows of one code up to the row itself, or before it. A value is given only where its window is
complete: anything short or missing gives null, never a shorter window. All features of a code share one
partitioning and order, so that a set of them costs one shuffle and one sort.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(key: str = "code", order: str = "trade_date"):
    return W.partitionBy(key).orderBy(order)


def rows(first: int, last: int, key: str = "code", order: str = "trade_date"):
    return series(key, order).rowsBetween(first, last)


def whole(value: Column, of: Column, first: int, last: int) -> Column:
    """value where all last - first + 1 rows of the frame have `of`."""
    return F.when(F.count(of).over(rows(first, last)) == last - first + 1, value)


def lagged(c: str, n: int) -> Column:
    return F.lag(c, n).over(series())


def calendar(days: DataFrame) -> DataFrame:
    """(trade_date, cal_idx): dates numbered from 0. A date a row, so one sort of a calendar is small at any scale."""
    unique = days.select("trade_date").distinct()
    return unique.withColumn("cal_idx", F.row_number().over(W.orderBy("trade_date")) - 1)


def on_calendar(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """A row for every code and every calendar date between the code's first and last; values null where it had none."""
    spans = panel.groupBy("code").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    numbered = spans.join(F.broadcast(cal.select(F.col("trade_date").alias("first"), F.col("cal_idx").alias("a"))), "first").join(F.broadcast(cal.select(F.col("trade_date").alias("last"), F.col("cal_idx").alias("b"))), "last")
    grid = numbered.select("code", F.explode(F.sequence("a", "b")).alias("cal_idx")).join(F.broadcast(cal), "cal_idx")
    return grid.join(panel, ["code", "trade_date"], "left")


def momentum(close: str = "close", skip: int = 21, look_back: int = 252) -> Column:
    return lagged(close, skip) / lagged(close, look_back) - 1


def returns(close: str = "close") -> Column:
    return F.col(close) / lagged(close, 1) - 1


def volatility(moments: str, per_year: int = 252) -> Column:
    """Sample deviation of the last returns, whose moments are given by with_rolling(), a year's."""
    return F.col(f"{moments}.deviation") * F.sqrt(F.lit(float(per_year)))


def _block(n: int) -> int:
    """Size of the blocks that an n-row window is put together from with the fewest looks back."""
    return min(range(1, n + 1), key=lambda b: (b - 1 + n // b - 1 + n % b, -b))


def with_rolling(panel: DataFrame, wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """panel with a column for each of wanted, name: (kind, column, n), over the last n rows of a code, this one included;
    kind is max, min, or moments (a struct of mean and sample deviation).

    A frame of n rows costs n updates a row. Here blocks of about sqrt(n) rows are made by looking back row by row, and
    windows by looking back block by block; looks of one distance share a pass. Moments are put together from the blocks'
    means and squared distances from these, so that no large squares cancel.
    """
    kept = panel.columns
    back = lambda c, k: F.col(c) if k == 0 else lagged(c, k)
    mean_of = lambda xs, sizes: reduce(add, [x * float(k) for x, k in zip(xs, sizes)]) / float(sum(sizes))
    plan = {name: (kind, c, n, _block(n)) for name, (kind, c, n) in wanted.items()}
    seen = {f"_{c}_{k}": back(c, k) for _, c, _, b in plan.values() for k in range(b)}
    blocks, squares = {}, {}
    for name, (kind, c, _, b) in plan.items():
        xs = [F.col(f"_{c}_{k}") for k in range(b)]
        if kind == "moments":
            blocks[f"_{name}"] = mean_of(xs, [1] * b)
            squares[f"_{name}_2"] = reduce(add, [(x - F.col(f"_{name}")) ** 2 for x in xs])
        else:
            blocks[f"_{name}"] = _extreme(kind, xs)
    df = panel.withColumns(seen).withColumns(blocks).withColumns(squares)
    df = df.drop(*[x for x in seen if x not in {f"_{c}_0" for _, c, _, _ in plan.values()}])
    looks, means, values = {}, {}, {}
    for name, (kind, c, n, b) in plan.items():
        parts = [(f"_{name}", i * b, b) for i in range(n // b)] + [(f"_{c}_0", n - 1 - i, 1) for i in range(n % b)]
        of = {f"_{name}_w{k}": (x, k) for x, k, _ in parts}
        looks |= {w: back(*x) for w, x in of.items()}
        xs, sizes = [F.col(w) for w in of], [size for _, _, size in parts]
        if kind == "moments":
            two = {f"_{name}_q{i}": back(f"_{name}_2", i * b) for i in range(n // b)}
            looks |= two
            means[f"_{name}_mean"] = mean_of(xs, sizes)
            mean = F.col(f"_{name}_mean")
            apart = reduce(add, [F.col(q) for q in two] + [(x - mean) ** 2 * float(k) for x, k in zip(xs, sizes)])
            values[name] = F.when(mean.isNotNull(), F.struct(mean.alias("mean"), F.sqrt(apart / F.nullif(F.lit(float(n - 1)), F.lit(0.0))).alias("deviation")))
        else:
            values[name] = _extreme(kind, xs)
    return df.withColumns(looks).withColumns(means).withColumns(values).select(*kept, *wanted)


def _extreme(kind: str, xs: list[Column]) -> Column:
    """Greatest or least of all xs; null if any is null."""
    there = reduce(and_, [x.isNotNull() for x in xs])
    return F.when(there, xs[0] if len(xs) == 1 else (F.greatest if kind == "max" else F.least)(*xs))


def rolling_median(c: str, n: int) -> Column:
    """The frame's values are sorted as they are: n is small, and a percentile builds a hash map a row."""
    last = F.sort_array(F.collect_list(c).over(rows(-(n - 1), 0)))
    return F.when(F.size(last) == n, 0.5 * F.get(last, F.lit((n - 1) // 2)) + 0.5 * F.get(last, F.lit(n // 2)))


def moving_average(c: str, n: int, until: int = 0) -> Column:
    return whole(F.avg(c).over(rows(until - n + 1, until)), F.col(c), until - n + 1, until)


def prior_high(c: str, n: int) -> Column:
    """Highest of the n rows before this one."""
    return whole(F.max(c).over(rows(-n, -1)), F.col(c), -n, -1)


def position_windows(n: int = 20) -> dict[str, tuple[str, str, int]]:
    """What position_features() reads, for with_rolling()."""
    return {"closes": ("moments", "close", n + 1), "highest": ("max", "high", n + 1), "lowest": ("min", "low", n + 1)}


def position_features(n: int = 20) -> dict[str, Column]:
    """Price features over n + 1 rows, relative to the current close."""
    c, hi, lo = F.col("close"), F.col("highest"), F.col("lowest")
    return {
        f"ROC{n}": lagged("close", n) / c,
        f"MA{n}": F.col("closes.mean") / c,
        f"STD{n}": F.col("closes.deviation") / c,
        f"MAX{n}": hi / c,
        f"MIN{n}": lo / c,
        f"RSV{n}": F.when(hi > lo, (c - lo) / (hi - lo)),
    }


def volume_windows(n: int = 20) -> dict[str, tuple[str, str, int]]:
    """What volume_features() reads, for with_rolling()."""
    return {"volumes": ("moments", "volume", n + 1), "least_volume": ("min", "volume", n + 1)}


def volume_features(n: int = 20) -> dict[str, Column]:
    live = lambda v: F.when((F.col("volume") > 0) & (F.col("least_volume") >= 0), F.col(v) / F.col("volume"))
    return {f"VMA{n}": live("volumes.mean"), f"VSTD{n}": live("volumes.deviation")}


def candle_features() -> dict[str, Column]:
    """Nine ratios of one bar; null on a bar without a spread where the spread divides."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    spread = F.nullif(h - lo, F.lit(0.0))
    upper, lower, middle = h - F.greatest(o, c), F.least(o, c) - lo, 2 * c - h - lo
    return {
        "KMID": (c - o) / o, "KLEN": (h - lo) / o, "KMID2": (c - o) / spread, "KUP": upper / o, "KUP2": upper / spread,
        "KLOW": lower / o, "KLOW2": lower / spread, "KSFT": middle / o, "KSFT2": middle / spread,
    }


def forward_label(close: str = "close", horizon: int = 2) -> Column:
    """Return from the next row to the row `horizon` ahead; null at the end of a series."""
    return F.lead(close, horizon).over(series()) / F.lead(close, 1).over(series()) - 1


def halt_features(halted: str, window: int, recent: int) -> dict[str, Column]:
    """Halts in the window (today included), longest run inside it, halts before today, rows since the last halt."""
    flag = F.col(halted).cast("int")
    frame = rows(-(window - 1), 0)
    index = F.row_number().over(series())
    runs = F.aggregate(F.collect_list(flag).over(frame), F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
                       lambda s, x: F.struct(F.when(x == 1, s.run + 1).otherwise(0).alias("run"), F.greatest(s.best, F.when(x == 1, s.run + 1).otherwise(0)).alias("best")), lambda s: s.best)
    last_halt = F.max(F.when(flag == 1, F.col("row_no"))).over(rows(W.unboundedPreceding, 0))
    return {"halts": F.sum(flag).over(frame), "longest_halt": runs, "recent_halts": F.coalesce(F.sum(flag).over(rows(-recent, -1)), F.lit(0)), "row_no": index, "tradable_run": F.col("row_no") - F.coalesce(last_halt, F.lit(0))}


def forward_path(horizon: int) -> Column:
    """Outcome of entering at the next row's open and leaving at the close `horizon` rows ahead: status, and return with
    the best and worst point on the way where the whole path was observed. Rows are calendar rows."""
    ahead = rows(1, horizon)
    there = F.count(F.lit(1)).over(ahead)
    entry = F.lead("open", 1).over(series())
    status = (
        F.when(there < horizon, "INSUFFICIENT_FUTURE")
        .when(entry.isNull() | (entry <= 0), "ENTRY_UNOBSERVABLE")
        .when(F.count("close").over(ahead) < horizon, "PATH_INCOMPLETE")
        .otherwise("OBSERVED")
    )
    seen = status == "OBSERVED"
    return F.struct(
        status.alias("status"),
        F.when(seen, F.lead("close", horizon).over(series()) / entry - 1).alias("forward_return"),
        F.when(seen, F.max("high").over(ahead) / entry - 1).alias("best"),
        F.when(seen, F.min("low").over(ahead) / entry - 1).alias("worst"),
    )


def thin_by_cooldown(signals: DataFrame, keys: list[str], index: str, gap: int) -> DataFrame:
    """Of each key's signals, keep one only if it lies more than `gap` positions after the last one kept."""
    folded = signals.groupBy(*keys).agg(F.sort_array(F.collect_set(index)).alias("at"))
    kept = F.aggregate("at", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.concat(acc, F.array(x.cast("bigint")))).otherwise(acc))
    return folded.select(*keys, F.explode(kept).alias(index))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """left with the values of the last row of right at or before its time (before it, if not inclusive), per key.

    Union and a running last value: one shuffle, linear in both sides, whatever the number of matches. right must have
    one row a key and time. Keys that are null match nothing, and such rows stay with null values.
    """
    tag = 0 if inclusive else 2
    a = left.withColumn("as_of_time", F.col(left_time)).withColumn("as_of_side", F.lit(1)).withColumn("as_of_left", F.struct(*left.columns))
    found = F.struct(*[F.col(v) for v in values])
    b = right.withColumn("as_of_time", F.col(right_time)).withColumn("as_of_side", F.lit(tag)).withColumn("as_of_found", found)
    ks = [F.col(k) for k in keys]
    both = a.select(*ks, "as_of_time", "as_of_side", "as_of_left").unionByName(b.select(*ks, "as_of_time", "as_of_side", "as_of_found"), allowMissingColumns=True)
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("as_of_time", "as_of_side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("as_of_found", ignorenulls=True).over(w)
    hit = both.withColumn("as_of_hit", last).where("as_of_side = 1")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return hit.select("as_of_left.*", *[F.when(known, F.col(f"as_of_hit.{v}")).alias(v) for v in values])


def ordinal_percentile(group: list[str], value: str, tie: str) -> Column:
    """Place among the group from 0 to 1; ties go by `tie`, so that no two rows share a place."""
    w = W.partitionBy(*group)
    place = F.row_number().over(w.orderBy(value, tie)) - 1
    return place / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1)
