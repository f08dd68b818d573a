"""Evidence held against evidence: matching by consumption, agreement of shape, journals in order, rules against statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.functions import scalars as S


def match_by_consumption(events: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Events in order, each matched with the only interval of its group that is left and holds its day.

    events: keys, event_id, day; intervals: keys, interval_id, start, end (both belong to it). Groups are formed by all that
    must be equal, so amounts belong to the keys; a group is folded in one task, as what is left depends on what came
    before. A row for each event, MATCHED with its interval, or NONE or SEVERAL (nothing is used up then), and one for
    each interval that stays, UNUSED.
    """
    e = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "event_id"))).alias("events"))
    i = intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("first"), F.col("end").alias("last"), "interval_id"))).alias("intervals"))
    both = e.join(i, keys, "full").select(*keys, *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("events", e.schema["events"].dataType), ("intervals", i.schema["intervals"].dataType))])
    found_type = "array<struct<event_id:bigint,interval_id:bigint,status:string>>"

    def step(state: Column, x: Column) -> Column:
        fit = F.filter(state["left"], lambda r: (r["first"] <= x["day"]) & (x["day"] <= r["last"]))
        one = F.size(fit) == 1
        used = F.when(one, F.get(fit, F.lit(0))["interval_id"].cast("long"))
        status = F.when(one, "MATCHED").when(F.size(fit) == 0, "NONE").otherwise("SEVERAL")
        row = F.struct(x["event_id"].cast("long").alias("event_id"), used.alias("interval_id"), status.alias("status"))
        left = F.when(one, F.filter(state["left"], lambda r: r["interval_id"] != used)).otherwise(state["left"])
        return F.struct(left.alias("left"), F.concat(state["found"], F.array(row)).alias("found"))

    start = F.struct(F.col("intervals").alias("left"), F.array().cast(found_type).alias("found"))
    folded = both.select(*keys, F.aggregate("events", start, step).alias("s"))
    unused = F.transform("s.left", lambda r: F.struct(F.lit(None).cast("long").alias("event_id"), r["interval_id"].cast("long").alias("interval_id"), F.lit("UNUSED").alias("status")))
    return folded.select(*keys, F.explode(F.concat("s.found", unused)).alias("m")).select(*keys, "m.*")


def corroborate(base: DataFrame, others: dict[str, DataFrame], keys: list[str], spread: str = "0.0001", volume: int = 100) -> DataFrame:
    """Rows of base (keys, open, high, low, close, volume) and what each other source says of them, as columns named after it.

    Sources may lie a constant apart (another basis of adjustment), so it is the shape that must agree: of the four shifts
    of the prices, the largest exceeds the least by `spread` at most. MISSING, SHAPE_DIFFERS, VOLUME_DIFFERS or AGREES;
    verdict CORROBORATED if all agree, DISPUTED if none does, else PARTLY. Prices are compared as decimals.
    """
    prices = ("open", "high", "low", "close")
    out = base
    for name, other in others.items():
        there = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*prices, "volume")], F.lit(True).alias("_there"))
        out = out.join(there, keys, "left")
        shifts = [F.col(c).cast("decimal(18,6)") - F.col(f"_{c}").cast("decimal(18,6)") for c in prices]
        same_shape = (F.greatest(*shifts) - F.least(*shifts)) <= F.lit(spread).cast("decimal(18,6)")
        whole = shifts[0].isNotNull() & shifts[1].isNotNull() & shifts[2].isNotNull() & shifts[3].isNotNull()
        near = F.abs(F.col("volume") - F.col("_volume")) <= volume
        says = (
            F.when(F.col("_there").isNull(), "MISSING").when(~F.coalesce(whole & same_shape, F.lit(False)), "SHAPE_DIFFERS")
            .when(~F.coalesce(near, F.lit(False)), "VOLUME_DIFFERS").otherwise("AGREES")
        )
        out = out.withColumn(name, says).drop("_there", *[f"_{c}" for c in (*prices, "volume")])
    agreeing = sum((F.col(n) == "AGREES").cast("int") for n in others)
    return out.withColumn("verdict", F.when(agreeing == len(others), "CORROBORATED").when(agreeing == 0, "DISPUTED").otherwise("PARTLY"))


#: States that end an order, and those that leave it open.
TERMINAL, OPEN = ("SIMULATED_BOOKED", "REJECTED", "EXPIRED"), ("WAITING", "WAITING_EVIDENCE")


def journal_errors(events: DataFrame, launches: DataFrame, now: str) -> DataFrame:
    """events (order_id, event_id, checked_at, code, status, cash) in the order of their times, with the first error of each.

    launches: order_id, code, generated_at, cash. INVALID_TIME (before the launch or after now), IDENTITY_MISMATCH,
    AFTER_TERMINAL (a second terminal state or anything after one), UNKNOWN_STATUS, CHANGES_ACCOUNT (an event that books
    nothing with other cash than the launch's); "" if there is none. A terminal state with an error ends nothing.
    """
    j = events.join(launches.select("order_id", F.col("code").alias("launch_code"), "generated_at", F.col("cash").alias("launch_cash")), "order_id", "left")
    in_time = F.coalesce((F.col("generated_at") <= F.col("checked_at")) & (F.col("checked_at") <= F.lit(now).cast("timestamp_ntz")), F.lit(False))
    same = F.coalesce(F.col("code") == F.col("launch_code"), F.lit(False))
    keeps = (F.col("status") == "SIMULATED_BOOKED") | F.col("cash").eqNullSafe(F.col("launch_cash"))
    ends = in_time & same & F.col("status").isin(*TERMINAL) & keeps
    before = W.partitionBy("order_id").orderBy("checked_at", "event_id").rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.max(ends).over(before), F.lit(False))
    known = F.coalesce(F.col("status").isin(*TERMINAL, *OPEN), F.lit(False))
    error = F.when(~in_time, "INVALID_TIME").when(~same, "IDENTITY_MISMATCH").when(ended, "AFTER_TERMINAL").when(~known, "UNKNOWN_STATUS").when(~keeps, "CHANGES_ACCOUNT").otherwise("")
    return j.withColumn("error", error).drop("launch_code", "generated_at", "launch_cash")


def journal_reports(checked: DataFrame) -> DataFrame:
    """An order's report from its events with errors: its terminal state, if it has one, else its latest; errors refuse it."""
    at = F.struct("checked_at", "event_id")
    good = F.when(F.col("error") == "", F.col("status"))
    return checked.groupBy("order_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("error") != "").alias("errors"), F.max(F.when((F.col("error") == "") & F.col("status").isin(*TERMINAL), F.col("status"))).alias("terminal"),
        F.min_by(F.nullif("error", F.lit("")), F.when(F.col("error") != "", at)).alias("first_error"), F.max_by(good, F.when(good.isNotNull(), at)).alias("latest"),
    ).withColumn("report", F.when(F.col("errors") > 0, "REFUSED").when(F.col("terminal").isNotNull(), "FINAL").otherwise("OPEN"))


def rule_flags(bars: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """bars (code, trade_date, pre_close, close, volume, traded boolean, special boolean) with board, ratio, upper, lower and
    the flags limit_up, limit_down and suspended, inferred from the close before. Where that or the close is unusable (null,
    not positive), limits and all flags are null: nothing is said. volume is missing: suspended. Limits are rounded to cents
    half up, of decimals."""
    board = S.board_of(F.col("code"))
    ratio = S.price_limit_ratio(board, F.coalesce("special", F.lit(False)), F.col("trade_date"))
    usable = F.coalesce((F.col("pre_close") > 0) & (F.col("close") > 0), F.lit(False))
    pre = F.col("pre_close").cast("decimal(18,4)")
    limit = lambda sign: F.when(usable, F.round(pre * (1 + sign * ratio.cast("decimal(4,2)")), 2).cast("decimal(18,2)"))
    out = bars.withColumn("board", board).withColumn("ratio", ratio).withColumn("upper", limit(1)).withColumn("lower", limit(-1))
    near = lambda c: F.abs(F.col("close").cast("double") - F.col(c).cast("double")) <= tolerance
    idle = ~F.coalesce(F.col("traded"), F.lit(False)) | (F.coalesce("volume", F.lit(0)) <= 0)
    return out.withColumn("limit_up", near("upper")).withColumn("limit_down", near("lower")).withColumn("suspended", F.when(usable, idle))


def rule_alignment(flagged: DataFrame, stated: DataFrame, keys: tuple[str, ...] = ("code", "trade_date")) -> DataFrame:
    """A cross table of inferred rules against stated ones, by board, by status and overall, in one pass.

    stated: keys (they name one row of either side), stated_upper, stated_lower. Rows, rows of which something can be said, rows at either limit,
    suspended ones, halts that the status and the volume disagree on, and how the stated limits compare: the same, others,
    or none stated.
    """
    j = flagged.join(stated, list(keys), "left")
    said, both = F.col("upper").isNotNull(), F.col("stated_upper").isNotNull() & F.col("stated_lower").isNotNull()
    same = (F.col("upper") == F.col("stated_upper")) & (F.col("lower") == F.col("stated_lower"))
    status = F.when(F.col("traded"), "TRADED").otherwise("HALTED")
    j = j.withColumn("status", status)
    b, s = F.col("board"), F.col("status")
    return j.groupingSets([[b], [s], []], b, s).agg(
        F.count("*").alias("rows"), F.count_if(said).alias("eligible"), F.count_if("limit_up").alias("limit_up"), F.count_if("limit_down").alias("limit_down"), F.count_if("suspended").alias("suspended"),
        F.count_if(said & (F.col("suspended") != ~F.coalesce("traded", F.lit(False)))).alias("halts_differ"),
        F.count_if(said & both & same).alias("stated_same"), F.count_if(said & both & ~same).alias("stated_other"), F.count_if(said & ~both).alias("not_stated"),
    )


def state_chain(steps: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """steps with step (from 1, in order) and chain: a hash of the states of this step and of all before it, in their places."""
    by = W.partitionBy(key).orderBy(*order)
    numbered = steps.withColumn("step", F.row_number().over(by).cast("long"))
    own = F.xxhash64("step", *[x for c in state for x in (F.col(c).isNull(), F.col(c))])
    return numbered.withColumn("_own", own).withColumn("chain", F.bit_xor("_own").over(W.partitionBy(key).orderBy("step").rowsBetween(W.unboundedPreceding, 0))).drop("_own")


def first_divergence(stored: DataFrame, replayed: DataFrame, key: str) -> DataFrame:
    """(key, steps, first_divergence): the first step at which two chains of an account differ, or one of them lacks; null if
    they are the same to the end. steps are those of the replay."""
    a, b = stored.select(key, "step", F.col("chain").alias("_stored")), replayed.select(key, "step", F.col("chain").alias("_replayed"))
    j = a.join(b, [key, "step"], "full")
    return j.groupBy(key).agg(F.count("_replayed").alias("steps"), F.min(F.when(~F.col("_stored").eqNullSafe(F.col("_replayed")), F.col("step"))).alias("first_divergence"))
