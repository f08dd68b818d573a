"""Records around an account: lists admitted to observation, the log that they open, journals replayed, gaps that remain,
the features of a model and the datasets of a canonical layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators.ledger import MONEY, fifo_lots
from pitgrid.sources import files as S

#: Columns of a forward log's tables.
LOG_TABLES = {
    "signals": ("signal_id", "recorded_at", "observed_date", "stock_code", "name", "mechanism", "event_type", "actionable", "reason", "rule_version", "source_watchlist"),
    "orders": ("order_id", "signal_id", "planned_trade_date", "stock_code", "side", "target_weight", "requested_shares", "status", "created_at"),
    "trades": ("trade_id", "order_id", "trade_date", "stock_code", "side", "shares", "price_unadjusted", "commission", "stamp_tax", "slippage", "total_cash_change"),
    "rejections": ("rejection_id", "order_id", "signal_id", "stock_code", "rejected_at", "reason", "evidence"),
    "positions": ("as_of", "stock_code", "shares", "sellable_shares", "cost_basis", "market_price_unadjusted", "market_value"),
    "daily_reconciliation": ("as_of", "cash", "positions_market_value", "equity", "position_count", "order_count", "trade_count", "status", "note"),
}
ADMITTED = "ADMITTED_FOR_FORWARD_OBSERVATION_ONLY"

_RATIO, _WINDOW = "ratio", "an invalid window rejects the row"
_CLOSES = "a close that is missing or not positive rejects the row"
#: The model's features as (name, formula, unit, what is missing).
FEATURES = (
    ("return_5", "close(t) / close(t-5) - 1", _RATIO, _CLOSES),
    ("return_20", "close(t) / close(t-20) - 1", _RATIO, _CLOSES),
    ("volatility_20", "sample deviation of the last daily returns, times sqrt(252)", "annualized ratio", _CLOSES),
    ("amount_median_5", "median of amount(t-4..t)", "source amount", "an amount that is missing or negative rejects the row"),
    ("volume_median_5", "median of volume(t-4..t)", "source volume", "a volume that is missing or negative rejects the row"),
    ("KMID", "(close - open) / open", _RATIO, _WINDOW),
    ("KLEN", "(high - low) / open", _RATIO, _WINDOW),
    ("KMID2", "(close - open) / (high - low)", _RATIO, _WINDOW),
    ("KUP", "(high - max(open, close)) / open", _RATIO, _WINDOW),
    ("KUP2", "(high - max(open, close)) / (high - low)", _RATIO, _WINDOW),
    ("KLOW", "(min(open, close) - low) / open", _RATIO, _WINDOW),
    ("KLOW2", "(min(open, close) - low) / (high - low)", _RATIO, _WINDOW),
    ("KSFT", "(2 close - high - low) / open", _RATIO, _WINDOW),
    ("KSFT2", "(2 close - high - low) / (high - low)", _RATIO, _WINDOW),
    ("ROC20", "close(t-20) / close(t)", _RATIO, _WINDOW),
    ("MA20", "mean of close(t-20..t) / close(t)", _RATIO, _WINDOW),
    ("STD20", "sample deviation of close(t-20..t) / close(t)", _RATIO, _WINDOW),
    ("VMA20", "mean of volume(t-20..t) / volume(t)", _RATIO, _WINDOW),
    ("VSTD20", "sample deviation of volume(t-20..t) / volume(t)", _RATIO, _WINDOW),
    ("MAX20", "max of high(t-20..t) / close(t)", _RATIO, _WINDOW),
    ("MIN20", "min of low(t-20..t) / close(t)", _RATIO, _WINDOW),
    ("RSV20", "(close - min of low) / (max of high - min of low) over t-20..t", _RATIO, _WINDOW),
)


def _named(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that apply, in order; one that can't be decided doesn't."""
    return F.array_compact(F.array(*[F.when(applies, F.lit(name)) for applies, name in rules]))


def _all(c: Column) -> Column:
    """True if c is true for every row; null is not true."""
    return F.every(F.coalesce(c, F.lit(False)))


def admissions(lists: DataFrame, validations: DataFrame, crosschecks: DataFrame) -> DataFrame:
    """(report, n_members, reasons, status) of each report of lists (report, code, watch_status).

    It is admitted if its validation (report, status) passed, the official cross-check (report, status, admission) passed
    and confirmed, each member is marked for observation only, and none is listed twice. Evidence that lacks refuses;
    evidence given twice must pass twice.
    """
    once = lists.groupBy("report", "code").agg(F.count("*").alias("n"), _all(F.col("watch_status") == "FORWARD_WATCH_ONLY").alias("forward"))
    members = once.groupBy("report").agg(F.sum("n").alias("n_members"), F.every("forward").alias("forward"), (F.max("n") > 1).alias("twice"))
    passed = validations.groupBy("report").agg(_all(F.col("status") == "PASS").alias("passed"))
    confirmed = (F.col("status") == "PASS") & (F.col("admission") == "H1_POSITIVE_PARENT_NETPROFIT_CONFIRMED")
    checked = crosschecks.groupBy("report").agg(_all(confirmed).alias("checked"))
    j = members.join(passed, "report", "left").join(checked, "report", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reasons = _named((no("passed"), "VALIDATION_NOT_PASSED"), (no("checked"), "CROSSCHECK_NOT_CONFIRMED"), (no("forward"), "NOT_FORWARD_WATCH"), (F.col("twice"), "MEMBER_TWICE"))
    return j.select("report", "n_members", reasons.alias("reasons"), F.when(F.size(reasons) == 0, ADMITTED).otherwise("REFUSED").alias("status"))


def baseline_signals(lists: DataFrame, admitted: DataFrame, frozen_at: str) -> DataFrame:
    """The signals table that the members of admitted lists (report, code, name, mechanism, cutoff) begin with: none is
    actionable, as all of them were seen before the freeze."""
    own = lists.join(admitted.where(F.col("status") == ADMITTED).select("report"), "report", "left_semi")
    signal = F.concat_ws(":", F.lit("BASELINE"), "mechanism", "code", F.col("cutoff").cast("string"))
    return own.select(
        signal.alias("signal_id"), F.lit(frozen_at).alias("recorded_at"), F.col("cutoff").cast("string").alias("observed_date"), F.col("code").alias("stock_code"), "name", "mechanism",
        F.lit("BASELINE_PRE_FREEZE").alias("event_type"), F.lit("false").alias("actionable"), F.lit("PRE_FREEZE_NO_BACKFILL").alias("reason"), F.lit("CURRENT_QUALITY_FORWARD_PILOT_V1").alias("rule_version"), F.col("report").alias("source_watchlist"),
    )


def open_log(signals: DataFrame, path: str, frozen_on: str) -> DataFrame:
    """Write the six tables of a forward log under path as text and return the manifest (name, columns, n_rows, rows_hash) of
    what can be read back. A log is opened once: a path that exists is an error."""
    spark: SparkSession = signals.sparkSession
    unset = {"as_of": frozen_on, "position_count": "0", "order_count": "0", "trade_count": "0", "status": "NOT_APPLICABLE_CAPITAL_UNSET", "note": "CAPITAL_AND_EXIT_RULES_UNSET"}
    first = spark.range(1).select(*[F.lit(unset.get(c, "")).alias(c) for c in LOG_TABLES["daily_reconciliation"]])
    manifest = []
    for name, columns in LOG_TABLES.items():
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        S.write_text_table({"signals": signals, "daily_reconciliation": first}.get(name, empty), f"{path}/{name}", list(columns))
        rows = S.read_text_table(spark, f"{path}/{name}", list(columns))
        # bounded: the hash of a table is summed, no row leaves its task
        manifest.append(rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("rows_hash")).select(F.lit(name).alias("name"), F.lit(",".join(columns)).alias("columns"), "n_rows", "rows_hash"))
    return reduce(DataFrame.unionAll, manifest)


def replay_journals(runs: DataFrame, fills: DataFrame, lots: DataFrame) -> DataFrame:
    """(account, status, differences, cash, shares) of stored accounts rebuilt from their journals.

    runs: account, initial_cash, cash as stored. fills: account, fill_id, ts, day, side, price, shares, fees. lots as
    stored: account, lot_id, shares, sellable_on. Cash is the initial cash and all flows; open lots are what first-in-first-out
    sales leave, sellable from the day after. A replay that doesn't balance with itself (more sold than bought) is
    NOT_REPLAYABLE whatever is stored.
    """
    sign = F.when(F.col("side") == "SELL", 1).otherwise(-1)
    flows = fills.groupBy("account").agg(F.sum((sign * F.col("price") * F.col("shares")).cast(MONEY) - F.col("fees")).cast(MONEY).alias("flow"), F.sum(-sign * F.col("shares")).alias("net"))
    left = fifo_lots(fills).join(fills.select("account", F.col("fill_id").alias("lot_id"), F.date_add("day", 1).alias("sellable")), ["account", "lot_id"])
    held = left.groupBy("account").agg(F.sum("left").alias("held"))
    is_ = lots.groupBy("account", "lot_id").agg(F.count("*").alias("n"), F.min("shares").alias("has"), F.min("sellable_on").alias("sellable_on"))
    both = left.where("left > 0").select("account", "lot_id", "left", "sellable").join(is_, ["account", "lot_id"], "full_outer")
    known = F.col("left").isNotNull() & F.col("n").isNotNull()
    lot_errors = both.groupBy("account").agg(
        F.max(F.col("n").isNull()).alias("lost"), F.max(F.col("left").isNull()).alias("extra"), F.max(F.coalesce(F.col("n") > 1, F.lit(False))).alias("twice"),
        F.max(known & ~F.col("left").eqNullSafe(F.col("has"))).alias("shares_differ"), F.max(known & ~F.col("sellable").eqNullSafe(F.col("sellable_on"))).alias("day_differs"),
    )
    j = runs.join(flows, "account", "left").join(held, "account", "left").join(lot_errors, "account", "left")
    cash = (F.col("initial_cash") + F.coalesce("flow", F.lit(0))).cast(MONEY)
    net = F.coalesce("net", F.lit(0))
    differences = _named(
        (~F.col("cash").cast(MONEY).eqNullSafe(cash), "CASH_DIFFERS"), (F.col("lost"), "LOT_MISSING"), (F.col("extra"), "LOT_UNKNOWN"), (F.col("twice"), "LOT_TWICE"),
        (F.col("shares_differ"), "LOT_SHARES_DIFFER"), (F.col("day_differs"), "SELLABLE_DAY_DIFFERS"),
    )
    status = F.when(F.coalesce("held", F.lit(0)) != net, "NOT_REPLAYABLE").when(F.size(differences) > 0, "REPLAY_DIFFERS").otherwise("REPLAY_MATCH")
    return j.select("account", status.alias("status"), differences.alias("differences"), cash.alias("cash"), net.cast("long").alias("shares"))


def account_gaps(orders: DataFrame, translated: DataFrame, evidence: DataFrame, window: str) -> DataFrame:
    """One row a window of orders (order_id, window, side, requested): how far they are from an account in whole shares.

    translated: order_id, shares, open, reason. evidence: order_id and the flags has_fill, has_lot, has_rule, has_action and
    has_fee; null and no row mean no evidence. blockers names every kind that some order of the window lacks.
    """
    flags = {"has_fill": "RESEARCH_ORDER_NOT_REAL_FILL", "has_lot": "NO_INITIAL_REAL_SHARE_LOTS", "has_rule": "NO_VERIFIED_PRICE_LIMIT_RULE", "has_action": "NO_COMPLETE_CORPORATE_ACTION_COVERAGE", "has_fee": "NO_FEE_SLIPPAGE_MAPPING"}
    reasons = {"untranslated": "NOT_TRANSLATED", "missing_price": "MISSING_UNADJUSTED_PRICE", "not_tradable": "NOT_CONFIRMED_TRADABLE", "below_minimum": "CANDIDATE_BELOW_MINIMUM_SHARES", "candidates": "CANDIDATE_NOT_FILL"}
    t = translated.groupBy("order_id").agg(F.min("shares").alias("shares"), F.min("open").alias("open"), F.min("reason").alias("reason"))
    e = evidence.groupBy("order_id").agg(*[_all(F.col(c)).alias(c) for c in flags])
    j = orders.join(t, "order_id", "left").join(e, "order_id", "left").withColumn("reason", F.coalesce("reason", F.lit("NOT_TRANSLATED")))
    notional = F.col("shares") * F.col("open").cast("decimal(18,4)")
    g = j.groupBy(window).agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"),
        F.sum(F.col("requested").cast(MONEY)).alias("requested"), F.coalesce(F.sum("shares"), F.lit(0)).alias("candidate_shares"), F.coalesce(F.sum(notional), F.lit(0)).alias("candidate_notional"),
        *[F.count_if(F.col("reason") == r).alias(c) for c, r in reasons.items()], *[_all(F.col(c)).alias(c) for c in flags],
    )
    blockers = _named(*[(~F.col(c), name) for c, name in flags.items()])
    status = F.when(F.size(blockers) > 0, "NOT_READY_REAL_SHARE_ACCOUNT").when(F.col("candidates") < F.col("n_orders"), "NOT_ALL_TRANSLATED").otherwise("READY_FOR_REPLAY")
    return g.select(*[c for c in g.columns if c not in flags], blockers.alias("blockers"), status.alias("status"))


def feature_registry(samples: DataFrame) -> DataFrame:
    """(place, name, formula, unit, missing, n_rows, n_missing, least, greatest) of the model's features over samples, which
    must have a column for each and no unknown number column; one pass over the samples."""
    names = [f[0] for f in FEATURES]
    if lacking := [n for n in names if n not in samples.columns]:
        raise ValueError(f"samples lack {lacking}")
    one = lambda n: F.struct(F.count("*").alias("n_rows"), F.count_if(F.col(n).isNull()).alias("n_missing"), F.min(n).alias("least"), F.max(n).alias("greatest"))
    facts = [F.struct(F.lit(i + 1).cast("long").alias("place"), *[F.lit(v).alias(c) for c, v in zip(("name", "formula", "unit", "missing"), f)], one(f[0]).alias("v")) for i, f in enumerate(FEATURES)]
    return samples.agg(F.array(*facts).alias("f")).select(F.inline("f")).select("place", "name", "formula", "unit", "missing", "v.*")


def layer_summary(datasets: dict[str, tuple[DataFrame, str | None, str | None]], universe: DataFrame, covers: tuple[str, ...], expected: dict[str, int]) -> DataFrame:
    """One row a dataset (rows, its code column, its date column): counts, range, failures, and the status of the layer.

    Datasets in covers must hold every code of universe, others needn't; a dataset in expected must hold so many codes; none
    may be empty. One failure refuses the whole layer.
    """
    parts = []
    for name, (df, code, day) in datasets.items():
        date = F.col(day).cast("string") if day else F.lit(None).cast("string")
        per = df.groupBy(F.col(code).alias("code") if code else F.lit("").alias("code")).agg(F.count("*").alias("n"), F.min(date).alias("a"), F.max(date).alias("b"))
        if name in covers:
            per = per.join(universe.select("code").distinct().withColumn("wanted", F.lit(True)), "code", "full_outer")
        else:
            per = per.withColumn("wanted", F.lit(None).cast("boolean"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.when(F.lit(code is not None), F.col("n"))).alias("n_codes"), F.min("a").alias("first"), F.max("b").alias("last"), F.count_if(F.col("wanted") & F.col("n").isNull()).alias("lacking"))
        wrong = F.col("n_codes") != expected[name] if name in expected else F.lit(False)
        failures = _named((F.col("n_rows") == 0, "EMPTY"), (wrong, "CODE_COUNT_UNEXPECTED"), (F.col("lacking") > 0, "UNIVERSE_NOT_COVERED"))
        parts.append(one.select(F.lit(name).alias("dataset"), "n_rows", "n_codes", "first", "last", "lacking", failures.alias("failures")))
    rows = reduce(DataFrame.unionAll, parts)
    any_failure = F.max(F.size("failures")).over(W.partitionBy(F.lit(0)))  # a row a dataset
    return rows.withColumn("status", F.when(any_failure > 0, "REFUSED").otherwise("PASS_WITH_KNOWN_LIMITS"))
