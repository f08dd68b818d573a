"""Account rules as streams whose state outlives batches and restarts: bookings, dividends, running counters.

Each is a processor for transformWithState, keyed by account or code. A batch is a set: its rows of a key are put in the
order of arrival (or day) before they are applied; from batch to batch, what comes late is refused in an output row and
changes nothing.
"""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = datetime.timedelta(days=1)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Maps, lists and timers need the state store on RocksDB; the session's own setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_with_state(stream: DataFrame, folder: str) -> DataFrame:
    """Run over what there is and return the written table; a restart with the same folder goes on where it stopped."""
    from pitgrid.streaming.accounts import run_to_table

    with keyed_state(stream.sparkSession):
        return run_to_table(stream, folder)


# ---- bookings

FILL = "account string, arrival long, fill_id long, day date, sequence long, side string, code string, shares long, price decimal(18,2), fees decimal(18,2), sellable_on date"
_CONTENT = ("day", "sequence", "side", "code", "shares", "price", "fees", "sellable_on")


class BookFills(StatefulProcessor):
    """Fills of an account, booked once each and in strict order of (day, sequence).

    State: cash, the last booked (day, sequence), the contents of every booked fill by id, and the open lots, oldest first.
    Only booked fills count as known: one that was refused may come again.
    """

    def __init__(self, cash: str) -> None:
        self.start = Decimal(cash)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "cash decimal(18,2), day date, sequence long")
        self.known = handle.getMapState("known", "fill_id long", "content string")
        self.lots = handle.getListState("lots", "code string, sellable_on date, shares long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        head = self.head.get()
        cash, day, sequence = head or (self.start, None, None)
        # each look into the state is a call to the JVM; of an account that has booked nothing there is nothing to find
        lots = [list(x) for x in self.lots.get()] if head and self.lots.exists() else []
        seen: dict = {}
        out, booked = [], False
        for r in sorted(rows, key=lambda r: r.arrival):
            content = repr([str(r[c]) for c in _CONTENT])
            if r.fill_id not in seen:
                seen[r.fill_id] = self.known.getValue((r.fill_id,)) if head else None
            status, after = self.judge(r, content, seen[r.fill_id], cash, (day, sequence), lots)
            if status == "BOOKED":
                cash, day, sequence, booked = after, r.day, r.sequence, True
                seen[r.fill_id] = (content,)
                self.known.updateValue((r.fill_id,), (content,))
                if r.side == "BUY":
                    lots.append([r.code, r.sellable_on, r.shares])
                else:
                    lots = _consumed(lots, r.code, r.day, r.shares)
            out.append(Row(account=key[0], arrival=r.arrival, fill_id=r.fill_id, status=status, cash=cash))
        if booked:
            self.head.update((cash, day, sequence))
            if lots:
                self.lots.put([tuple(x) for x in lots])
            else:
                self.lots.clear()
        return iter(out)

    @staticmethod
    def judge(r: Row, content: str, prior: tuple | None, cash: Decimal, last: tuple, lots: list) -> tuple[str, Decimal | None]:
        if not _valid(r):
            return "INVALID", None
        if prior is not None:
            return ("REPEATED" if prior[0] == content else "CONFLICT"), None
        if last[0] is not None and (r.day, r.sequence) <= last:
            return "OUT_OF_ORDER", None
        gross = r.price * r.shares
        if r.side == "SELL" and sum(n for code, free, n in lots if code == r.code and free <= r.day) < r.shares:
            return "NO_SHARES", None
        after = cash + (gross if r.side == "SELL" else -gross) - r.fees
        return ("BOOKED", after) if after >= 0 else ("NO_CASH", None)

    def close(self) -> None:
        pass


def _valid(r: Row) -> bool:
    if None in (r.fill_id, r.day, r.sequence, r.code, r.shares, r.price, r.fees) or r.side not in ("BUY", "SELL"):
        return False
    if r.shares <= 0 or r.price <= 0 or r.fees < 0 or r.sequence < 0:
        return False
    return r.sellable_on is not None and r.sellable_on > r.day if r.side == "BUY" else r.sellable_on is None


def _consumed(lots: list, code: str, day: datetime.date, shares: int) -> list:
    """Lots after a sale of what may be sold on that day, first in, first out."""
    left = []
    for own, free, n in lots:
        used = min(n, shares) if own == code and free <= day else 0
        shares -= used
        if n > used:
            left.append([own, free, n - used])
    return left


def book_stream(fills: DataFrame, cash: str) -> DataFrame:
    """fills: a stream of FILL. A row for each that came: account, arrival, fill_id, status, cash (after it).

    Status BOOKED; REPEATED (same id and contents as a booked one: nothing changes); CONFLICT (same id, other contents);
    INVALID; OUT_OF_ORDER (not after the last booked one); NO_CASH; NO_SHARES (not held, or not free to sell that day).
    """
    return fills.groupBy("account").transformWithState(BookFills(cash), "account string, arrival long, fill_id long, status string, cash decimal(18,2)", "append", "none")


# ---- dividends

ENTITLEMENT = "account string, at timestamp, event_id long, supplied date, ex_date date, pay_date date, gross decimal(18,2), payment decimal(18,2)"


class AdvanceDividends(StatefulProcessor):
    """Entitlements of an account, day by day as the watermark closes the days on which the account is processed.

    A row without an event_id says that the account is processed on the day of `at`: a timer waits for the end of the
    first such day, and all days that are closed by then are taken in order, whatever the order of arrival. State: the
    entitlements, how far they are, and the ends of the days that are still open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "event_id long", "supplied date, ex_date date, pay_date date, gross decimal(18,2), payment decimal(18,2), status string")
        self.ends = handle.getListState("ends", "end long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        out, ends = [], set()
        held: dict = {}
        known = self.held.exists()
        changed = set()
        for r in sorted(rows, key=lambda r: (r.at, r.event_id is not None, r.event_id or 0, r.gross or 0, r.payment or 0)):
            if r.event_id is None:
                ends.add(_end_ms(r.at.date()))
                continue
            content = (r.supplied, r.ex_date, r.pay_date, r.gross, r.payment)
            if r.event_id not in held:
                held[r.event_id] = self.held.getValue((r.event_id,)) if known else None
            prior = held[r.event_id]
            if prior is not None:
                if prior[5] == "REWRITTEN" or tuple(prior[1:5]) == content[1:]:
                    continue
                content, status = tuple(prior[:5]), "REWRITTEN"
            else:
                status = "LATE_EX" if r.supplied > r.ex_date else "PENDING"
            if status != "PENDING":
                out.append(_step(key, r.event_id, content, r.supplied, status))
            held[r.event_id] = (*content, status)
            changed.add(r.event_id)
        for event_id in changed:
            self.held.updateValue((event_id,), held[event_id])
        if ends:
            before = {e for (e,) in self.ends.get()} if self.ends.exists() else set()
            if ends - before:
                self.ends.put([(e,) for e in sorted(before | ends)])
                if not before or min(ends) < min(before):
                    self.handle.registerTimer(min(ends))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if not self.ends.exists():
            return iter([])
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ends = sorted(e for (e,) in self.ends.get())
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        waiting = sorted(k for k, v in held.items() if v[5] in ("PENDING", "RECEIVABLE"))
        out, changed = [], set()
        for end in (e for e in ends if e <= passed):
            day = datetime.datetime.fromtimestamp(end / 1000, datetime.timezone.utc).date() - DAY
            for event_id in waiting:
                *content, status = held[event_id]
                ex_date, pay_date = content[1], content[2]
                if status == "PENDING" and ex_date <= day:
                    status = "RECEIVABLE" if ex_date == day else "LATE_EX"
                    out.append(_step(key, event_id, content, day, status))
                if status == "RECEIVABLE" and pay_date <= day:
                    status = "PAID" if pay_date == day else "LATE_PAY"
                    out.append(_step(key, event_id, content, day, status))
                if status != held[event_id][5]:
                    held[event_id] = (*content, status)
                    changed.add(event_id)
        for event_id in changed:
            self.held.updateValue((event_id,), held[event_id])
        if left := [e for e in ends if e > passed]:
            self.ends.put([(e,) for e in left])
            self.handle.registerTimer(left[0])
        else:
            self.ends.clear()
        return iter(out)

    def close(self) -> None:
        pass


def _step(key: tuple, event_id: int, content: tuple, day: datetime.date, status: str) -> Row:
    return Row(account=key[0], event_id=event_id, day=day, status=status, gross=content[3], payment=content[4])


def _end_ms(day: datetime.date) -> int:
    return int(datetime.datetime(day.year, day.month, day.day, tzinfo=datetime.timezone.utc).timestamp() * 1000) + 86_400_000


def advance_stream(rows: DataFrame) -> DataFrame:
    """rows: a stream of ENTITLEMENT with a watermark on `at`, in a session in UTC. A row for each step of an entitlement:
    account, event_id, day, status, gross, payment. RECEIVABLE on its ex date and PAID on its pay date, if the account is
    processed on just these days; LATE_EX or LATE_PAY once a later day is processed (or it was supplied after its ex date): what was missed is not made
    up for. REWRITTEN if it is supplied again with other contents. Of an entitlement without a step, nothing was due yet.
    """
    schema = "account string, event_id long, day date, status string, gross decimal(18,2), payment decimal(18,2)"
    return rows.groupBy("account").transformWithState(AdvanceDividends(), schema, "append", "eventTime")


def last_steps(steps: DataFrame) -> DataFrame:
    """The state of each entitlement after its steps, with what is due, paid and withheld."""
    order = F.array_position(F.array(*map(F.lit, ("RECEIVABLE", "PAID", "LATE_PAY", "LATE_EX", "REWRITTEN"))), F.col("status"))
    last = steps.groupBy("account", "event_id").agg(F.max_by(F.struct("status", "gross", "payment"), order).alias("s")).select("account", "event_id", "s.*")
    due = lambda s, c: F.when(F.col("status") == s, c).otherwise(F.lit(0)).cast("decimal(18,2)")
    return last.select("account", "event_id", "status", due("RECEIVABLE", F.col("gross")).alias("receivable"), due("PAID", F.col("payment")).alias("cash"), due("PAID", F.col("gross") - F.col("payment")).alias("withheld"))


# ---- running counters

class KeepApart(StatefulProcessor):
    """Signals of a key, kept only if they lie more than `gap` positions after the last one kept."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen long, kept long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        seen, kept = self.last.get() or (None, None)
        out = []
        for r in sorted(rows, key=lambda r: r.position):
            if seen is not None and r.position <= seen:
                status = "REFUSED"
            else:
                seen = r.position
                status = "KEPT" if kept is None or seen - kept > self.gap else "COOLING"
                kept = seen if status == "KEPT" else kept
            out.append(Row(key=key[0], position=r.position, status=status))
        self.last.update((seen, kept))
        return iter(out)

    def close(self) -> None:
        pass


def cooldown_stream(signals: DataFrame, gap: int) -> DataFrame:
    """signals: a stream of (key string, position long). A row each: KEPT, COOLING, or REFUSED (not after the last seen)."""
    return signals.groupBy("key").transformWithState(KeepApart(gap), "key string, position long, status string", "append", "none")


class StaleRuns(StatefulProcessor):
    """Length of the run of stale days of a code; after `limit` of them the code is gated."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date, run long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        day, before = self.last.get() or (None, 0)
        df = pd.concat(list(rows)).sort_values("trade_date", kind="stable")
        days, stale = df["trade_date"].to_numpy(), df["stale"].to_numpy()
        refused = np.concatenate(([False], days[1:] == days[:-1])) | ((days <= day) if day is not None else False)
        live = np.flatnonzero(~refused)
        place = np.arange(1, len(live) + 1)
        fresh = np.maximum.accumulate(np.where(stale[live] == True, 0, place))  # noqa: E712  null is not stale
        run = place - fresh + np.where(fresh == 0, before, 0)
        runs, gated = np.full(len(df), None, object), np.full(len(df), None, object)
        runs[live], gated[live] = run.tolist(), (run >= self.limit).tolist()
        if len(live):
            self.last.update((days[live[-1]], int(run[-1])))
        yield pd.DataFrame({"code": key[0], "trade_date": days, "run": runs, "gated": gated, "refused": refused})

    def close(self) -> None:
        pass


def stale_stream(quotes: DataFrame, limit: int) -> DataFrame:
    """quotes: a stream of (code, trade_date, stale). A row each: run, gated, and refused for days not after the last."""
    return quotes.groupBy("code").transformWithStateInPandas(StaleRuns(limit), "code string, trade_date date, run long, gated boolean, refused boolean", "append", "none")
