"""Account events as streams: frozen starts, day counts, orders that expire by event time, and a journal sink."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """The events table as a file stream. Times without a zone are read in the session's; days are those of UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def after_freeze(events: DataFrame, freeze: str) -> DataFrame:
    """Nothing from before the freeze is filled in later."""
    return events.where(F.col("ts") > F.lit(freeze).cast("timestamp"))


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def order_lifecycle(events: DataFrame) -> DataFrame:
    """(user_id, order_id, day, status, filled_at): one terminal state an order.

    A purchase opens an order for the next calendar day. The account's first click of that day books it; once the
    watermark has passed the day, it expires. State holds the open orders and the first clicks of days not yet past.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"orders": [], "clicks": {}}
        mark = state.getCurrentWatermarkMs()
        out = []
        for rows in batches:
            columns = (rows[c].tolist() for c in ("event_type", "event_id", "day_ms", "at_us"))  # none if the group timed out
            for kind, oid, day, at in zip(*columns):
                if kind == "purchase":
                    held["orders"].append([int(oid), day + DAY_MS])
                elif kind == "click":
                    held["clicks"][str(day)] = min(at, held["clicks"].get(str(day), at))
        still = []
        for oid, day in held["orders"]:
            at = held["clicks"].get(str(day))
            if at is not None or day + DAY_MS <= mark:
                out.append((key[0], oid, datetime.date(1970, 1, 1) + datetime.timedelta(milliseconds=day), "EXPIRED" if at is None else "BOOKED", "NaT" if at is None else np.datetime64(at, "us")))
            else:
                still.append([oid, day])
        clicks = {d: at for d, at in held["clicks"].items() if int(d) + DAY_MS > mark}
        if still or clicks:
            state.update((json.dumps({"orders": still, "clicks": clicks}),))
            state.setTimeoutTimestamp(max(mark + 1, min([d for _, d in still] + [int(d) for d in clicks]) + DAY_MS))
        elif state.exists:
            state.remove()
        if out:
            users, ids, days, status, filled = zip(*out)
            yield pd.DataFrame({"user_id": users, "order_id": ids, "day": days, "status": status, "filled_at": np.array(filled, "datetime64[us]").astype("datetime64[ns]")})

    at = F.unix_micros("ts")
    wanted = events.where("event_type in ('purchase', 'click')").select("user_id", "ts", "event_type", "event_id", (F.floor(at / 86_400_000_000) * DAY_MS).alias("day_ms"), at.alias("at_us"))
    return wanted.groupBy("user_id").applyInPandasWithState(run, "user_id long, order_id long, day date, status string, filled_at timestamp", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run over what there is and return the written table; a restart with the same folder goes on where it stopped."""
    spark = stream.sparkSession
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def close_cycle(stream: DataFrame, folder: str, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each batch goes through all steps; (batch_id, step, code) tells how each went, 0 or 1, and one that fails doesn't
    stop the next. A step's rows of a batch replace those of an earlier attempt at it. Returns the codes.
    """
    spark = stream.sparkSession

    def cycle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        codes = []
        try:
            for name, step in steps.items():
                try:
                    step(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
                    codes.append((batch_id, name, 0))
                except Exception:  # noqa: BLE001  the code reports it
                    codes.append((batch_id, name, 1))
        finally:
            batch.unpersist()
        spark.createDataFrame(codes, "batch_id long, step string, code int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codes/run={batch_id}")

    stream.writeStream.foreachBatch(cycle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/codes").drop("run")
