"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly, by a seeded hash, into buckets that fit in memory. Pass two permutes each bucket
by Fisher-Yates. Buckets one after the other then are a uniform random order of all records, which is dealt to the
shards in turn, so that shard sizes differ by one record at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pitgrid.llm.common import group_starts, row_hash, small_batches, sorted_groups, stash


def _fisher_yates(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["bucket"]):
            starts = [*group_starts(table, ["bucket"]).tolist(), table.num_rows]
            buckets = table["bucket"].to_numpy()
            for lo, hi in zip(starts, starts[1:]):
                order = np.arange(lo, hi)
                np.random.Generator(np.random.PCG64([seed, int(buckets[lo])])).shuffle(order)  # numpy's is Fisher-Yates
                dealt = table.take(pa.array(order)).append_column("rank_in_bucket", pa.array(np.arange(hi - lo)))
                yield from dealt.combine_chunks().to_batches(max_chunksize=500)

    return run


def _numbered_copies(keyed: DataFrame, hot_rows: int) -> DataFrame:
    """keyed with `copy`: 0, but for keys of more than hot_rows rows, whose rows are collapsed to distinct ones with their
    counts, on the map side already, and dealt out again under numbers of their own. Rows that are wholly alike can't be
    told apart, so which of them has which number doesn't matter."""
    keys = ["order_id", "tie"]
    # by the number of rows, there are fewer than one such key in hot_rows rows
    hot = stash(keyed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(F.col("order_id").alias("hot_id"), F.col("tie").alias("hot_tie")))
    plain = keyed.withColumn("copy", F.lit(0).cast("long"))
    if hot.isEmpty():
        return plain
    is_hot = F.col("order_id").eqNullSafe(F.col("hot_id")) & F.col("tie").eqNullSafe(F.col("hot_tie"))
    distinct = keyed.join(hot, is_hot, "left_semi").groupBy(*keys, "row").agg(F.first("own").alias("own"), F.count("*").alias("n"))
    dealt = distinct.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return plain.join(hot, is_hot, "left_anti").unionByName(dealt.drop("n"))


def external_shuffle(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 24 << 20, hot_rows: int = 10_000) -> DataFrame:
    """All rows and columns of docs (doc_id and text needed), with shard and slot (gapless from 0) added.

    Shards' row counts are at most one apart; seed and rows alone decide the order (buckets are sorted before they are
    permuted, so a task that is run again gives the same). Null texts and ids and repeated rows are dealt like any
    other; an empty table gives an empty one. Columns named shard or slot are replaced. Rows alike in doc_id and text lie
    in one bucket up to hot_rows of them; more are spread over the buckets like any other rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    bytes_ = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(8, -(-bytes_ // bucket_bytes))
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")  # whatever the caller's columns are named
    keyed = docs.select(own, F.col("doc_id").alias("order_id"), F.xxhash64("text").alias("tie"), row_hash(docs).alias("row"))
    by_copy = F.xxhash64(F.lit(seed), "order_id", "tie", F.nullif("copy", F.lit(0)))  # hashing skips nulls
    scattered = _numbered_copies(keyed, hot_rows).withColumn("bucket", F.pmod(by_copy, F.lit(buckets)).cast("long"))
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"))
    sorted_ = scattered.repartition(int(min(buckets, 1 << 16)), "bucket").sortWithinPartitions("bucket", "order_id", "tie", "row", "copy").select("own", "bucket")
    mixed = sorted_.mapInArrow(_fisher_yates(seed), StructType([*sorted_.schema.fields, StructField("rank_in_bucket", LongType())]))
    position = F.col("bucket_start") + F.col("rank_in_bucket")
    return mixed.join(starts, "bucket").select("own.*", F.pmod(position, F.lit(n_shards)).cast("int").alias("shard"), F.floor(position / n_shards).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard to its own folder, its files in slot order; a shard may take many tasks."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
