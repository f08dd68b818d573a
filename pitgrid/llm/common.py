"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in
    tests; elsewhere executors would not see such a folder, and it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pitgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside are deleted at the end, unless they are kept: nothing may read them lazily after that."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            _delete(spark, path)


def stash(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a stashed table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stash-" in path and path.split("/stash-")[0].split(":")[-1].lstrip("/") == root.split(":")[-1].lstrip("/"):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts can be long: keep the Arrow batches handed to Python to a bounded number of rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut rows that arrive sorted by keys into tables of whole groups; only the open group waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if table.num_rows == 0:
            continue
        last = group_starts(table, keys)[-1]
        if last:
            yield table.slice(0, int(last))
        rest = table.slice(int(last))
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets at which a new key begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        v = table[key].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def meet_in_blocks(df: DataFrame, keys: list[str], item: str, block_rows: int) -> DataFrame:
    """Let every two rows of a bucket meet without gathering a large bucket in one task.

    Buckets of one row go. A bucket of more than block_rows rows is dealt into chunks by a hash of item, and each
    chunk is sent to every pair of chunks that it belongs to; columns side_a <= side_b name the pair, side the row's own.
    Counting is pre-aggregated, so a hot key costs no more than any other.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("bucket_n")).where("bucket_n > 1")
    joined = df.join(sizes, keys)
    chunks = F.ceil(F.col("bucket_n") / block_rows)
    return (
        joined.withColumn("chunks", chunks)
        .withColumn("side", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
        .withColumn("side_a", F.least("side", "other"))
        .withColumn("side_b", F.greatest("side", "other"))
        .drop("bucket_n", "chunks", "other")
    )


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], rows: int, share: float = 1 / 1000) -> DataFrame:
    """left (a stashed table of `rows` rows) joined with right, which is unique by keys. The rows of a key with more than
    `share` of all rows are dealt, by a hash of the columns `spread`, to salts, and right's row goes to each of them; there
    are fewer than 1 / share such keys, and they alone are broadcast."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("key_rows")).where(F.col("key_rows") > share * rows)
    hot = F.broadcast(stash(counts.select(*keys, F.ceil(F.col("key_rows") / (share * rows)).cast("int").alias("salts"))))
    salted = left.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    spread_out = right.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(spread_out.hint("merge"), [*keys, "salt"]).drop("salt")


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row that tells which values are null: xxhash64() alone skips nulls, so rows whose values stand in other
    columns would hash alike. Values of nested types are hashed as JSON, nulls included, as maps can't be hashed."""
    parts = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        nested = field.dataType.typeName() in ("array", "map", "struct")
        parts += [c.isNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c]
    return F.xxhash64(*parts)


def global_rank(df: DataFrame, groups: list[str], order: list[str], rows_per_bucket: int = 20_000, n_rows: int | None = None) -> DataFrame:
    """Add rank_in_group (from 0) in the order of the columns `order`, of which the first is a uniform long hash.

    A window over a whole group would put a hot group into one task. Here the hash's range is cut into buckets, rows are
    ranked within (group, bucket), and a prefix sum over the few bucket counts gives the start of each bucket.
    """
    n_rows = df.count() if n_rows is None else n_rows
    buckets = max(16, min(1 << 20, n_rows // rows_per_bucket))
    span = (1 << 63) // buckets + 1
    marked = df.withColumn("rank_bucket", F.expr(f"shiftright({order[0]}, 1) + {1 << 62}").cast("long"))
    marked = marked.withColumn("rank_bucket", F.floor(F.col("rank_bucket") / F.lit(span)).cast("int"))
    from pyspark.sql import Window as W

    sizes = marked.groupBy(*groups, "rank_bucket").agg(F.count("*").alias("bucket_rows"))
    before = W.partitionBy(*groups).orderBy("rank_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("bucket_start", F.coalesce(F.sum("bucket_rows").over(before), F.lit(0))).drop("bucket_rows")
    inside = W.partitionBy(*groups, "rank_bucket").orderBy(*order)
    ranked = marked.withColumn("rank_inside", F.row_number().over(inside) - 1)
    same = [ranked[g].eqNullSafe(starts[g]) for g in [*groups, "rank_bucket"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ranked.join(starts, cond, "left")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("rank_inside") + F.col("bucket_start")).cast("long").alias("rank_in_group"))
