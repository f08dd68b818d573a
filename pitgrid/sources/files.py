"""Text tables, sealed snapshots and reports: what is read is checked, what is written is never overwritten."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pitgrid.operators.ledger import content_hash


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in
    tests; elsewhere it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pitgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header that must name exactly these columns; every value is a string, an empty one is ""."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", nullValue="\0", emptyValue="", quote='"', escape='"', encoding="UTF-8").fillna("")


def write_text_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of these columns in this order, nulls as ""; fails if the path exists."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    text.write.mode("errorifexists").csv(path, header=True, emptyValue="", quote='"', escape='"')


def key_from_path(pattern: str) -> Column:
    """The key that a file's name holds, such as a six-digit code."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def seal(df: DataFrame, path: str) -> DataFrame:
    """Write df as a new Parquet table and beside it the manifest of its files: rows and a content hash that no order
    of rows changes. Returns the manifest. The hash is summed by Spark a file, so no file passes through one process.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    _contents(spark, path).write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    data = spark.read.parquet(f"{path}/data")
    row = content_hash(*data.columns)
    return data.select("_metadata.file_name", "_metadata.file_size", row.alias("h")).groupBy("file_name").agg(
        F.count("*").alias("n_rows"), F.first("file_size").alias("n_bytes"), F.expr("bit_xor(h)").alias("row_xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("row_sum"))


def check_seal(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, problem): files that the manifest and the folder don't agree on. Files without rows hold nothing to seal."""
    now, then = _contents(spark, path).alias("a"), spark.read.parquet(f"{path}/manifest").alias("b")
    values = ("n_rows", "n_bytes", "row_xor", "row_sum")
    differs = ~F.struct(*[F.col(f"a.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in values]))
    both = now.join(then, F.col("a.file_name") == F.col("b.file_name"), "full")
    problem = F.when(F.col("a.file_name").isNull(), "MISSING").when(F.col("b.file_name").isNull(), "NOT_IN_MANIFEST").when(differs, "CONTENT_DIFFERS")
    return both.select(F.coalesce("a.file_name", "b.file_name").alias("file_name"), problem.alias("problem")).where("problem is not null")


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """The table, if it is as it was sealed."""
    if bad := check_seal(spark, path).take(1):
        raise ValueError(f"{path} is not as sealed: {bad[0].file_name} {bad[0].problem}")
    return spark.read.parquet(f"{path}/data")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256) of whole evidence files (documents and pages; a file is one row)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def still_to_fetch(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose result is not there with the same key, size and hash."""
    return wanted.join(have, keys, "left_anti")


def identity(*parts: Column) -> Column:
    """One hash of named parts."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def publish_once(report: DataFrame, registry: str) -> DataFrame:
    """Append the rows of report whose column identity the registry doesn't hold; returns the registry. One writer."""
    spark = report.sparkSession
    new = report.dropDuplicates(["identity"])
    new.limit(0).write.mode("append").parquet(registry)
    known = spark.read.schema(report.schema).parquet(registry).select("identity")
    new.join(known, "identity", "left_anti").select(*report.columns).write.mode("append").parquet(registry)
    return spark.read.schema(report.schema).parquet(registry)


def markdown_rows(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """A line a row: formats name the columns and how to show each (percent, number or text); null is a dash."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        text = F.format_string("%.2f%%", c.cast("double") * 100) if kind == "percent" else F.format_string("%.4f", c.cast("double")) if kind == "number" else c.cast("string")
        return F.when(c.isNull(), "—").otherwise(text)

    return df.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *[shown(k, v) for k, v in formats.items()]), F.lit(" |")).alias("line"))


def rows_of_entries(raw: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows under the code that is in force: entries (source_code, code, basis, start, end) rename the rows of their
    dates; a row that no entry covers, or of another basis, is marked. _source_code keeps the code of the source.
    """
    r, e = raw.alias("r"), F.broadcast(entries.alias("e"))  # entries come from a configuration, some a code
    inside = (F.col("r.code") == F.col("e.source_code")) & F.col("r.trade_date").between(F.col("e.start"), F.col("e.end"))
    problem = F.when(F.col("e.code").isNull(), "OUTSIDE_ENTRIES").when(F.col("r.basis") != F.col("e.basis"), "WRONG_BASIS").otherwise("")
    rest = [F.col(f"r.{c}") for c in raw.columns if c != "code"]
    return r.join(e, inside, "left").select(F.coalesce("e.code", "r.code").alias("code"), F.col("r.code").alias("_source_code"), *rest, problem.alias("problem"))


def rule_rows(raw: DataFrame) -> DataFrame:
    """Typed rules of (code, trade_date) from strings, with the first reason to refuse a row ("" if none)."""
    whole = lambda c: F.col(c).rlike(r"^[0-9]{1,9}$")
    price = lambda c: F.expr(f"try_cast({c} as decimal(18,4))")
    day = F.when(F.col("trade_date").rlike(r"^\d{4}-\d\d-\d\d$"), F.expr("try_cast(trade_date as date)"))
    fields = ("code", "trade_date", "lower", "upper", "tradable", "minimum", "step")
    times = F.count("*").over(W.partitionBy("code", "trade_date"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.least(*[F.length(F.coalesce(c, F.lit(""))) for c in fields]) == 0, "MISSING_FIELD")
        .when(~F.col("code").rlike(r"^\d{6}$"), "BAD_CODE").when(day.isNull(), "BAD_DATE").when(times > 1, "DUPLICATE_KEY")
        .when(no(price("lower") > 0) | no(price("upper") >= price("lower")), "BAD_LIMITS").when(~F.col("tradable").isin("0", "1"), "BAD_TRADABLE")
        .when(~whole("minimum") | ~whole("step"), "BAD_QUANTITY").when((F.col("minimum").cast("int") <= 0) | (F.col("step").cast("int") <= 0), "BAD_QUANTITY").otherwise("")
    )
    return raw.select("code", day.alias("trade_date"), price("lower").alias("lower"), price("upper").alias("upper"), (F.col("tradable") == "1").alias("tradable"),
                      F.expr("try_cast(minimum as int)").alias("minimum"), F.expr("try_cast(step as int)").alias("step"), reason.alias("reason"))
