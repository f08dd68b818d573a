"""A paged JSON interface: as files that Spark lists and reads, or as a data source with a fetch of its own, in which a page is
a partition and a task that is lost reads its page again."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds to wait before each new attempt at a page.
WAITS = (5.0, 15.0, 30.0)


class PageFolder(DataSource):
    """format("pitgrid_pages"): option path, a glob of files in a shared folder, each {"error": "0", "fields": [...],
    "rows": [[...]]}; option waits, seconds between attempts. Local paths only, as in tests: a subclass with other pages() and
    fetch() reads from elsewhere, and read_pages() reads files in any store.

    An error code other than "0", other fields than the schema's or a row of another length fail the read; they are
    never taken for an empty page. Values are strings.
    """

    @classmethod
    def name(cls) -> str:
        return "pitgrid_pages"

    def pages(self) -> list[str]:
        import glob

        return sorted(glob.glob(self.options["path"].removeprefix("file:").replace("//", "/")))

    def fetch(self, page: str) -> dict:
        with open(page, encoding="utf-8") as f:
            return json.load(f)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self, schema)


class PageReader(DataSourceReader):
    def __init__(self, source: PageFolder, schema: StructType) -> None:
        self.source, self.fields = source, schema.fieldNames()
        waits = source.options.get("waits")
        self.waits = WAITS if waits is None else tuple(float(w) for w in waits.split(",") if w)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.source.pages()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value
        for wait in (*self.waits, None):
            try:
                answer = self.source.fetch(page)
                break
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)
        if answer.get("error") != "0":
            raise ValueError(f"{page}: error {answer.get('error')}")
        if answer["fields"] != self.fields:
            raise ValueError(f"{page}: fields {answer['fields']}, not {self.fields}")
        for row in answer["rows"]:
            if len(row) != len(self.fields):
                raise ValueError(f"{page}: a row of {len(row)} values")
            yield tuple(row)


def read_pages(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The same pages as files under path, listed and read by Spark, so in any store that Spark reads: rows of strings.

    Fails closed like PageReader: text that is no page, an error code other than "0", other fields or a row of another length
    fail the read and name the file. A page is held whole by one task. No files at all are an error of the path.
    """
    answer = F.from_json("value", "error string, fields array<string>, rows array<array<string>>")
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), answer.alias("a"))
    width = F.lit(len(fields))
    problem = (
        F.when(F.col("a").isNull() | F.col("a.rows").isNull(), "no page").when(~F.col("a.error").eqNullSafe(F.lit("0")), F.concat(F.lit("error "), F.coalesce("a.error", F.lit("missing"))))
        .when(~F.col("a.fields").eqNullSafe(F.array(*[F.lit(f) for f in fields])), "other fields").when(F.exists("a.rows", lambda r: ~F.size(r).eqNullSafe(width)), "a row of another length")
    )
    rows = F.when(problem.isNull(), F.col("a.rows")).otherwise(F.raise_error(F.concat("file", F.lit(": "), problem)).cast("array<array<string>>"))
    return pages.select(F.explode(rows).alias("r")).select(*[F.get("r", F.lit(i)).alias(f) for i, f in enumerate(fields)])
