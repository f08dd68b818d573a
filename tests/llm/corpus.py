"""Inputs of the corpus operators' tests: the smallest tables, and a fixture of edge cases."""

import pandas as pd
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "".join(f"word{i * i % 977} and {i}\n" if i % 9 == 0 else f"word{i * i % 977} " for i in range(9000))
EDGE = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", None, "a", 7),
    (4, "one", "en", None, 3),
    (5, "one", "en", "b", 3),
    (6, LONG, "de", "b", len(LONG)),
    (7, LONG, "de", "b", len(LONG)),
    (8, LONG[:-40] + "an edit at the end", "de", "a", 0),
    (9, "È é ß 漢字 🙂 ends\nÈ é ß 漢字 🙂 ends\n\n", "fr", "c", 0),
    (9, "È é ß 漢字 🙂 ends\nÈ é ß 漢字 🙂 ends\n\n", "fr", "c", 0),
    (None, "a row without an id", None, None, None),
    (None, None, None, None, None),
]


def edge_docs(spark):
    """Nulls, empty, blank, repeated, tied, very long rows; extra columns whose names clash with inner ones."""
    clashing = ("did", "th", "gone", "own", "mix_at", "slot", "block", "bucket_start", "tie", "source_key", "root", "line", "_row_key")
    extra = [(*r, "x", 1, 2, 3, "y", *range(len(clashing))) for r in EDGE]
    return spark.createDataFrame(extra, SCHEMA + ", name string, n long, bucket long, shard int, spans string, " + ", ".join(f"{c} long" for c in clashing))


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def small_pandas() -> pd.DataFrame:
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


def rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)
