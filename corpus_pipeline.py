"""A training corpus from the documents table, in five stages that each call one operator.

Each function takes (spark, docs, sf_dir), the documents kept so far, and returns what it keeps; all but the last
return the columns of documents. run() writes each stage's table to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.llm.common import documents, drop_stash, scratch, stash
from pitgrid.llm.crf import keep_good
from pitgrid.llm.fuzzy_lines import dedup_lines, drop_emptied
from pitgrid.llm.harmonic import pack
from pitgrid.llm.pfair import keep_mix, mix_positions
from pitgrid.llm.simhash import keep_one_row_per_class


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labelling reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Like lines go but for the first of each class, and with them documents of which no word is left."""
    kept = drop_emptied(dedup_lines(docs))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return keep_one_row_per_class(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the power 0.7 of their sizes, in the order of their slots; none goes. A table read back has
    lost that order, but it follows from the rows: the next stage asks for it again and packs by it."""
    return keep_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048, numbered in the order of the mix."""
    import public_tokenizers

    return pack(mix_positions(docs), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048, order="mix_position")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Random fields, MinHash and union-find are not for SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stash(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            drop_stash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
