"""The numbered queries: thin wrappers that apply an operator to its whole table and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.llm.common import documents


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.imatch import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.crf import quality_verdicts

    return quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.ppm import predict_language

    return predict_language(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.secrets import find_secrets

    return find_secrets(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.pfair import mix

    return mix(documents(spark, sf_dir)).drop("th")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.simhash import simhash_components

    return simhash_components(documents(spark, sf_dir), width=4, radius=4)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.pfp import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=400).withColumn("has_repeats", F.col("n_removed") > 0)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.fuzzy_lines import dedup_lines

    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pitgrid.llm.harmonic import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.external_shuffle import external_shuffle

    shuffled = external_shuffle(documents(spark, sf_dir).select("doc_id", "text"), n_shards=8)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return shuffled.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.word_runs import runs_digest, with_periodic_tails

    return runs_digest(with_periodic_tails(documents(spark, sf_dir)))


def op12_oddsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.odd_sketch import near_components

    return near_components(documents(spark, sf_dir), width=2, similarity_percent=80)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitgrid.llm.vector_codes import vector_codes

    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_imatch": op1_imatch,
        "op2_quality": op2_quality,
        "op3_language": op3_language,
        "op4_mixing": op4_mixing,
        "op5_simhash": op5_simhash,
        "op6_secrets": op6_secrets,
        "op7_repeats": op7_repeats,
        "op8_lines": op8_lines,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "op11_runs": op11_runs,
        "op12_oddsketch": op12_oddsketch,
        "op13_codes": op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    from pitgrid.llm import odd_sketch, vector_codes, word_runs

    return {"op11_runs": word_runs.SQL, "op12_oddsketch": odd_sketch.SQL, "op13_codes": vector_codes.SQL}
