from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pitgrid.llm.external_shuffle import external_shuffle, write_shards

from .corpus import edge_docs, empty_docs, small_docs


def check(rows, n_shards):
    shards = Counter(r.shard for r in rows)
    assert max(shards.values()) - min(shards.get(i, 0) for i in range(n_shards)) <= 1
    for s, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_whole_table(spark):
    docs = small_docs(spark)
    rows = external_shuffle(docs, bucket_bytes=1 << 16).collect()
    check(rows, 8)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    again = external_shuffle(docs.repartition(5), bucket_bytes=1 << 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    other = external_shuffle(docs, seed=18, bucket_bytes=1 << 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in other} != {(r.doc_id, r.shard, r.slot) for r in rows}


def test_order_is_unlike_the_input(spark):
    df = spark.range(4000).selectExpr("id doc_id", "cast(id as string) text")
    rows = external_shuffle(df, n_shards=4, bucket_bytes=1 << 15).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    near = sum(abs(a - b) < 40 for a, b in zip(order, order[1:]))
    assert near < 200  # 80 expected of a uniform order


def test_edge_cases_and_files(spark, tmp_path):
    df = edge_docs(spark)
    out = external_shuffle(df, n_shards=3)
    rows = out.collect()
    check(rows, 3)
    assert Counter((r.doc_id, r.text, r.name) for r in rows) == Counter((r.doc_id, r.text, r.name) for r in df.collect())
    assert external_shuffle(empty_docs(spark)).count() == 0
    write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in rows)


def test_same_as_a_plain_shuffle_of_the_buckets(spark):
    """Bucket by bucket: sort, permute by Fisher-Yates under the bucket's seed, and deal the rows to the shards in turn."""
    docs = small_docs(spark)
    got = {r.doc_id: (r.shard, r.slot) for r in external_shuffle(docs, bucket_bytes=1 << 12).collect()}
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("h"), (F.octet_length("text") + 64).alias("n")).collect()
    n_buckets = max(8, -(-sum(r.n for r in keyed) // (1 << 12)))
    buckets = defaultdict(list)
    for r in keyed:
        buckets[r.h % n_buckets].append((r.doc_id, r.tie))
    order = []
    for b in sorted(buckets):
        at = np.arange(len(buckets[b]))
        np.random.Generator(np.random.PCG64([17, b])).shuffle(at)
        rows = sorted(buckets[b])
        order += [rows[i][0] for i in at]
    assert len(buckets) > 8 and got == {doc_id: (i % 8, i // 8) for i, doc_id in enumerate(order)}


def test_rows_alike_are_spread_over_the_buckets(spark):
    alike = spark.range(3000).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "cast(id % 2 as int) more")
    docs = alike.unionByName(spark.range(500).selectExpr("id doc_id", "'t' text", "0 more"))
    rows = external_shuffle(docs, n_shards=4, bucket_bytes=1 << 14, hot_rows=100).collect()
    check(rows, 4)
    assert Counter((r.doc_id, r.text, r.more) for r in rows) == Counter((r.doc_id, r.text, r.more) for r in docs.collect())
    order = sorted(rows, key=lambda r: (r.slot, r.shard))
    runs = max(len(x) for x in "".join("." if r.doc_id is None else "#" for r in order).split("#"))
    assert runs < 100  # 3,000 in a row where they lie in one bucket
    again = external_shuffle(docs.repartition(7), n_shards=4, bucket_bytes=1 << 14, hot_rows=100).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
