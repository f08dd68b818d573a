import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pitgrid.llm import vector_codes as V

from ..oracle import differences
from .corpus import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    """Row by row, in Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    n = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == n]
    cuts = [n * p // 4 for p in range(5)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cuts, cuts[1:])]
    part = lambda r, p: r[1][cuts[p] : cuts[p + 1]]

    def assign(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for r in kept:
                members.setdefault(assign(part(r, p), books[p])[1], []).append(part(r, p))
            for i, m in members.items():
                books[p][i] = [sum(c) // len(m) for c in zip(*m)]
    found = [[assign(part(r, p), books[p]) for p in range(4)] for r in kept]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, labels[r[2]]) for r, f, e in zip(kept, found, errors)], digest


def check(df, rows):
    want, digest = plain(rows)
    got = V.vector_codes(df).collect()
    assert sorted((tuple(r[:4]) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} <= {digest}
    return got


def test_small_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in t]
    assert len(check(spark.read.parquet(f"{SF}/embeddings.parquet"), rows)) == len(rows)


def test_same_as_sql(spark):
    from pitgrid.llm.queries import op13_codes

    for sf in (SF, "/root/testdata/sf0.01"):
        assert differences(spark, "op13_codes", op13_codes, V.SQL, sf) == ""


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), i % 3 if i % 7 else None) for i in range(400)]
    hot = [0.5, -0.25, 0.0, 1.0, 0.1, 0.2, 0.3, 0.4]
    rows += [(1000 + i, np.float32(hot).tolist(), 9) for i in range(300)]  # one vector, one label, over a third of the rows
    rows += [(5, rows[5][1], 1), (5, rows[6][1], None), (None, rows[7][1], 2), (None, rows[7][1], 2)]
    rows += [(2000, None, 1), (2001, [nan] * 8, 1), (2002, [inf] + [0.0] * 7, 1), (2003, [None] + [0.0] * 7, 1), (2004, [], 1), (2005, [1.0] * 7, 1)]
    schema = SCHEMA + ", error string, codes string, row_id long, own int, pos int"
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], schema)
    assert len(check(df.repartition(5), rows)) == 704
    few = [(3, [1.0, 2.0, 3.0, 4.0, 5.0], None), (1, [1.0, 2.0, 3.0, 4.0, 6.0], None)]  # fewer rows than entries, unequal parts
    assert len(check(spark.createDataFrame(few, SCHEMA), few)) == 2
    for rows in ([], [(1, None, 1)], [(1, [], None)]):
        assert V.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_components_are_exact(spark):
    """Beyond what a double holds, distances are 64-bit integers; beyond BOUND, components are held there."""
    rows = [(i, [float(200_000 + i), -1.0, 3e38, float(-i)], 0) for i in range(300)]
    held = [(i, [v[0], v[1], V.BOUND / 1024, v[3]], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r[:4]) for r in V.vector_codes(df).collect()} == set(plain(held)[0])


def test_codes_lead_back_to_the_codebooks(spark):
    """The error is that of the entries that the codes name, and other columns stay."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("extra", F.lit("kept"))
    coded, books = V.compress_vectors(df)
    for r in coded.collect():
        x = np.floor(np.array(r.own.embedding, np.float64) * 1024).astype(np.int64)
        y = np.concatenate([b[c] for b, c in zip(books, r.codes)])
        assert int(((x - y) ** 2).sum()) == r.error and r.own.extra == "kept"
