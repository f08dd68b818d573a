import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from pitgrid.llm.ppm import ORDER, code_lengths, predict_language, train

from .corpus import SF, edge_docs, empty_docs


def plain_bits(model, lang, text):
    """Byte by byte, from dictionaries: escapes of method C with exclusion."""
    nodes = defaultdict(Counter)
    for g, n in zip(*(x.tolist() for x in model.counts[lang])):
        s = g.to_bytes(ORDER + 1, "big")
        for k in range(ORDER + 1):
            nodes[s[ORDER - k : ORDER]][s[ORDER]] += n

    def distribution(ctx):
        below = distribution(ctx[1:]) if ctx else [1 / 256] * 256
        node = nodes.get(ctx)
        if not node:
            return below
        total, left = sum(node.values()), sum(p for s, p in enumerate(below) if s not in node)
        escape = len(node) / (total + len(node)) if left > 0 else 0.0
        return [node[s] / total * (1 - escape) if s in node else escape * below[s] / left for s in range(256)]

    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    data = (b" " * ORDER + text.encode()).translate(fold)
    bits = 0.0
    for i in range(ORDER, len(data)):
        p = distribution(data[i - ORDER : i])
        assert abs(sum(p) - 1) < 1e-9
        bits -= math.log2(p[data[i]])
    return bits


def test_code_lengths_are_exact(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("le chat é", "fr"), ("THE END", "en"), ("ça va, le roi", "fr")] * 3)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    trees = model.trees()
    for text in ["the chat", "zebra é 漢", "", "a", "le", "the the the the", "\x00\x7f"]:
        assert np.allclose(code_lengths(trees, text), [plain_bits(model, k, text) for k in range(2)], rtol=1e-9)
    for tree in trees:
        assert sum(map(len, tree.contexts)) <= sum(map(len, tree.grams)) <= (ORDER + 1) * len(tree.grams[ORDER])


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in predict_language(docs).collect()}
    truth = docs.collect()
    assert len(got) == len(truth)
    for r in truth:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in truth if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) > 0.99 * len(held)
    for short, long in ((0, 150), (150, 600), (600, 10**6)):
        part = [r for r in held if short <= len(r.text) < long]
        assert sum(got[r.doc_id].lang_pred == r.lang for r in part) >= 0.97 * len(part)


def test_held_out_rows_and_metadata_teach_nothing(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    twisted = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a = {tuple(r) for r in predict_language(docs).collect()}
    assert a == {tuple(r) for r in predict_language(twisted).collect()}


def test_edge_cases(spark):
    got = predict_language(edge_docs(spark)).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3))
    assert by_id[6].lang_pred == "de" and 0 <= by_id[6].score <= 1
    assert predict_language(empty_docs(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in predict_language(nothing).collect()] == [("und", 0.0)]
