import importlib
import re
import zlib
from collections import defaultdict

import __spark_entry__
import corpus_pipeline
from pitgrid.llm.crf import base_fails, describe
from pitgrid.llm.pfair import mix_positions
from pitgrid.llm.simhash import similar_components

from .corpus import SF, edge_docs, empty_docs, small_docs, small_pandas
from .test_fuzzy_lines import plain as plain_lines


def exact_firsts(texts):
    """Smallest ids of the classes of 0.8 similarity, of all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = sorted(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").translate(lower).split() for _, t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return {texts[r][0] for r in set(root)}


def test_packed_sequences_follow_the_mix(spark):
    """The number of a sequence grows with the first place of the mix in it; other targets give other sequences."""
    docs = small_docs(spark)
    place = {r.doc_id: r.mix_position for r in mix_positions(docs).collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    first = {}
    for p in pieces:
        first[p.sequence_id] = min(place[p.doc_id], first.get(p.sequence_id, place[p.doc_id]))
    assert sorted(first) == list(range(len(first)))
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    tokens = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert tokens[p.sequence_id] == p.offset
        tokens[p.sequence_id] += p.length
    assert max(tokens.values()) <= 2048
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    early = [d for d in sorted(place, key=place.get)][: len(place) // 3]  # before a source runs out
    sizes = defaultdict(int)
    for d in place:
        sizes[source[d]] += 1
    weight = {s: n**0.7 for s, n in sizes.items()}
    for s in sizes:
        assert abs(sum(source[d] == s for d in early) - len(early) * weight[s] / sum(weight.values())) <= 4 * (2 + len(sizes) / 2)


def test_stages_in_order(spark):
    """Each stage on all that the one before kept, against plain versions."""
    docs = small_docs(spark)
    columns, kept, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == columns
        before, after = kept.collect(), out.collect()
        seen[name] = (before, after)
        kept = spark.createDataFrame(after, docs.schema)
    before, after = seen["quality_rules"]
    assert all(not base_fails(describe(r.text)[0]) for r in after) and 0.6 * len(before) < len(after) < len(before)
    before, after = seen["line_dedup"]
    want = {d: t for d, t in plain_lines([(r.doc_id, r.text) for r in before]).items()}
    whole = {r.doc_id: r.text for r in before}
    want = {d: t for d, t in want.items() if t == whole[d] or t.split()}
    got = {r.doc_id: r.text for r in after}
    assert sum(got.get(d) != t for d, t in want.items()) + len(got.keys() - want.keys()) <= 2
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    assert len({r.doc_id for r in after} ^ exact_firsts([(r.doc_id, r.text) for r in before])) <= 1
    before, after = seen["mix_sources"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0.5 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert tokens == {p.doc_id: p.doc_tokens for p in pieces} and tokens.keys() == {r.doc_id for r in after}


def test_similar_texts_are_one_class(spark):
    docs = small_pandas()
    texts = [(int(d), t) for d, t in zip(docs.doc_id, docs.text) if len(t.split()) > 300][:40]
    edited = []
    for i, (d, t) in enumerate(texts):
        words = t.split(" ")
        for k in range(8, len(words), 45 + i):  # an edit changes five shingles of 45 and more
            words[k] = f"edit{k}"
        edited.append((10_000 + d, " ".join(words)))
    rows = similar_components(spark.createDataFrame(texts + edited, "doc_id long, text string")).collect()
    found = {r.doc_id: r.component_id for r in rows}
    assert sum(found[10_000 + d] == found[d] for d, _ in texts) >= 38
    assert len(exact_firsts(texts + edited) ^ set(found.values())) <= 1


def test_edge_cases(spark):
    labels_dir = SF
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, labels_dir)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, labels_dir).count() >= docs.count()


def test_registered():
    names = [k for k in __spark_entry__.queries() if re.match(r"op\d+_", k)]
    assert [k.split("_")[0] for k in names] == [f"op{n}" for n in range(1, 14)]
    assert "pipeline" in __spark_entry__.queries()
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None
    assert zlib.crc32(b"") == 0
