import re

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from pitgrid.llm.common import meet_in_blocks
from pitgrid.llm.components import connected_components
from pitgrid.llm.simhash import MISSED, BKTree, fingerprint, fingerprint_links, keep_one_row_per_class, similar_components, simhash_components, tables_for

from .corpus import edge_docs, empty_docs, small_docs, small_pandas


def plain_fingerprint(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    """doc index -> least index reachable."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark):
    docs = small_pandas().sort_values("doc_id").reset_index(drop=True)
    fps = [plain_fingerprint(t, 4) for t in docs.text]
    roots = plain_components(fps, 4)
    expected = {int(d): (f"{f:016x}", int(docs.doc_id[r])) for d, f, r in zip(docs.doc_id, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(small_docs(spark), 4, 4).collect()}
    assert got == expected
    assert len({c for _, c in got.values()}) < len(got)  # there are copies


@given(st.text(alphabet="aB cÉ\n x", max_size=60), st.integers(1, 5))
def test_fingerprint(text, width):
    assert fingerprint(text, width) == plain_fingerprint(text, width)


@given(st.lists(st.integers(0, 2**12), min_size=1, max_size=60), st.integers(0, 2**12), st.integers(0, 4))
def test_bk_tree(values, asked, radius):
    tree = BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.within(asked, radius)) == sorted({v for v in values if (v ^ asked).bit_count() <= radius})


def test_links_lose_nothing_in_large_shards(spark):
    """A dense ball of fingerprints and small blocks: shards meet chunk by chunk, the classes stay whole."""
    rng = np.random.default_rng(3)
    values = {0}
    for base in (0, 0x0F0F_0F0F_0F0F_0F0F):
        for _ in range(60):
            v = base
            for b in rng.integers(0, 64, 3):
                v ^= 1 << int(b)
            values.add(v)
    values |= {int(x) for x in rng.integers(0, 2**63, 60)}
    values = sorted(values)
    fps = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    root = {r.node: r.root for r in connected_components(fingerprint_links(fps, 4, block_rows=7), "a", "b").collect()}
    got = [root.get(v - 2**64 if v >> 63 else v, v - 2**64 if v >> 63 else v) for v in values]
    plain = plain_components(values, 4)
    pairs = {(p, g) for p, g in zip(plain, got)}
    assert len(pairs) == len({p for p, _ in pairs}) == len({g for _, g in pairs})


def test_every_pair_of_a_bucket_meets(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 23), (2, 1), (3, 4)) for i in range(n)], "k int, i long")
    met = meet_in_blocks(df, ["k"], "i", 5).collect()
    blocks = {}
    for r in met:
        blocks.setdefault((r.k, r.side_a, r.side_b), []).append(r)
    pairs = {(k, x.i, y.i) for (k, a, b), rs in blocks.items() for x in rs for y in rs if x.i < y.i and (a == b or x.side != y.side)}
    assert pairs == {(k, i, j) for k, n in ((1, 23), (3, 4)) for i in range(n) for j in range(i + 1, n)}


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_edge_cases(spark):
    got = {}
    for r in simhash_components(edge_docs(spark), 4, 4).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert got[1] == got[2] == got[3] == [("0" * 16, 1)]  # null, empty and blank texts
    assert got[4][0][1] == got[5][0][1] == 4
    assert got[6][0][1] == got[7][0][1] == got[8][0][1] == 6
    assert len(got[9]) == 2 and {c for _, c in got[9]} == {9}
    assert sorted(c or 0 for _, c in got[None]) == [0, 1]
    assert simhash_components(empty_docs(spark)).count() == 0


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    docs = edge_docs(spark)
    kept = keep_one_row_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [(0, "a row wit"), (1, ""), (4, "one"), (6, "word0 and"), (9, "È é ß 漢字 ")]
    long = " ".join(f"w{i}" for i in range(99))
    twice = spark.createDataFrame([(5, "one text"), (5, long), (7, long), (None, "alone"), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in keep_one_row_per_class(twice).collect()) == [(0, "alone"), (5, "one text"), (5, long)]


def test_values_in_other_columns_make_another_row(spark):
    """A hash that skips nulls would take these for one row, and the document with the text would be lost."""
    rows = [(1, None, "some text", "a", {"k": 1}), (1, "some text", None, "a", None), (1, "some text", None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, more map<string,int>")
    assert sorted((r.text or "", r.lang or "") for r in keep_one_row_per_class(docs).collect()) == [("", "some text"), ("some text", "")]


def test_raw_near_copies_against_all_pairs(spark):
    """The whole table before any line is removed: pairs at 0.8 or more are in one class, by exact shingles."""
    from .corpus import small_pandas

    docs = small_pandas()
    texts = [(int(d), t) for d, t in zip(docs.doc_id, docs.text) if t]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts if (w := t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split())}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(pairs) > 5 and sum(found[a] != found[b] for a, b in pairs) <= 0.05 * len(pairs)


def test_classes_are_those_of_exact_similarity(spark):
    """Against all pairs: copies on either side of 0.8, some (0.7) within the bits but not alike."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        texts.append(" ".join(words))
        for gap in (30, 40, 47, 70):  # one edit changes five shingles: similarity 0.71, 0.78, 0.81, 0.87
            texts.append(" ".join(f"e{k}x{gap}x{i}" if i % gap == gap // 2 else w for i, w in enumerate(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i - i % 5, i):  # texts of different k share nothing
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] != root[i] for i in got) <= 2 and len(set(root)) > 120


def test_chance_to_meet_does_not_fall_with_the_corpus():
    for n in (1000, 40_000, 250_000, 2_000_000, 11_000_000):
        tables, bits = tables_for(n, 0.8)
        assert (1 - (1 - np.arccos(1.6 / 1.8) / np.pi) ** bits) ** tables <= MISSED * 1.0001
