import random
import re

import numpy as np
import pytest

from pitgrid.llm import odd_sketch as O
from pitgrid.llm.common import stash

from ..oracle import differences
from .corpus import SF, edge_docs, empty_docs, small_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows, width=2):
    """All pairs, and a union-find."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(map(tuple, O.near_components(df, **{"width": 2} | options).collect()), key=repr)


def test_against_all_pairs(spark):
    for docs in (small_docs(spark), edge_docs(spark)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert found(docs) == plain(rows)
    assert found(empty_docs(spark)) == []


def test_same_as_sql(spark):
    from pitgrid.llm.queries import op12_oddsketch

    for sf in (SF, "/root/testdata/sf0.01"):
        assert differences(spark, "op12_oddsketch", op12_oddsketch, O.SQL, sf) == ""


def test_pairs_at_the_threshold(spark):
    """Sets of exactly 0.8 and just below it, large and small; a chain of them; a hot bucket of unlike near copies."""
    rnd = random.Random(7)
    rows, i = [], 0
    for n in (8, 9, 18, 80, 90, 400, 900):  # texts of unlike words: one word replaced at an end changes one shingle
        for extra in (-1, 0, 1):
            words = [f"t{i}x{k}" for k in range(n + 1)]
            i += 1
            k = max(1, round(n / 9) + extra)  # k of n shingles replaced: (n - k) / (n + k) >= 0.8 as long as 9 k <= n
            rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[:-k] + [f"z{i}y{j}" for j in range(k)]))]
    base = [f"b{k}" for k in range(120)]
    for c in range(90):  # copies with words replaced: many above and many below the similarity
        words = list(base)
        for _ in range(rnd.randrange(0, 14)):
            words[rnd.randrange(120)] = f"e{c}q{rnd.randrange(9)}"
        rows.append((5000 + c, " ".join(words)))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert found(docs) == want
    assert len({c for _, _, c, _ in want}) > 10
    signed = docs.selectExpr("doc_id", "xxhash64(text) AS th", "text").mapInArrow(O._sign(2), "doc_id long, th long, node long, n_shingles long, bands array<long>, sketch array<long>")
    nodes = stash(signed.dropDuplicates(["node"]))
    one, small = (O.connected_components(O.near_links(nodes, docs, 2, 80, block_rows=b), "a", "b").collect() for b in (500, 7))
    assert sorted(one) == sorted(small) and len(one) > 20


def test_sketches_tell_similarity():
    """No pair at 0.8 is lost to the limit, and pairs at 0.5 are cut off."""
    rng = np.random.default_rng(3)
    limit = O.sketch_limit(0.8)
    for share, inside in ((0.8, True), (0.9, True), (0.5, False)):
        apart = []
        for _ in range(300):
            n = int(rng.integers(20, 300))
            both = round(n * share)
            pool = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = pool[: both + (n - both) // 2], np.concatenate([pool[:both], pool[both + (n - both) // 2 :]])
            s = O.odd_sketches(O.samples_of([a, b]))
            apart.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
        assert all((x <= limit) == inside for x in apart) if inside else sum(x > limit for x in apart) > 290


def test_bands_meet():
    """Of pairs at 0.8, all meet in a band (1.4e-7 are expected not to)."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        keys = O.band_keys(O.samples_of([pool[:45], np.concatenate([pool[:40], pool[45:]])]))
        assert (keys[0] == keys[1]).any()


def test_similarity_below_the_bands_is_refused(spark):
    with pytest.raises(ValueError, match="0.8"):
        O.near_components(small_docs(spark), similarity_percent=70)
