import hashlib
import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from pitgrid.llm.fuzzy_lines import SIMILARITY, band_keys, dedup_lines, drop_emptied, line_key, shingles, similarity

from .corpus import edge_docs, empty_docs, small_docs, small_pandas


def plain(docs):
    """doc_id -> kept text: all pairs of lines, exactly."""
    lines = [(d, i, line) for d, t in sorted(docs) for i, line in enumerate(t.split("\n")) if line.strip(" \t\x0b\x0c\r")]
    texts = list(dict.fromkeys(x for _, _, x in lines))
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for h in s for j in holders[h] if j < i}:
            if similarity(s, sets[j]) >= SIMILARITY:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    number = {t: find(i) for i, t in enumerate(texts)}
    seen, gone = set(), set()
    for d, i, line in lines:
        if number[line] in seen:
            gone.add((d, i))
        seen.add(number[line])
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_whole_table_against_all_pairs(spark):
    docs = list(zip(*(small_pandas()[c].tolist() for c in ("doc_id", "text"))))
    want = plain(docs)
    got = {r.doc_id: r for r in dedup_lines(small_docs(spark)).collect()}
    differ = [d for d, t in want.items() if got[d].text != t]
    assert len(differ) <= 0.01 * len(docs)  # banding misses a pair of exactly 0.8 once in 200
    assert sum(r.n_removed for r in got.values()) > 50


def test_planted_lines(spark):
    """A line that very many documents share, near copies of another, and lines that are only somewhat alike."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    base = " ".join(word() for _ in range(40))
    docs = [(i, f"common line of all\n{' '.join(word() for _ in range(20))}\n\n{base[:-1]}{i % 7}\nx") for i in range(300)]
    half = base.split(" ")
    docs.append((1000, " ".join(half[:20] + [word() for _ in range(20)])))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain(docs)
    assert got[0] == docs[0][1] and got[1000] == docs[-1][1]
    assert all(got[i].count("\n") == 1 for i in range(1, 300))  # the own line and the empty one


@given(st.lists(st.text(alphabet="abé🙂 ", min_size=1, max_size=30), min_size=1, max_size=12))
def test_bands_depend_on_the_line_alone(lines):
    together = band_keys(lines)
    for i, line in enumerate(lines):
        assert np.array_equal(together[i], band_keys([line])[0])


def test_bands_find_like_lines():
    rng = np.random.default_rng(12)
    met = {0.8: 0, 0.9: 0}
    for want in met:
        for _ in range(150):
            n = 400
            edits = round(n * (1 - want) / (1 + want) / 8)  # an edit changes eight shingles
            a = rng.integers(0, 60_000 - 2048, n).astype(np.int32) + 256
            b = a.copy()
            b[rng.choice(np.arange(8, n - 8, 16), edits, replace=False)] = 65
            x, y = ("".join(map(chr, v)).replace("\n", " ") for v in (a, b))
            x, y = (s.encode("utf-8", "replace").decode() for s in (x, y))
            met[want] += bool((band_keys([x])[0] == band_keys([y])[0]).any())
    assert met[0.8] >= 145 and met[0.9] == 150


def test_line_keys_are_sparks(spark):
    lines = ["", "a", "é🙂 line", "x" * 100]
    df = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("line", "xxhash64(line) k")
    assert {r.line: r.k % 2**64 for r in df.collect()} == {x: line_key(x) for x in lines}


def test_edge_cases(spark):
    docs = edge_docs(spark)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == 12 and {(r.did, r.th, r.gone, r.own) for r in rows} == {(0, 1, 2, 3)}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].text is None and by_id[1].n_lines == 0
    assert by_id[2].text == "" and by_id[3].n_removed == 0
    assert by_id[4].text == "one" and by_id[5].text == "" and by_id[5].n_removed == 1
    assert by_id[9].text == "È é ß 漢字 🙂 ends\n\n" and sum(r.doc_id == 9 for r in rows) == 2
    assert 0 < by_id[6].n_removed < by_id[6].n_lines and by_id[7].text == ""
    kept = {r.doc_id for r in drop_emptied(out).collect()}
    assert {1, 2, 3, 4, 6, 9} <= kept and not {5, 7} & kept
    assert dedup_lines(empty_docs(spark)).count() == 0


def test_long_texts_are_linear(spark):
    """A text of 400,000 lines, most of them removed, 40,000 kept: many minutes, if each line cost a look at all others."""
    lines = [hashlib.sha256(str(i if i < 40_000 else i % 1000).encode()).hexdigest() for i in range(400_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.monotonic()
    (r,) = dedup_lines(docs).collect()
    assert (r.n_lines, r.n_removed) == (400_000, 360_000) and r.text == "\n".join(lines[:40_000])
    assert time.monotonic() - began < 150


def test_both_ways_to_link_give_the_classes_of_all_pairs():
    import random

    from pitgrid.llm import fuzzy_lines as L

    rng = random.Random(5)
    for n in (1, 2, 40, 150):
        stems = ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 120))) for _ in range(max(1, n // 6))]
        texts = []
        for _ in range(n):
            line = list(rng.choice(stems))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            texts.append("".join(line))
        sets = [L.shingles(x) for x in texts]
        keys = [i * 7 - 100 for i in range(n)]

        def classes(links):
            root = list(range(n))
            for a, b in links:
                a, b = root[keys.index(a)], root[keys.index(b)]
                root = [a if r == b else r for r in root]
            return [root.index(r) for r in root]

        pairs = [(keys[i], keys[j]) for i in range(n) for j in range(i) if L.similarity(sets[i], sets[j]) >= L.SIMILARITY]
        assert classes(pairs) == classes(L.links_by_sets(keys, sets)) == classes(L.links_by_counts(keys, sets))
        assert set(L.links_by_counts(keys, sets)) <= set(pairs) and set(L.links_by_sets(keys, sets)) <= set(pairs)
