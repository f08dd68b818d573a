import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pitgrid.llm.pfp import remove_repeats, repeated_windows, window_triggers

from .corpus import edge_docs, empty_docs, small_docs, small_pandas


def plain(docs, length):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] by counting every window."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark):
    docs = small_pandas()
    found = got(remove_repeats(small_docs(spark), 400))
    assert found == plain(zip(docs.doc_id.tolist(), docs.text), 400)
    assert sum(r[2] for r in found) > 0


def test_cut_and_shared_passages(spark):
    """Passages of every length about the limit, at starts, ends and inside; runs of one byte; the same text twice."""
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    p = word(130)
    texts = [word(50) + p[:n] + word(rng.integers(0, 90)) for n in range(36, 130, 5)] + [p, p[20:], "z" * 200, "y" + "z" * 70, None, "", word(39), word(40) * 3]
    texts += [texts[0], word(300) + "É" * 30, "É" * 41]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for reach, hot in ((8, 4000), (20, 4000), (24, 4000), (24, 1), (20, 3)):  # with few allowed, names count as hot
        assert got(remove_repeats(df, 40, reach, hot=hot)) == plain(docs, 40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.text(alphabet="ab\0", min_size=0, max_size=7), st.text(alphabet="ab\0", min_size=12, max_size=12), st.integers(0, 3)), min_size=2, max_size=12))
def test_order_finds_what_counting_finds(entries):
    """Windows of 12 bytes with up to 7 before the trigger: against counting them by group and place of the trigger."""
    entries = sorted(entries, key=lambda x: x[0])
    data, most, least = [], [], []
    for _, before, after, skip in entries:
        low = min(skip, len(before))
        data.append((before + after[: 12 - low]).encode())
        most.append(len(before))
        least.append(low)
    windows = [(i, a, (entries[i][0], a, data[i][most[i] - a : most[i] - a + 12])) for i in range(len(data)) for a in range(least[i], most[i] + 1)]
    seen = Counter(w for _, _, w in windows)
    found = repeated_windows(data, [x[0] for x in entries], np.array(most), np.array(least), 12)
    assert sorted(zip(*(x.tolist() for x in found))) == sorted((i, a) for i, a, w in windows if seen[w] > 1)


@settings(max_examples=60)
@given(st.text(alphabet="ab", min_size=50, max_size=200), st.text(alphabet="abc", max_size=50))
def test_a_window_alone_decides_its_trigger(body, before):
    def triggers(data):
        first, last, at = window_triggers(data, 40, 24)
        return {data[i : i + 40]: int(a) - i for f, e, a in zip(first, last, at) for i in range(f, e + 1)}

    alone, with_more = triggers(body.encode()), triggers((before + body).encode())
    assert all(with_more[w] == o for w, o in alone.items())
    assert all(0 <= o < 24 for o in alone.values())


def test_edge_cases(spark):
    df = edge_docs(spark)
    found = got(remove_repeats(df, 400))
    assert found == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 400)
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_kept_bytes(spark):
    for r in remove_repeats(edge_docs(spark), 400, keep_bytes=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
