import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pitgrid.llm import word_runs as R

from ..oracle import differences
from .corpus import SF, edge_docs, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, min_length=6, min_exponent=4):
    """All runs, from all periods and places."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    start, length, period = best or (None, None, None)
    milli = 1000 * length // period if best else None
    return doc_id, len(runs), start, length, period, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_of_small_alphabets(texts, least):
    ids = [x + 3 * t for t, text in enumerate(texts) for x in text]
    cuts = np.cumsum([0, *map(len, texts)]).tolist()
    assert R.runs_of(np.array(ids, np.int64), cuts, *least) == [plain(t, *least) for t in texts]


def test_repetitive_words():
    """Fibonacci words, powers inside powers, copies of periodic stretches: copies inside blocks and at their borders."""
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    inner = [0, 1] * 5 + [2]
    texts = [b, [0] * 500, inner * 9 + [3] + inner * 4, ([0] * 7 + [1]) * 20 + [2] + ([0] * 7 + [1]) * 21, [5] + [0] * 6 + [6, 7] + [5] + [0] * 6 + [6, 8]]
    for text in texts:
        for least in ((6, 4), (2, 2)):
            assert R.runs_of(np.array(text, np.int64), [0, len(text)], *least) == [plain(text, *least)]


def test_suffix_order_and_factors():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = rng.integers(0, 2, int(rng.integers(1, 80)))
        places = R.Places(x)
        t = x.tolist()
        assert places.order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        length, source = places.previous_factors()
        for i in range(len(t)):
            agree = [next((k for k in range(len(t) - i) if t[i + k] != t[j + k]), len(t) - i) for j in range(i)]
            assert length[i] == max(agree, default=0)
            assert not length[i] or agree[source[i]] == length[i]


def test_same_as_sql(spark):
    from pitgrid.llm.queries import op11_runs

    assert differences(spark, "op11_runs", op11_runs, R.SQL, SF) == ""


def test_query_against_every_period(spark):
    """Every row of the smallest table and of the edge cases, ids whose texts get a periodic tail among them."""
    edge = edge_docs(spark)
    more = [(i, " ".join(f"w{k % (i % 7 + 1)}" for k in range(i)) + " end \t x") for i in range(150)]
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge, spark.createDataFrame(more, "doc_id long, text string")):
        rows = docs.select("doc_id", "text").collect()
        want = sorted((plain_digest(r.doc_id, r.text) for r in rows if r.text is None or len(r.text) < 20000), key=repr)
        short = docs.where("text is null or length(text) < 20000")
        got = sorted((tuple(r) for r in R.runs_digest(R.with_periodic_tails(short)).collect()), key=repr)
        assert got == want
    assert R.runs_digest(R.with_periodic_tails(empty_docs(spark))).collect() == []
    assert R.runs_digest(R.with_periodic_tails(edge)).count() == edge.count()


def test_very_long_text(spark):
    """300,000 words with one period of 60,000 and many short ones."""
    part = [f"w{i * 7919 % 60013}" for i in range(59_000)] + ["again"] * 1000
    docs = spark.createDataFrame([(1, " ".join(part * 5))], "doc_id long, text string")
    (r,) = R.periodic_runs(docs).collect()
    assert [tuple(x) for x in r.runs] == sorted([(0, 300_000, 60_000), *[(60_000 * k + 59_000, 1000, 1) for k in range(5)]])
    assert r.collapsed == " ".join(part[:59_001])
