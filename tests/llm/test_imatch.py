import hashlib
import math
import re

import xxhash
from pyspark.sql import functions as F

from pitgrid.llm.imatch import DIGITS, DRAWS, DRAWS_A_HASH, MAX_IDF, MIN_IDF, SHARES, STRIDE, fingerprint_edits, lexicon, likeness

from .corpus import edge_docs, empty_docs, small_docs, small_pandas


def plain_terms(text):
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower(), flags=re.ASCII) if w]
    return {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}


def plain_lexicon(texts):
    df = {}
    for t in texts:
        for h in set(plain_terms(t).values()):
            df[h] = df.get(h, 0) + 1
    lo, hi = math.ceil(len(texts) * math.exp(-MAX_IDF)), math.floor(len(texts) * math.exp(-MIN_IDF))
    return {h for h, n in df.items() if lo <= n <= hi}


def hash_of(numbers):
    """Spark's xxhash64() of an array of longs or of one, unsigned: each element's hash seeds the next's."""
    seed = 42
    for x in numbers:
        seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - 2**64 if x >> 63 else x


def plain_fingerprint(text, band):
    own = set(plain_terms(text).values())
    used = own & band

    def digits(hashes):
        if not hashes:
            return "0" * DIGITS
        ordered = sorted(hashes, key=signed)
        return format(signed(hash_of(ordered)) % (16**DIGITS - 1) + 1, f"0{DIGITS}x")

    halves = [used, {hash_of([h]) for h in used}]
    subset = lambda k, n: {h for h in halves[k // DRAWS_A_HASH] if (h >> STRIDE * (k % DRAWS_A_HASH)) % n == 0}
    return "".join(digits(subset(k, n)) for n in SHARES for k in range(DRAWS)) + digits(own)


def plain_likeness(a, b):
    parts = lambda f: [f[i : i + DIGITS] for i in range(0, len(f), DIGITS)]
    a, b, none = parts(a), parts(b), "0" * DIGITS
    used = same = 0
    for i in range(len(SHARES)):
        pairs = [(x, y) for x, y in zip(a[i * DRAWS : (i + 1) * DRAWS], b[i * DRAWS : (i + 1) * DRAWS]) if x != none or y != none]
        if len(pairs) < DRAWS or i == len(SHARES) - 1:
            used += len(pairs)
            same += sum(x == y for x, y in pairs)
    if a[-1] == b[-1] == none:
        return 1.0
    return (same + (a[-1] == b[-1])) / (used + 1)


def edits(docs):
    """doc_id -> (n_chars, edited text), next doc_id; docs: (doc_id, text) without repeats."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (d, t), (e, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        out[d] = (len(t), t[: len(t) - k] + u[:k], e)
    return out


def test_whole_table_against_a_plain_version(spark):
    docs = list(zip(*(small_pandas()[c].tolist() for c in ("doc_id", "text"))))
    want = edits(docs)
    band = plain_lexicon([t for _, t in docs])
    own = {d: plain_fingerprint(t, band) for d, t in docs}
    got = {r.doc_id: r for r in fingerprint_edits(small_docs(spark)).collect()}
    assert got.keys() == want.keys()
    for d, _ in docs:
        r = got[d]
        n, edited, after = want[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own[d], plain_fingerprint(edited, band))
        assert math.isclose(r.near_edited, plain_likeness(r.fingerprint, r.edited_fingerprint))
        assert math.isclose(r.near_next, plain_likeness(own[d], own[after]))
    apart = [r for r in got.values() if r.near_next < 1]
    assert sum(r.near_edited > r.near_next for r in apart) >= 0.97 * len(apart)
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(plain_terms(t)) for _, t in docs})


def test_lexicon_is_the_band(spark):
    row = lexicon(small_docs(spark)).first()
    assert {t % 2**64 for b in row.lexicon for t in b} == plain_lexicon(small_pandas().text.tolist())
    assert all(t % len(row.lexicon) == i for i, b in enumerate(row.lexicon) for t in b)


def test_likeness(spark):
    size = DRAWS * len(SHARES)
    none, one = "0" * DIGITS, "000a"
    a = [one] * 4 + [none] * (size - 4) + [one]
    b = [one] * 3 + ["000b"] + [one] + [none] * (size - 5) + ["000b"]
    nothing = [none] * (size + 1)
    rare = [none] * size + [one]
    cases = [(a, a, 1.0), (a, b, 3 / 6), (nothing, nothing, 1.0), (a, nothing, 0.0), (rare, rare, 1.0), (rare, rare[:-1] + ["000b"], 0.0)]
    df = spark.createDataFrame([("".join(x), "".join(y)) for x, y, _ in cases], "a string, b string")
    assert [r[0] for r in df.select(likeness(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in cases]


def test_edge_cases(spark):
    got = fingerprint_edits(edge_docs(spark)).collect()
    assert len(got) == 12
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint == by_id[3][0].fingerprint  # no terms
    assert by_id[1][0].near_edited == 1.0 and by_id[1][0].n_chars == 0
    assert by_id[4][0].fingerprint == by_id[5][0].fingerprint and by_id[6][0].fingerprint == by_id[7][0].fingerprint
    assert by_id[7][0].near_next == 1.0
    assert len(by_id[9]) == 2 and by_id[9][0] == by_id[9][1]
    assert fingerprint_edits(empty_docs(spark)).count() == 0
    single = fingerprint_edits(spark.createDataFrame([(1, "abcdef ghi")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdef abc").hexdigest()


def test_next_over_ranges(spark):
    docs = [(i * 7 % 501, f"text {i}" * (i % 5)) for i in range(501)]
    want = edits(docs)
    got = fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, (_, t, _) in want.items()}
