import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pitgrid.llm.secrets import CLASSES, base_spans, candidates, chi2_tail, decoys, find_secrets, randomness, rule_decoys

from .corpus import edge_docs, empty_docs, small_docs, small_pandas

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def plain_reports(docs, rate):
    """doc_id -> random spans: Benjamini-Hochberg over p-values that decoys give, class by class."""
    false, tokens = rule_decoys(), []
    for d, t in docs:
        false += decoys(t)
        tokens += [(d, *c) for c in candidates(t)]
    out = {}
    for c in range(CLASSES):
        own = sorted((x for x in tokens if x[3] == c), key=lambda x: x[4])
        levels = [v for k, v in false if k == c]
        p = [(1 + sum(v <= x[4] for v in levels)) / (1 + len(levels)) for x in own]
        rank = [sum(y[4] <= x[4] for y in own) for x in own]
        last = max((i for i, x in enumerate(p) if x * len(own) <= rate * rank[i]), default=-1)
        for x in own[: last + 1]:
            out.setdefault(x[0], set()).add(f"random:{x[1]}:{x[2]}")
    return out


@settings(max_examples=400)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "ſecret", "=", ": ", "'", '"', "abcdefgh", "a1b2", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é", " ", "\n", "-", "."]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert base_spans(text) == plain_base(text)


def test_whole_table(spark):
    docs = small_pandas()
    got = {r.doc_id: r for r in find_secrets(small_docs(spark)).collect()}
    reported = plain_reports(list(zip(docs.doc_id, docs.text)), 0.05)
    for d, t in zip(docs.doc_id, docs.text):
        base = plain_base(t)
        names = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base]
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("random")] == names
        assert sum(x.startswith("random") for x in spans) == r.n_random
        assert {x for x in spans if x.startswith("random")} == reported.get(d, set())


def test_chi_squared_tail():
    for x, df, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (24.996, 15, 0.05), (30.578, 15, 0.01), (7.261, 15, 0.95), (0.0, 3, 1.0)):
        assert abs(chi2_tail(x, df) - p) < 2e-4


def test_battery_tells_keys_from_words():
    rng = random.Random(4)
    keys = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(300)]
    keys += ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(300)]
    words = ["the_quick_brown_fox_jumps_over_1_lazy_dog", "v2-release-notes-for-the-next-version-01", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "abababababababababababab12", "id-000000000000000000000001", "abcdefghijklmnopqrstuvwxyz0123456789"]
    assert sum(randomness(k) > 0.01 for k in keys) > 0.97 * len(keys)
    assert all(randomness(w) < 0.01 for w in words)


def test_false_discoveries_are_controlled_by_length(spark):
    """Random keys stay reported; plainly ordered tokens of the same lengths go, in each class of length. Of keys of 24
    characters, joined words pass for some, so at this rate some of them are given up."""
    rng = random.Random(9)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    docs = []
    for i in range(120):
        n = (24, 40, 70, 130)[i % 4]
        docs.append((2 * i, f"it is {key(n - 1)}1 here"))
        docs.append((2 * i + 1, f"it is {'never_random_words_at_all_' * 6}"[: 6 + n - 1] + "1 here"))
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * i].n_random for i in range(120) if i % 4) >= 87
    assert sum(got[2 * i].n_random for i in range(0, 120, 4)) >= 18
    assert sum(got[2 * i + 1].n_random for i in range(120)) <= 3


def test_rate_of_false_secrets(spark):
    """Keys among many identifiers joined from words, in every class of length: of what is reported, few aren't keys."""
    rng = random.Random(17)
    vowels, others = "aeiou", "bdfgklmnprstvz"
    word = lambda: "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 3))) + rng.choice(others)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    docs = []
    for i in range(1500):
        n = (24, 40, 56, 90, 140)[i % 5]
        words = [word() for _ in range(60)]
        token = "".join(rng.choices(chars, k=n - 1)) + "7" if i % 10 < 5 and i % 3 == 0 else rng.choice(("-", "_")).join([words[0], str(rng.randint(1, 3000)), *words])[:n].rstrip("-_")
        docs.append((i, f"{' '.join(words)} {token} {' '.join(words[:9])}"))
    keys = {i for i, _ in docs if i % 10 < 5 and i % 3 == 0}
    hit = {r.doc_id for r in find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.n_random}
    assert len(hit & keys) > 0.9 * len(keys)
    assert len(hit - keys) <= 0.1 * len(hit)


def test_spans_are_code_points_and_edge_cases(spark):
    key = "".join(random.Random(5).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=60))
    docs = spark.createDataFrame([(1, f"é🙂 {key} token='{'a' * 8}'")], "doc_id long, text string")
    r = find_secrets(docs).first()
    assert r.spans == f"random:3:{3 + len(key)},assign:{4 + len(key)}:{4 + len(key) + 15}"
    assert [c[:2] for c in candidates(f"({key})")] == [(1, 1 + len(key))]
    got = find_secrets(edge_docs(spark)).collect()
    assert len(got) == 12 and all(x.spans == "" for x in got if x.doc_id in (1, 2, 3, 4, 5))
    assert find_secrets(empty_docs(spark)).count() == 0


def test_values_directly_after_an_equals_sign():
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLE3KEY"
    for before, after in (("aws_access_key_id=", ""), ("export NAME=", "\n"), ("https://h/x?sig=", "&se=1"), ("?a=1&sig=", "=="), ("NAME = ", ""), ('NAME="', '"')):
        end = len(before) + len(key) + (2 if after == "==" else 0)
        assert [c[:2] for c in candidates(before + key + after)] == [(len(before), end)]
    assert candidates(f"{key}x=") and not candidates("n=short1")
