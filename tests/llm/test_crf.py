import re
from collections import Counter
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pitgrid.llm.crf import FEATURES, TRAINING_LINES, Chain, base_fails, describe, fit, judge, keep_good, quality_verdicts, training_sequences

from .corpus import SF, edge_docs, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(covered)}


@settings(max_examples=300)
@given(st.text(alphabet="a b\n#é\t\x85", max_size=120))
def test_base_counts(text):
    assert describe(text)[0] == plain_base(text)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(40):
        chain = Chain(rng.normal(size=len(FEATURES)), rng.normal(size=(2, 2)) * 2)
        f = rng.normal(size=(6, len(FEATURES)))
        s = f @ chain.weights
        score = lambda y: sum(s[i] for i in range(6) if y[i]) + sum(chain.moves[a, b] for a, b in zip(y, y[1:]))
        assert abs(score(chain.viterbi(f)) - max(map(score, product((0, 1), repeat=6)))) < 1e-9


def test_fit_follows_the_likelihood():
    """Adam's chain is better than the prior's, and than small steps away from it."""
    rng = np.random.default_rng(2)
    data = [(rng.normal(size=(int(n), len(FEATURES))) + y, y) for n, y in zip(rng.integers(1, 6, 60), rng.integers(0, 2, 60))]

    def gain(chain):
        total = 0.0
        for f, y in data:
            s = f @ chain.weights
            score = lambda p: sum(s[i] for i in range(len(f)) if p[i]) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))
            z = np.logaddexp.reduce([score(p) for p in product((0, 1), repeat=len(f))])
            total += (score((y,) * len(f)) - z) / len(f)
        prior = Chain.prior()
        return total - 0.25 * (np.sum((chain.weights - prior.weights) ** 2) + np.sum((chain.moves - prior.moves) ** 2))

    best = fit(data, rounds=1500, rate=0.3)
    assert gain(best) > gain(Chain.prior())
    for i in range(len(FEATURES)):
        for step in (-0.3, 0.3):
            w = best.weights.copy()
            w[i] += step
            assert gain(best) > gain(Chain(w, best.moves)) - 1e-3


def test_whole_table(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_verdicts(docs, labels).collect()}
    for r in docs.collect():
        base = plain_base(r.text)
        assert {k: got[r.doc_id][k] for k in base} == base
        assert got[r.doc_id].base_failed == (base["n_words"] < 20 or 100 * base["n_repeat_words"] > 30 * base["n_words"]) == base_fails(base)
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)
    truth = [(x.quality, got[x.doc_id]) for x in labels.collect()]
    judged = [(q, r.kept) for q, r in truth if not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.98 * len(judged)
    good = [r.kept for q, r in truth if q == 1 and not r.base_failed]
    assert sum(good) >= 0.99 * len(good)


def test_boilerplate_lines_between_content():
    """The decoder marks lines, not whole documents."""
    text = "\n".join(["the lines of a text that one reads with some pleasure are these here"] + ["CLICK!! HERE!! NOW!! $$$ ### BUY!! IT!! $$$"] * 1 + ["and then it goes on in the same quiet way as it had begun before"])
    _, _, features = describe(text)
    assert Chain.prior().viterbi(features) == [1, 0, 1]


def test_edge_cases(spark):
    docs = edge_docs(spark)
    chain = Chain.prior()
    got = judge(docs, chain).collect()
    want = Counter(tuple(plain_base(t).values()) for (t,) in docs.select("text").collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    labels = spark.createDataFrame([(6, 1, None), (None, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    kept = keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality_verdicts(empty_docs(spark), labels.limit(0)).count() == 0


def test_a_long_labelled_text_teaches_a_bounded_number_of_lines(spark):
    """The fit doesn't grow with the longest text: its lines in a row, the same each time."""
    long = "\n".join(f"line {i} of {i * 7919 % 104729} words and {i * 31 % 9973} more" for i in range(100_000))
    rows = [(1, long), (2, "\n".join(f"short {i} text {i * i} with some words of its own" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once, again = (training_sequences(docs, labels) for _ in range(2))
    assert sorted(len(f) for f, _ in once) == [20, TRAINING_LINES]
    assert all((a[0] == b[0]).all() for a, b in zip(once, again))
