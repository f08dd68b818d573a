import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitgrid.llm.harmonic import _merge_part_filled, cut_plan, pack

from .corpus import SF, edge_docs, empty_docs, small_docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def plain_ids(texts, added_as_text=False):
    t = Tokenizer.from_file(PATH)
    if added_as_text:
        t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, docs, capacity, added_as_text=False):
    """Each id in exactly one piece, ids as the tokenizer gives them, sequences gapless and within the capacity."""
    want = defaultdict(list)
    for (doc_id, _), ids in zip(docs, plain_ids([t for _, t in docs], added_as_text)):
        want[doc_id].append(ids)
    have = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        have[p.doc_id].append((p.doc_tokens, p.start, ids))
    assert have.keys() == want.keys()
    for doc_id, lists in want.items():
        flat = Counter_of((len(x), i, v) for x in lists for i, v in enumerate(x))
        assert flat == Counter_of((n, s + i, v) for n, s, ids in have[doc_id] for i, v in enumerate(ids))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def Counter_of(items):
    from collections import Counter

    return Counter(items)


def test_whole_table_round_trip_and_padding(spark):
    docs = [(r.doc_id, r.text) for r in small_docs(spark).collect()]
    pieces = pack(small_docs(spark), PATH, PATTERN, 2048, with_ids=True).collect()
    used = check(pieces, docs, 2048)
    tokens = sum(p.length for p in pieces)
    assert used * 2048 < tokens * 1.08  # 200 documents: part-filled bins weigh most


def test_ids_of_a_larger_table(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    local = [(r.doc_id, r.text) for r in docs.collect()]
    check(pack(docs, PATH, PATTERN, 2048, with_ids=True).collect(), local, 2048)


@given(st.integers(1, 9000), st.sampled_from([64, 1000, 2048]))
def test_cut_plan(n, capacity):
    plan = cut_plan(n, capacity)
    assert sum(length for length, _ in plan) == n
    assert all(0 < length <= capacity // j for length, j in plan)
    assert len(plan) <= n // capacity + 5


@given(st.lists(st.integers(1, 2048), max_size=60))
def test_merging_part_filled_bins(loads):
    out = _merge_part_filled(list(enumerate(loads)), 2048)
    used = defaultdict(list)
    for j, (k, at) in out.items():
        used[k].append((at, loads[j]))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048


def test_edge_cases(spark):
    df = edge_docs(spark)
    local = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    pieces = pack(df, PATH, PATTERN, 2048, with_ids=True).collect()
    check(pieces, local, 2048)
    text = "a <|endoftext|> b  \n\n  c's 12 it'll   "
    special = spark.createDataFrame([(1, text), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>\n")], "doc_id long, text string")
    local = [tuple(r) for r in special.collect()]
    for added_as_text in (False, True):
        check(pack(special, PATH, PATTERN, 64, with_ids=True, added_as_text=added_as_text).collect(), local, 64, added_as_text)
    assert 50256 in plain_ids([text])[0] and 50256 not in plain_ids([text], True)[0]
    assert pack(empty_docs(spark), PATH, PATTERN).count() == 0
