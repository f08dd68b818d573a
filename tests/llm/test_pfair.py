import math
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pitgrid.llm.pfair import edf_schedule, keep_mix, mix, period_schedule

from .corpus import edge_docs, empty_docs, small_docs


def plain_period(parts):
    """Slot by slot: of the released blocks, the one due first."""
    period, done, out = sum(parts), [0] * len(parts), []
    for t in range(period):
        due = [(math.ceil((done[i] + 1) * period / q), i) for i, q in enumerate(parts) if done[i] < q and done[i] * period // q <= t]
        i = min(due)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


def schedule_of(spark, parts):
    rows = [(f"={i:03}", q, sum(parts)) for i, q in enumerate(parts)]
    got = period_schedule(spark.createDataFrame(rows, "source_key string, parts long, period long")).collect()
    return [(int(r.source_key[1:]), r.turn) for r in sorted(got, key=lambda r: r.slot_in_period)]


def test_schedule_is_edf_and_never_a_block_off(spark):
    for parts in ([1], [5, 3, 2], [1] * 7, [97, 1, 1, 1], [13, 11, 7, 5, 3, 2, 1], [50, 25, 25]):
        got, period = schedule_of(spark, parts), sum(parts)
        assert got == plain_period(parts)
        have = [0] * len(parts)
        for t, (i, turn) in enumerate(got):
            assert turn == have[i] and turn * period // parts[i] <= t < math.ceil((turn + 1) * period / parts[i])
            have[i] += 1
            assert all(abs(h - (t + 1) * q / period) < 1 for h, q in zip(have, parts))


@settings(max_examples=100)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_edf_meets_every_deadline(parts):
    period = sum(parts)
    assert all(j * period // parts[i] <= t < math.ceil((j + 1) * period / parts[i]) for t, (i, j) in enumerate(plain_period(parts)))


def check(rows, block_docs):
    """Slots hold one block of one source; the mix has every slot before its end."""
    slots = defaultdict(list)
    for r in rows:
        if r.slot is not None:
            slots[r.slot].append(r)
            assert r.release <= r.slot < r.deadline
    for rs in slots.values():
        assert len({(r.source, r.block) for r in rs}) == 1 and sorted(r.place for r in rs) == list(range(len(rs))) and len(rs) <= block_docs
    used = {r.slot for r in rows if r.in_mix}
    assert used == set(range(len(used)))
    assert not any(r.in_mix for r in rows if r.slot is not None and r.slot > len(used))
    return len(used)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs, block_docs=4).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert check(rows, 4) > 200
    kept = keep_mix(docs, block_docs=4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.in_mix}


def test_given_targets_and_a_hot_source(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "cast(id as string) text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) source")
    targets = spark.createDataFrame([("hot", 0.5), ("s1", 0.3), ("s2", 0.2), ("gone", 1.0), ("s3", 0.0)], "source string, weight double")
    rows = mix(docs, targets=targets, block_docs=5).collect()
    end = check(rows, 5)
    blocks = Counter(s for s, _ in {(r.source, r.block) for r in rows if r.in_mix})
    assert abs(blocks["hot"] - 0.5 * end) <= 1 and abs(blocks["s1"] - 0.3 * end) <= 1 and abs(blocks["s2"] - 0.2 * end) <= 1
    assert set(blocks) == {"hot", "s1", "s2"}
    assert all(r.slot is None for r in rows if r.source in ("s0", "s3", "s4"))
    sizes = Counter(r.source for r in rows)
    assert any(blocks[s] >= sizes[s] // 5 - 1 for s in blocks)  # the mix ends with the scarcest source


def test_edge_cases(spark):
    rows = mix(edge_docs(spark)).collect()
    assert len(rows) == 12
    check(rows, 4)
    assert mix(empty_docs(spark)).count() == 0 and keep_mix(empty_docs(spark)).count() == 0
    assert mix(small_docs(spark)).count() == 200


def test_a_source_of_one_row_does_not_end_the_mix(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "cast(id as string) text", "if(id = 7, null, if(id % 10 < 7, 'hot', concat('s', id % 10))) source")
    rows = mix(docs).collect()
    assert all(r.in_mix for r in rows) and check(rows, 4) == len({(r.source, r.block) for r in rows})
    kept = keep_mix(docs).collect()
    assert len(kept) == 20_000
    slot = {r.doc_id: (r.slot, r.place) for r in rows}
    assert [slot[r.doc_id] for r in kept] == sorted(slot.values())


def test_unrounded_targets_hold_over_many_periods(spark):
    exact = {"a": 0.5 + 0.0041, "b": 0.3 + 0.0043, "c": 0.1949 - 0.0084, "d": 0.005, "e": 0.0001}
    docs = spark.range(30_000).selectExpr("id doc_id", "cast(id as string) text", "element_at(array('a', 'a', 'b', 'b', 'c', 'd'), cast(id % 6 + 1 as int)) source")
    docs = docs.union(spark.range(30_000, 30_009).selectExpr("id", "cast(id as string)", "'e'"))
    targets = spark.createDataFrame(list(exact.items()), "source string, weight double")
    rows = [r for r in mix(docs, targets=targets, block_docs=1, period=100).collect() if r.in_mix]
    assert len(rows) > 15_000
    have = Counter()
    for t, r in enumerate(sorted(rows, key=lambda r: r.slot)):
        have[r.source] += 1
        assert r.slot == t and all(abs(have[s] - (t + 1) * w) < 1 for s, w in exact.items())


def plain_run(targets, length):
    """One run through all slots: of the released blocks, the one due first."""
    done, out = [0] * len(targets), []
    for t in range(length):
        i = min((math.ceil((done[i] + 1) / w - 1e-6), i) for i, w in enumerate(targets) if math.floor(done[i] / w + 1e-6) <= t)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


def test_chunks_give_the_one_run_through_all_slots(spark):
    uneven = [1 / (i + 1) ** 1.3 for i in range(50)]
    tiny = [0.5, 0.3, 0.1987, 0.001, 0.0003]
    near = [0.25 + 1e-4, 0.25 - 1e-4, 0.25 + 3e-5, 0.25 - 3e-5]
    for weights, length in ((uneven, 3000), (tiny, 8000), (near, 3000), ([5, 3, 2, 1], 3001), ([1], 500)):
        targets = [w / sum(weights) for w in weights]
        s = [(f"={i:03}", w) for i, w in enumerate(targets)]
        system = spark.createDataFrame([(0, length, s)], "system long, length long, s array<struct<source_key: string, target: double>>")
        expected, have = plain_run(targets, length), [0] * len(targets)
        for period, warm_up in ((250, 40), (250, 0)):  # without warming up, guesses are wrong and folded again
            chunks = sorted(edf_schedule(system, period, warm_up).collect(), key=lambda r: r.chunk)
            assert [(o.i, o.turn) for r in chunks for o in r.order] == expected
        for t, (i, _) in enumerate(expected):
            have[i] += 1
            assert all(abs(h - (t + 1) * w) < 1 for h, w in zip(have, targets))


def test_given_targets_hold_to_less_than_a_block_at_every_slot(spark):
    docs = spark.range(12_000).selectExpr("id doc_id", "cast(id as string) text", "element_at(array('a', 'a', 'a', 'b', 'b', 'c', 'd'), cast(id % 7 + 1 as int)) source")
    exact = {"a": 5 / 11, "b": 3 / 11, "c": 2 / 11, "d": 1 / 11}
    rows = mix(docs, targets=spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0), ("d", 1.0)], "source string, weight double"), block_docs=1).collect()
    check(rows, 1)
    have = Counter()
    held = sorted((r for r in rows if r.in_mix), key=lambda r: r.slot)
    assert len(held) > 9_000
    for t, r in enumerate(held):
        have[r.source] += 1
        assert all(abs(have[s] - (t + 1) * w) < 1 for s, w in exact.items())
    assert sorted(r.slot for r in rows) == list(range(12_000))  # what is left goes on without a gap
