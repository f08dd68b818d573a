"""Removal of long repeated byte strings by prefix-free parsing.

A window of `length` bytes is removed if it starts anywhere else too: if it has a neighbour in the order of all suffixes
of the corpus with which it shares `length` bytes. Sorting every suffix would cost far more than the corpus;
prefix-free parsing sorts phrases instead. The rolling hash of `gram` bytes triggers a phrase end at its least value within
`reach` starts, so every window has exactly one trigger, found from the window's own bytes: a suffix is a phrase suffix
(the bytes up to its trigger, fewer than `reach`) followed by the parse from there. Two suffixes of different triggers are
never alike, so the order is needed only among triggers that agree in what every window of theirs holds:

* parse: a trigger's name is its next length - reach + 1 bytes. Names that occur once can't repeat and go.
* dictionary: a trigger's entry is its phrase and the bytes that follow, all its windows together. Entries are counted;
  of one that occurs twice or more, all windows repeat. Only names of several different entries need the order.
* order: the entries of a name meet in one task. The suffix array of their phrases (sorted from the trigger backwards, with
  common lengths) gives the classes of equal phrase suffixes of each length; the suffix array of the parse from their
  triggers (with common prefix lengths) orders each class. A window repeats if it shares with a neighbour in its class
  what is left of `length`. Bytes are compared, no hashes.
* names of more than HOT entries, which one task should not hold: their windows are told apart by name, in blocks and
  then one by one, counted like the dictionary.

Counts are pre-aggregated at each level, so a passage that very many documents share is no hot spot. Where strings are
known by name, they are known by two 64-bit hashes together, of the string and of a part of it: at 10^12 names, two
different strings with one name are to be expected once in some 10^14 corpora.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import drop_stash, group_starts, small_batches, sorted_groups, stash

GRAM = 16
#: Up to so many different entries of a name are ordered in one task; windows of others are told apart by name.
HOT = 4000
#: Entries ordered together, of many names: whole names, at least so many rows if there are.
TOGETHER = 16_000
#: Windows of a hot name are first told apart in blocks of so many.
BLOCK = 16
#: Kinds of parts: all windows repeat; to be ordered; of a hot name.
_SETTLED, _OPEN, _HOT = 0, 1, 2
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def window_triggers(data: bytes, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one trigger: first start, last start, trigger position."""
    n = len(data)
    h = _TABLE[np.frombuffer(data, np.uint8)]
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint32(0x9E3779B1) + h[step:]
        h ^= h >> np.uint32(15)
        step *= 2
    least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
    at = (least[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    return first, last, at[first]


def _entries(length: int, reach: int):
    """Name and dictionary entry of each trigger of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for row, text in zip(zip(batch.column("did").to_pylist(), batch.column("th").to_pylist()), batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                first, last, at = (x.tolist() for x in window_triggers(data, length, reach))
                tail = length - reach + 1
                cols[0] += [digest(data[a : a + tail]) for a in at]
                cols[1] += [digest(data[i : j + length], a - i) for i, j, a in zip(first, last, at)]
                cols[2] += [row[0]] * len(at)
                cols[3] += [row[1]] * len(at)
                cols[4] += first
                cols[5] += last
                cols[6] += at
            arrays = [*map(_longs, cols[:2])] + [pa.array(c, pa.int64()) for c in cols[2:4]] + [pa.array(c, pa.int32()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "entry", "did", "th", "first", "last", "trigger"])

    return run


def _bytes(length: int):
    """Entries to be ordered, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, th, text, parts in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text", "parts"))):
                data = text.encode("utf-8", "surrogatepass")
                own = [x for x in parts if x["kind"] == _OPEN]
                if own:
                    ints = [pa.array([x[c] for x in own], pa.int32()) for c in ("first", "last", "trigger")]
                    names = pa.array([x["name"] for x in own], pa.int64())
                    cut = pa.array([data[x["first"] : x["last"] + length] for x in own], pa.binary())
                    yield pa.RecordBatch.from_arrays([names, *_same(len(own), did, th), *ints, cut], ["name", "did", "th", "first", "last", "trigger", "bytes"])

    return run


def _sorted_with_common(strings: list[bytes], group: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings in the order of group and bytes, and how many bytes each place shares with the one before it
    (zeros stand behind the ends; -1 at a new group)."""
    order = sorted(range(len(strings)), key=lambda i: (group[i], strings[i]))
    padded = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    differ = padded[1:] != padded[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    of = np.asarray(group)[order]
    common[of[1:] != of[:-1]] = -1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, np.concatenate(([-1], common))


class _Least:
    """Least value of any range of an array, from the least values of all ranges whose sizes are powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of lo to hi, both included."""
        out = np.empty(len(lo), np.int64)
        size = np.frexp(hi - lo + 1)[1] - 1
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k) + 1])
        return out


def repeated_windows(data: list[bytes], group: list[int], most: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bytes before the trigger) of the windows that start in two entries of a group at least. An entry's bytes are
    those of its windows, of which the first has `most` bytes before the trigger and the last `least`."""
    left = [x[:m][::-1] for x, m in zip(data, most.tolist())]
    right = [x[m:] for x, m in zip(data, most.tolist())]
    phrase_at, phrase_common = _sorted_with_common(left, group, max(1, int(most.max())))
    parse_at, parse_common = _sorted_with_common(right, group, length)
    shared = _Least(np.maximum(parse_common, 0))
    best = np.maximum(parse_common[parse_at], np.append(parse_common, -1)[parse_at + 1])
    alive = np.flatnonzero(best >= length - most)  # no other entry shares enough after the trigger with the rest
    found, sizes = [], []
    for a in range(int(most.max()) + 1):
        if len(alive) < 2:
            break
        classes = np.cumsum(phrase_common < a)[phrase_at]
        e = alive[(least[alive] <= a) & (a <= most[alive])]
        e = e[np.lexsort((parse_at[e], classes[e]))]
        pair = np.flatnonzero(classes[e[1:]] == classes[e[:-1]])
        r = parse_at[e]
        pair = pair[shared.of(r[pair] + 1, r[pair + 1]) >= length - a]
        hit = np.unique(np.concatenate((e[pair], e[pair + 1])))
        found.append(hit)
        sizes.append(np.full(len(hit), a))
        alive = alive[most[alive] > a]  # alone in its class once, alone in all narrower ones
        _, at, n = np.unique(classes[alive], return_inverse=True, return_counts=True)
        alive = alive[n[at] > 1]
    return (np.concatenate(found), np.concatenate(sizes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _order(length: int):
    """Spans of repeated windows of the entries that arrive sorted by name."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        first, last, trigger, did, th = (table[c].to_numpy() for c in ("first", "last", "trigger", "did", "th"))
        starts = group_starts(table, ["name"])
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows))).tolist()
        entry, before = repeated_windows(table["bytes"].to_pylist(), group, (trigger - first).astype(np.int64), (trigger - last).astype(np.int64), length)
        at = trigger[entry] - before
        order = np.lexsort((at, entry))
        entry, at = entry[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], (entry[1:] != entry[:-1]) | (at[1:] != at[:-1] + 1)))) if len(entry) else np.zeros(0, np.int64)
        ends = at[np.append(new[1:], len(at)) - 1] + length if len(entry) else at
        rows = entry[new]
        return pa.RecordBatch.from_arrays([pa.array(did[rows]), pa.array(th[rows]), pa.array(at[new], pa.int32()), pa.array(ends, pa.int32())], ["did", "th", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for table in sorted_groups(batches, ["name"]):
            waiting.append(table)
            rows += table.num_rows
            if rows >= TOGETHER:
                yield spans(pa.concat_tables(waiting).combine_chunks())
                waiting, rows = [], 0
        if waiting:
            yield spans(pa.concat_tables(waiting).combine_chunks())

    return run


def _blocks(length: int):
    """Windows of the entries of hot names, in blocks of BLOCK places of the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for did, th, text, parts in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text", "parts"))):
                data = text.encode("utf-8", "surrogatepass")
                inner, whole, firsts, lasts = [], [], [], []
                for x in parts:
                    if x["kind"] != _HOT:
                        continue
                    first, last, at = x["first"], x["last"], x["trigger"]
                    for j in range((at - last) // BLOCK, (at - first) // BLOCK + 1):
                        lo, hi = max(first, at - BLOCK * j - BLOCK + 1), min(last, at - BLOCK * j)
                        inner.append(digest(data[at - BLOCK * j : at - BLOCK * j - BLOCK + 1 + length], j))
                        whole.append(digest(data[lo : hi + length], (at - lo) * length + at - hi))
                        firsts.append(lo)
                        lasts.append(hi)
                if inner:
                    yield pa.RecordBatch.from_arrays([*map(_longs, (inner, whole)), *_same(len(inner), did, th), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["inner", "whole", "did", "th", "first", "last"])

    return run


def _windows(length: int):
    """Windows of blocks whose common bytes several blocks share, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for did, th, text, items in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text", "items"))):
                data = text.encode("utf-8", "surrogatepass")
                inner = [x["inner"] for x in items for _ in range(x["first"], x["last"] + 1)]
                starts = [i for x in items for i in range(x["first"], x["last"] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(inner, pa.int64()), _longs([digest(data[i : i + length]) for i in starts]), *_same(len(starts), did, th), pa.array(starts, pa.int32())], ["inner", "window", "did", "th", "first"])

    return run


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _same(n: int, *values: int) -> list[pa.Array]:
    return [pa.array(np.full(n, v, np.int64)) for v in values]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(keep_bytes: bool):
    """Apply the spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + keep_bytes)]
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                merged = merge_spans([(x["first"], x["end"]) for x in spans])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                for col, v in zip(out, (doc_id, len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest)):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names[: len(out)])

    return run


def _first(*columns: str) -> list:
    """Any one row's columns: which row stands for its class makes no difference to the counts."""
    return [F.first(c).alias(c) for c in columns]


def _twice(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of two rows or more; a table of its own, so that Spark can split the hot keys of the join that follows."""
    return stash(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))


def repeated_parts(docs: DataFrame, length: int, reach: int, hot: int = HOT) -> DataFrame:
    """(did, th, parts) of the rows of docs (did, th, text) that may hold repeats: runs of windows (first, last) that all
    repeat, and open ones, of which each stands for its dictionary entry."""
    long_enough = docs.where(F.octet_length("text") >= length)
    entries = stash(long_enough.mapInArrow(_entries(length, reach), "name long, entry long, did long, th long, first int, last int, trigger int"))
    shared = stash(entries.join(_twice(entries, "name"), "name", "left_semi"))
    drop_stash(entries)
    dictionary = stash(shared.groupBy("name", "entry").agg(F.count("*").alias("n"), *_first("did", "th", "first", "last", "trigger")))
    settled = shared.join(dictionary.where("n > 1").select("name", "entry"), ["name", "entry"], "left_semi")
    several = stash(dictionary.groupBy("name").agg(F.count("*").alias("entries")).where("entries > 1"))
    open_ = dictionary.join(several, "name")
    part = lambda kind: F.struct("name", "first", "last", "trigger", kind.cast("int").alias("kind")).alias("part")
    kind = F.when(F.col("entries") > hot, _HOT).otherwise(_OPEN)
    both = settled.select("did", "th", part(F.lit(_SETTLED))).union(open_.select("did", "th", part(kind)))
    return both.groupBy("did", "th").agg(F.collect_list("part").alias("parts"))


def ordered_spans(found: DataFrame, length: int) -> DataFrame:
    """(did, th, first, end): repeats among the open parts of found (did, th, text, parts), by suffix order."""
    opened = found.where(F.exists("parts", lambda x: x.kind == _OPEN))
    cut = opened.mapInArrow(_bytes(length), "name long, did long, th long, first int, last int, trigger int, bytes binary")
    return cut.repartition("name").sortWithinPartitions("name").mapInArrow(_order(length), "did long, th long, first int, end int")


def named_spans(found: DataFrame, length: int) -> DataFrame:
    """(did, th, first, end): repeats among the parts of hot names, by names of their windows."""
    opened = found.where(F.exists("parts", lambda x: x.kind == _HOT))
    blocks = stash(opened.mapInArrow(_blocks(length), "inner long, whole long, did long, th long, first int, last int"))
    shared = stash(blocks.join(_twice(blocks, "inner"), "inner", "left_semi"))
    drop_stash(blocks)
    kinds = stash(shared.groupBy("inner", "whole").agg(F.count("*").alias("n"), *_first("did", "th", "first", "last")))
    settled = shared.join(kinds.where("n > 1").select("inner", "whole"), ["inner", "whole"], "left_semi")
    items = kinds.join(_twice(kinds, "inner"), "inner", "left_semi").groupBy("did", "th").agg(F.collect_list(F.struct("inner", "first", "last")).alias("items"))
    windows = stash(opened.select("did", "th", "text").join(items, ["did", "th"]).mapInArrow(_windows(length), "inner long, window long, did long, th long, first int"))
    single = windows.join(_twice(windows, "inner", "window"), ["inner", "window"], "left_semi")
    return settled.select("did", "th", "first", (F.col("last") + length).alias("end")).union(single.select("did", "th", "first", (F.col("first") + length).alias("end")))


def remove_repeats(docs: DataFrame, length: int = 400, reach: int = 320, keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which starts anywhere else too, in any row or the same.

    docs needs doc_id and text (UTF-8 bytes count); other columns are ignored. One row per row of docs: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with keep_bytes, the bytes kept. Null counts
    as empty; rows are told apart by doc_id and text, repeated rows count as occurrences of each other; texts shorter
    than `length` stay whole. An empty table gives an empty one.
    """
    if length < reach + GRAM:
        raise ValueError("a window must hold a whole phrase")
    small_batches(docs.sparkSession, 200)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64("doc_id", "text").alias("th"))
    found = stash(rows.join(repeated_parts(rows.select("did", "th", "text"), length, reach, hot), ["did", "th"]))
    late = ordered_spans(found, length).union(named_spans(found, length)).groupBy("did", "th").agg(F.collect_list(F.struct("first", "end")).alias("late"))
    early = F.transform(F.filter("parts", lambda x: x.kind == _SETTLED), lambda x: F.struct(x.first.alias("first"), (x.last + length).alias("end")))
    none = F.array().cast("array<struct<first:int,end:int>>")
    hit = found.join(late, ["did", "th"], "left").select("doc_id", "text", F.concat(early, F.coalesce("late", none)).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    zero = F.lit(0).cast("long")
    plain = rows.select(
        "did", "th", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_bytes else []),
    )
    clean = plain.join(found.select("did", "th"), ["did", "th"], "left_anti").drop("did", "th")
    return hit.mapInArrow(_cut(keep_bytes), schema).union(clean)
