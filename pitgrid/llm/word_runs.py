"""Runs of repeated words in texts, through Lempel-Ziv blocks.

A run is a stretch of words with a smallest period q that no neighbouring word extends. For the words of many texts at
once (no word is shared between texts, so texts don't mix): ranks of windows of 1, 2, 4, ... words by prefix doubling
give the suffix array, and from them how far any two places agree, forwards and backwards; neighbours in suffix order
with a smaller place give each place's longest previous factor; jumping from place to place by it cuts the text into
Lempel-Ziv blocks. Every run touches a border of two blocks or lies inside one. Those at a border are found by Main's
extensions to both sides, for the periods that the two blocks allow; a run inside a block is a copy of one at the
block's earlier occurrence, and buckets of runs by their start hand it on, from left to right.

Texts are independent: a task holds a batch of them, whole, and no more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import small_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Words of texts that are looked at together (a longer text is alone).
_WORDS = 1 << 17


class Places:
    """Suffix order and agreement of places over an array of word numbers, where each text has numbers of its own."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = n = len(words)
        # ranks[k][i]: order of the window of 2^k words at i, equal windows alike; windows that end early are unlike all
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank]
        order = np.argsort(rank, kind="stable")
        while True:
            sorted_ = rank[order]
            again = np.zeros(n, bool)
            same = sorted_[1:] == sorted_[:-1]
            again[1:] |= same
            again[:-1] |= same
            at = np.flatnonzero(again)  # places in order whose rank isn't their own yet
            if not len(at):
                break
            width = 1 << (len(self.ranks) - 1)
            at_place = order[at]
            behind = at_place + width
            second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1 - at_place)
            key = np.lexsort((second, sorted_[at]))
            order[at] = at_place = at_place[key]
            first, second = sorted_[at], second[key]  # groups keep their places in the order
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            heads = np.maximum.accumulate(np.where(new, at, 0))
            group = np.ones(len(at), bool)
            group[1:] = first[1:] != first[:-1]
            group_at = np.maximum.accumulate(np.where(group, at, 0))
            # ranks needn't be dense: a group's ranks start at its old one and leave room for its members
            rank = rank.copy() if len(self.ranks) > 1 else self._spread(rank, order)
            base = rank[at_place]
            rank[at_place] = base + (heads - group_at)
            self.ranks.append(rank)
        self.order = order

    def _spread(self, rank: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Ranks as the number of places before the group, so that a group can be told apart within its own room."""
        counts = np.bincount(rank)
        starts = np.cumsum(counts) - counts
        return starts[rank]

    def forwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y on agree (x and y differ; places at the end or beyond agree in none)."""
        return self._agree(x, y, 1)

    def backwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words up to x and up to y, these included, agree (places before the start agree in none)."""
        return self._agree(x, y, -1)

    def _agree(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        total = np.zeros(len(x), np.int64)
        if not self.n or not len(x):
            return total

        def alike(k: int, of: np.ndarray) -> np.ndarray:
            """Which of the pairs agree in 2^k words more."""
            a, b = x[of] + way * total[of], y[of] + way * total[of]
            if way < 0:
                a, b = a - (1 << k) + 1, b - (1 << k) + 1
            ok = (a >= 0) & (b >= 0) & (a < self.n) & (b < self.n)
            out = np.zeros(len(of), bool)
            rank = self.ranks[k]
            out[ok] = rank[a[ok]] == rank[b[ok]]
            return out

        tops: list[np.ndarray] = []  # up while windows agree, then down again
        going = np.arange(len(x))
        for k in range(len(self.ranks)):
            going = going[alike(k, going)]
            if not len(going):
                break
            total[going] += 1 << k
            tops.append(going)
        for k in range(len(tops) - 1, -1, -1):
            going = tops[k]
            going = going[alike(k, going)]
            total[going] += 1 << k
        return total

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, source): the longest factor from each place on that also starts earlier, and where."""
        sa, n = self.order, self.n
        best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for neighbour in (_smaller_before(sa), n - 1 - _smaller_before(sa[::-1])[::-1]):
            has = (neighbour >= 0) & (neighbour < n)
            place, other = sa[has], sa[neighbour[has]]
            length = self.forwards(place, other)
            better = length > best[place]
            best[place[better]], source[place[better]] = length[better], other[better]
        return best, source


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 if there is none: all jump at once over what is known to be larger."""
    at = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def blocks(length: np.ndarray, start: int, end: int) -> list[int]:
    """Borders of the Lempel-Ziv blocks of the text that lies at start:end, both ends included."""
    borders, at = [start], start
    while at < end:
        at += max(1, int(length[at]))
        borders.append(at)
    return borders


def _ranges(counts: np.ndarray) -> np.ndarray:
    """1 to counts[i], one after the other."""
    ends = np.cumsum(counts)
    return np.arange(1, int(ends[-1]) + 1 if len(ends) else 1) - np.repeat(ends - counts, counts)


def runs_of(words: np.ndarray, cuts: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start of the texts at cuts[i]:cuts[i + 1], whose word numbers differ from text to text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in cuts[1:]]
    if not len(words):
        return out
    places = Places(words)
    length, source = places.previous_factors()
    borders, text_of, before, after = [], [], [], []
    cut = []
    for t, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own = blocks(length, a, b)
        cut.append(own)
        sizes = [y - x for x, y in zip(own, own[1:])]
        borders += own
        text_of += [t] * len(own)
        before += [0, *sizes]
        after += [*sizes, 0]
    s, text, room = np.array(borders), np.array(text_of), np.array(before) + np.array(after)
    # the last border that a run touches bounds its period: see the module's tests against all periods
    periods = room // (min_exponent - 1) + 1
    q, text = _ranges(periods), np.repeat(text, periods)
    s = np.repeat(s, periods)
    first, last = np.array(cuts)[text], np.array(cuts)[text + 1]
    for x, y in ((s, s + q), (s - q, s)):  # the period at the border's right, or at its left
        ok = (x >= first) & (y <= last)
        x, y, period, of = x[ok], y[ok], q[ok], text[ok]
        ahead, back = places.forwards(x, y), places.backwards(x - 1, y - 1)
        found = ahead + back + period >= np.maximum(min_length, min_exponent * period)
        for t, start, size, p in zip(of[found].tolist(), (x - back)[found].tolist(), (period + ahead + back)[found].tolist(), period[found].tolist()):
            out[t].append((start, size, p))
    for t, found in enumerate(out):
        if found:
            least: dict[tuple[int, int], int] = {}
            for start, size, p in found:  # the stretch of a period is found under its multiples too
                least[start, size] = min(p, least.get((start, size), p))
            out[t] = _with_copies(least, cut[t], source, cuts[t])
    return out


def _with_copies(least: dict[tuple[int, int], int], borders: list[int], source: np.ndarray, origin: int) -> list[tuple[int, int, int]]:
    """The runs at borders and, block by block, those inside blocks: copies of runs inside the earlier occurrence."""
    buckets: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for (start, size), p in least.items():
        buckets[start].add((size, p))
    starts = sorted(buckets)
    for begin, end in zip(borders, borders[1:]):
        from_ = int(source[begin])
        if end - begin < 2 or from_ < 0:
            continue
        shift = begin - from_
        i = bisect_right(starts, from_)  # strictly inside: neighbours on both sides are copied too
        while i < len(starts) and starts[i] < from_ + end - begin:
            start = starts[i]
            for size, p in list(buckets[start]):
                if start + size < from_ + end - begin:
                    if not buckets[start + shift]:
                        insort(starts, start + shift)
                    buckets[start + shift].add((size, p))
            i = bisect_left(starts, start) + 1
    return sorted((start - origin, size, p) for start, group in buckets.items() for size, p in group)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, p in runs:
        gone[start + p] += 1
        gone[start + size] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def _find(min_length: int, min_exponent: int):
    def some(columns: list[list], texts: list[list[bytes]]) -> None:
        number = count()
        ids: list[int] = []
        cuts = [0]
        for words in texts:
            own: defaultdict[bytes, int] = defaultdict(number.__next__)
            ids += map(own.__getitem__, words)
            cuts.append(len(ids))
        for words, runs in zip(texts, runs_of(np.array(ids, np.int64), cuts, min_length, min_exponent)):
            columns[0].append(len(words))
            columns[1].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            columns[2].append(b" ".join(kept_words(words, runs) if runs else words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            columns: list[list] = [[], [], []]
            texts, size = [], 0
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # bytes.split() cuts at \x20 and \x09-\x0D
                if texts and size + len(words) > _WORDS:
                    some(columns, texts)
                    texts, size = [], 0
                texts.append(words)
                size += len(words)
            some(columns, texts)
            collapsed = pa.array(columns[2], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): a row for each row of docs (doc_id, text; other columns are ignored).

    runs holds (start, length, period) by start, then period, of every run of the text's words that has min_length words
    and min_exponent (2 or more) periods at least; start is a word's number from 0. collapsed has the words, joined by a
    space, that no run holds after its first period. Null, empty and blank texts have no words; repeated rows and rows
    without an id are looked at one by one; an empty table gives an empty one.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find(min_length, min_exponent), schema)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text of ten, by the CRC-32 of its id, gets a periodic tail: with g a tenth of that sum and n
    words, words from a = g % n on become those from a on with period 1 + (n - a) // (3 + g % 8). Null ids and texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    tail = F.expr("""transform(sequence(0, n - 1), i -> CASE WHEN i < a THEN element_at(words, int(i + 1))
        ELSE element_at(words, int(a + (i - a) % (1 + floor((n - a) / (3 + g % 8))) + 1)) END)""")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    some = some.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (ties: smallest start, then period) and digests of all runs and of
    the collapsed text."""
    found = periodic_runs(docs)
    # exact comparison of length / period by cross products
    best = F.expr("""aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda c, byte: list_reduce([xor(c, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

#: Runs from all pairs of equal words of a document, period by period.
SQL = rf"""WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words, {_CRC} AS h FROM documents),
    d1 AS (SELECT *, len(words) AS n, h // 10 AS g FROM d0),
    d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d1),
    w AS MATERIALIZED (SELECT rid, n, i, words[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
        FROM (SELECT *, unnest(range(n)) AS i FROM d2)),
    e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    stretches AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e)
        GROUP BY rid, q, island HAVING count(*) + q >= greatest({MIN_LENGTH}, {MIN_EXPONENT} * q)),
    r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM stretches GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) AS k FROM r) WHERE k = 1),
    listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
    gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
    kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM d0 LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""
