"""Line dedup by MinHash: of each class of like lines, one line stays in the corpus.

Lines are sets of character shingles. MinHash signatures are cut into bands; lines that agree on a band meet in a
bucket. Exact Jaccard similarity decides which of them are linked, links are closed by distributed union-find, and
each class keeps its first line by doc_id and place. Buckets of the same members are looked at once, large buckets meet
chunk by chunk, and a bucket gives a spanning forest of its links: a line is compared with each class found so far
until one of its lines is like it, so lines of one class are never compared needlessly and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import group_starts, meet_in_blocks, small_batches, sorted_groups, stash
from pitgrid.llm.components import connected_components

SHINGLE, SIMILARITY = 8, 0.8
#: A pair of similarity 0.8 meets with a chance of 0.995, one of 0.9 with one of 0.99998.
BANDS, ROWS = 10, 4
#: Up to so many keys of candidate lines are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: From so many lines of a bucket on, shared shingles are counted at once; the classes are the same.
COUNTED = 64
_CHUNK = 1 << 16
_rng = np.random.Generator(np.random.PCG64(31))
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def line_key(line: str) -> int:
    """Spark's xxhash64() of the line, unsigned."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similarity(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of BANDS keys a line."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    places = sizes + SHINGLE  # zeros end each line; a line shorter than a shingle is one, zeros included
    ends = np.cumsum(places)
    starts = ends - places
    c = np.zeros(int(ends[-1]), np.uint32)
    whole = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    c[np.arange(len(whole)) + np.repeat(np.arange(len(lines)) * SHINGLE, sizes)] = whole
    h = c * np.uint32(0x9E3779B1)
    step = 1
    while step < SHINGLE:
        h[:-step] = h[:-step] * np.uint32(0x85EBCA6B) + h[step:]
        h ^= h >> np.uint32(13)
        step *= 2
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    cuts = np.stack([starts, starts + np.maximum(1, sizes - SHINGLE + 1)], 1).ravel()
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    buffer = np.empty_like(h)
    for p in range(BANDS * ROWS):
        np.bitwise_xor(h, _XOR[p], out=buffer)
        np.multiply(buffer, _TIMES[p], out=buffer)
        least[p] = np.minimum.reduceat(buffer, cuts)[::2]
    keys = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(lines), b + 1, np.uint64)
        for r in range(ROWS):
            k = (k ^ least[b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        keys[:, b] = k
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, numbers, keys, bands = [], [], [], [], []
        todo: list[str] = []
        size = 0
        for did, th, text in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text"))):
            for i, line in enumerate(text.split("\n")):
                if not line.strip(" \t\x0b\x0c\r"):
                    continue
                ids.append(did)
                hashes.append(th)
                numbers.append(i)
                keys.append(line_key(line))
                todo.append(line)
                size += len(line)
                if size >= _CHUNK:
                    bands.append(band_keys(todo))
                    todo, size = [], 0
        if todo:
            bands.append(band_keys(todo))
        if keys:
            flat = np.concatenate(bands).ravel().view(np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["did", "th", "line_no", "line", "bands"])


def links_by_sets(lines: list[int], sets: list[set[str]]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between lines, set by set: quick where there are few lines."""
    classes: list[list[int]] = []
    for i, own in enumerate(sets):
        joined, rest = [i], []
        for members in classes:
            link = next((j for j in members if SIMILARITY * len(sets[j]) <= len(own) <= len(sets[j]) / SIMILARITY and similarity(own, sets[j]) >= SIMILARITY), None)
            if link is None:
                rest.append(members)
            else:
                yield lines[i], lines[link]
                joined += members
        classes = [*rest, joined]


def links_by_counts(lines: list[int], sets: list[set[str]]) -> Iterator[tuple[int, int]]:
    """The same classes: the shingles that a line shares with every other are counted at once, by the lines of each shingle."""
    names: dict[str, int] = {}
    ids = [np.fromiter((names.setdefault(x, len(names)) for x in own), np.int64, len(own)) for own in sets]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids)
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]  # lines by shingle, in order of lines
    ends = np.cumsum(np.bincount(flat, minlength=len(names)))
    starts = np.concatenate([[0], ends[:-1]])
    classes = np.arange(len(ids))
    for i, own in enumerate(ids):
        both = np.bincount(np.concatenate([holders[starts[x] : ends[x]] for x in own]), minlength=len(ids))[:i]
        alike = np.flatnonzero(both / (sizes[i] + sizes[:i] - both) >= SIMILARITY)
        met, first = np.unique(classes[alike], return_index=True)
        for j in alike[first].tolist():
            yield lines[i], lines[j]
        classes[:i][np.isin(classes[:i], met)] = i


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["band", "side_a", "side_b"]
    for table in sorted_groups(batches, keys):
        starts = [*group_starts(table, keys).tolist(), table.num_rows]
        lines, texts = table["line"].to_numpy().tolist(), table["text"].to_pylist()
        left, right = [], []
        for lo, hi in zip(starts, starts[1:]):
            own = dict(zip(lines[lo:hi], texts[lo:hi]))
            for a, b in (links_by_counts if len(own) >= COUNTED else links_by_sets)(list(own), list(map(shingles, own.values()))):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def like_lines(lines: DataFrame, docs: DataFrame, block_rows: int = 1000) -> DataFrame:
    """(a, b): links between keys of different lines that keep together all that are alike and meet in a band."""
    spark = lines.sparkSession
    banded = lines.groupBy("line").agg(F.first("bands").alias("bands")).select("line", F.explode("bands").alias("band"))
    banded = stash(banded)
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("line")).alias("members")).where("n > 1")
    once = buckets.groupBy("n", "members").agg(F.min("band").alias("band")).select("band")
    members = stash(banded.join(once, "band", "left_semi"))
    wanted = members.select("line").distinct()
    if members.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    found = docs.select(F.explode(F.split("text", "\n")).alias("line_text")).withColumn("line", F.xxhash64("line_text")).join(wanted, "line", "left_semi")
    texts = found.groupBy("line").agg(F.first("line_text").alias("text"))
    met = meet_in_blocks(members, ["band"], "line", block_rows).select("band", "side_a", "side_b", "line").join(texts, "line")
    keys = ["band", "side_a", "side_b"]
    small_batches(spark)
    return met.repartition(*keys).sortWithinPartitions(*keys, "line").mapInArrow(_verify, "a long, b long")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(did, th, gone): numbers of the lines to remove, for rows of docs (did, th, text) that lose any."""
    lines = stash(docs.mapInArrow(_sign, "did long, th long, line_no int, line long, bands array<long>"))
    roots = connected_components(like_lines(lines, docs), "a", "b")
    placed = lines.select("did", "th", "line_no", "line").join(roots, F.col("line") == F.col("node"), "left")
    placed = stash(placed.select("did", "th", "line_no", F.coalesce("root", "line").alias("root")))
    first = placed.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "line_no")).alias("kept")).where("n > 1").select("root", "kept")
    gone = placed.join(first, "root").where(F.struct("did", "th", "line_no") != F.col("kept"))
    return gone.groupBy("did", "th").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the text without its repeated and near-repeated lines, and n_lines and n_removed added.

    A line is what \\n ends or the text's end. Lines without a word are left alone, as are null texts; a line is kept if
    it is the first of its class by doc_id (null counts as 0), text hash and place. Lines shorter than a shingle are
    alike only if equal. Rows of equal doc_id and text count as one document. An empty table gives an empty one.
    Columns n_lines and n_removed of docs are replaced. Equal lines and rows are known by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")  # whatever the caller's columns are named
    keyed = docs.select(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"), F.xxhash64("doc_id", "text").alias("th"))
    gone = removed_lines(keyed.where("own.text is not null").select("did", "th", F.col("own.text").alias("text")))
    both = keyed.join(gone, ["did", "th"], "left")
    text = F.col("own.text")
    lines = F.split(text, "\n")
    # by hash, in order, and split once (hence the array of one): a search or a split for each line would be quadratic
    places = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone"))
    left = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(places(own), lambda i: F.get(own, i)), "\n")), F.lit(0))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    kept = F.when(F.col("gone").isNull(), text).otherwise(left)
    return both.select(*[kept.alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def drop_emptied(deduped: DataFrame) -> DataFrame:
    """Without the documents that lost lines and have no word left: all they held stays elsewhere."""
    return deduped.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
