"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Fingerprints within `radius` bits are linked and the links closed transitively. A tree over all fingerprints would
neither fit a broadcast nor prune at this radius (random 64-bit values lie about 32 bits apart), so fingerprints are
first sharded: 64 bits are cut into six blocks, and two values that differ in at most four bits agree on at least two
of the six. Each of the 15 pairs of blocks deals the fingerprints to shards by those bits; in a shard, a BK-tree
(children keyed by their integer distance to the parent) finds all values within the radius, following only edges
within the radius of the distance. No link is lost, and shards larger than a bound meet chunk by chunk.

Texts of a given similarity (rather than a given distance in bits) differ in far more bits than such shards allow:
shingle sets of Jaccard similarity 0.8 differ in 15 % of them. similar_classes() therefore takes WIDE_WORDS times as
many bits, so that the distance tells the similarity closely, shards by many random samples of them, and compares exactly
what these find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import group_starts, meet_in_blocks, row_hash, small_batches, sorted_groups, stash
from pitgrid.llm.components import connected_components

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


#: similar_classes(): 64-bit words of a fingerprint, and the least number of samples of its bits.
WIDE_WORDS, TABLES = 4, 96
#: Share of the pairs at the asked similarity that meet in no sample.
MISSED = 0.005
#: Up to so many keys of candidate texts are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 500_000
_MIX = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 63, (WIDE_WORDS, 2), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the shingles of `width` words of the lower-cased (A-Z) text, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(whole[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())]
    return np.array(hashes, dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    n = len(hashes)
    bytes_ = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(bytes_[:, k], minlength=256) @ _BITS
        for j in np.flatnonzero(2 * ones > n).tolist():
            out |= 1 << (8 * k + j)
    return out


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without words."""
    return majority(shingle_hashes(text, width))


def wide_fingerprint(text: str | None, width: int) -> bytes:
    """SimHash of WIDE_WORDS times 64 bits, from as many mixes of the shingles' hashes."""
    return wide_majority(shingle_hashes(text, width))


def wide_majority(hashes: np.ndarray) -> bytes:
    out = []
    for times, xor in _MIX:
        h = (hashes ^ xor) * times
        h ^= h >> np.uint64(31)
        h *= times
        h ^= h >> np.uint64(29)
        out.append(majority(h).to_bytes(8, "little"))
    return b"".join(out)


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): one row per row of docs. Whole texts; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree of 64-bit values under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        at = self.root
        while True:
            d = (at[0] ^ value).bit_count()
            if d == 0:
                return
            child = at[1].get(d)
            if child is None:
                at[1][d] = (value, {})
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            node, children = open_.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if children:
                open_ += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


def _masks(radius: int) -> list[int]:
    """Blocks of bits: with radius + 2 blocks, two values within the radius agree on two of them at least."""
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(parts, 2)]


def _shard_links(radius: int, keys: list[str]):
    """Links of the shards that arrive sorted by key: a spanning forest of each shard, not all its pairs.

    Rows have id and fp, a long or little-endian bytes, and the sides of meet_in_blocks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            starts = [*group_starts(table, keys).tolist(), table.num_rows]
            if pa.types.is_binary(table["fp"].type):
                values = [int.from_bytes(x, "little") for x in table["fp"].to_pylist()]
            else:
                values = table["fp"].to_numpy().view(np.uint64).tolist()
            ids, side, a, b = (table[c].to_numpy().tolist() for c in ("id", "side", "side_a", "side_b"))
            left: list[int] = []
            right: list[int] = []
            for lo, hi in zip(starts, starts[1:]):
                if hi - lo < 2:
                    continue
                tree, parent, id_of = BKTree(), {}, dict(zip(values[lo:hi], ids[lo:hi]))

                def find(x: int) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                rows = range(lo, hi)
                if a[lo] != b[lo]:  # two chunks of a large shard: one builds the tree, the other asks
                    for i in rows:
                        if side[i] == a[lo]:
                            tree.add(values[i])
                    rows = [i for i in rows if side[i] == b[lo]]
                for i in rows:
                    for other in tree.within(values[i], radius):
                        x, y = find(values[i]), find(other)
                        if x != y:
                            parent[x] = y
                            left.append(ids[i])
                            right.append(id_of[other])
                    if a[lo] == b[lo]:
                        tree.add(values[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, radius: int, block_rows: int = 4000) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep together all that lie within radius bits."""
    as_long = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [as_long(m) for m in _masks(radius)]
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.*")
    keys = ["mask", "bits", "side_a", "side_b"]
    met = meet_in_blocks(dealt, ["mask", "bits"], "fp", block_rows).select(*keys, "side", F.col("fp").alias("id"), "fp")
    return met.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_shard_links(radius, keys), "a long, b long")


def _samples(tables: int, bits: int):
    """Keys of a fingerprint: random samples of its bits, the same for all."""
    rng = np.random.Generator(np.random.PCG64(53))
    picks = np.array([rng.choice(64 * WIDE_WORDS, bits, replace=False) for _ in range(tables)])
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    numbers = np.arange(tables, dtype=np.int64) << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * WIDE_WORDS)
            on = np.unpackbits(rows, axis=1, bitorder="little").astype(np.int64)
            keys = np.stack([on[:, pick] @ weights for pick in picks], 1) + numbers
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), tables)), pa.array(keys.ravel())], ["id", "key"])

    return run


def tables_for(n: int, similarity: float) -> tuple[int, int]:
    """(tables, bits of a sample) with which a pair of this similarity among n fingerprints meets with a chance of 1 - MISSED."""
    bits = max(8, min(48, 4 + n.bit_length()))
    met = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(MISSED) / math.log1p(-met))), bits


def candidate_radius(similarity: float) -> int:
    """Bits in which sets of this Jaccard similarity differ on average, and three standard deviations more."""
    n, p = 64 * WIDE_WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(n * p + 3 * math.sqrt(n * p * (1 - p)))


def _verify(width: int, similarity: float):
    """Exact links of the candidate classes that arrive sorted: a set is compared with each class found so far until one of
    its members is alike, so members of one class aren't compared needlessly and no link is lost."""
    keys = ["root", "side_a", "side_b"]

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        if not similarity * len(a) <= len(b) <= len(a) / similarity:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            starts = [*group_starts(table, keys).tolist(), table.num_rows]
            ids, left, right = table["set_id"].to_numpy().tolist(), [], []
            for lo, hi in zip(starts, starts[1:]):
                classes: list[list[tuple[int, np.ndarray]]] = []
                for i in range(lo, hi):
                    own, joined, rest = np.unique(shingle_hashes(table["text"][i].as_py(), width)), [], []
                    for members in classes:
                        link = next((x for x, other in members if alike(own, other)), None)
                        if link is None:
                            rest.append(members)
                        else:
                            left.append(ids[i])
                            right.append(link)
                            joined += members
                    classes = [*rest, [*joined, (ids[i], own)]]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, block_rows: int = 2000, verify_rows: int = 500) -> DataFrame:
    """(doc_id, th, row_key, root): near-duplicate classes of texts, with hashes of the text and of the whole row; root
    names the class.

    Texts whose sets of shingles have a Jaccard similarity of `similarity` or more are linked and links closed
    transitively. Candidates are fingerprints of the sets within candidate_radius() bits that meet in a shard; shards are
    samples of 4 bits more than the binary logarithm of the number of fingerprints, in as many tables as hold a pair's
    chance to meet at 1 - MISSED whatever that number is. Within the classes that candidates make, sets are compared
    exactly. Nulls, repeats and empty texts as in simhash_components().
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fps = [wide_majority(x) for x in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids), pa.array(fps, pa.binary())], ["doc_id", "th", "row_key", "set_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), row_hash(docs).alias("row_key"), "text")
    found = stash(rows.mapInArrow(run, "doc_id long, th long, row_key long, set_id long, fp binary").withColumn("id", F.xxhash64("fp")))
    nodes = stash(found.groupBy("id").agg(F.first("fp").alias("fp")))
    tables, bits = tables_for(nodes.count(), similarity)
    dealt = nodes.select("id", "fp").mapInArrow(_samples(tables, bits), "id long, key long")
    keys = ["key", "side_a", "side_b"]
    met = meet_in_blocks(dealt, ["key"], "id", block_rows).select(*keys, "side", "id").join(nodes.select("id", "fp"), "id")
    links = met.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_shard_links(candidate_radius(similarity), keys), "a long, b long")
    near = connected_components(links, "a", "b")
    sets = found.groupBy("id", "set_id").agg(F.min("th").alias("th"))  # equal sets are one, whatever their texts
    rooted = sets.join(near, sets.id == near.node, "left").select("set_id", "th", F.coalesce("root", "id").alias("root"))
    asked = stash(meet_in_blocks(rooted, ["root"], "set_id", verify_rows).select("root", "side_a", "side_b", "set_id", "th"))
    wanted = asked.select("th").distinct()
    texts = docs.select(F.xxhash64("text").alias("th"), "text").join(F.broadcast(wanted) if asked.count() <= BROADCAST_TEXTS else wanted, "th", "left_semi")
    texts = texts.groupBy("th").agg(F.first("text").alias("text"))
    keys = ["root", "side_a", "side_b"]
    checked = asked.join(texts, "th").select(*keys, "set_id", "text").repartition(*keys).sortWithinPartitions(*keys, "set_id")
    exact = connected_components(checked.mapInArrow(_verify(width, similarity), "a long, b long"), "a", "b")
    classes = found.join(exact, found.set_id == exact.node, "left")
    return classes.select("doc_id", "th", "row_key", F.coalesce("root", "set_id").alias("root"))


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """(doc_id, component_id): similar_classes() named by their smallest doc_id."""
    rooted = stash(similar_classes(docs, width, similarity, **options))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def simhash_components(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """Every row of docs with its fingerprint and near-duplicate class.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, fingerprint (16 lowercase hex digits),
    component_id (smallest doc_id reachable over links of at most `radius` differing bits, itself included).
    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows stay; rows with a
    null doc_id get the class of their fingerprint (null if it has no other doc_id). An empty table gives an empty one.
    """
    fps = stash(with_fingerprints(docs, width))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_row_per_class(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with exactly one row of each near-duplicate class; all columns stay.

    The first row by doc_id (null last), text and whole row (hashes of both) stays. Rows that are alike in all columns
    count as one (nulls are values); a doc_id that occurs with different texts is as many documents.
    """
    first = similar_classes(docs, width, similarity).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "row_key")).alias("kept"))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"), row_hash(docs).alias("row_key"))  # whatever the caller's columns are named
    kept = keyed.join(first.select(F.col("kept.row_key").alias("row_key")), "row_key", "left_semi")
    return kept.dropDuplicates(["row_key"]).select("own.*")
