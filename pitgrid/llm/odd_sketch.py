"""Near-duplicate documents by MinHash, with odd sketches between the bands and the exact sets.

A document's distinct shingles give BANDS x ROWS MinHash samples. Documents that agree on a band of ROWS samples meet in
a bucket. All samples are also folded into an odd sketch: sample i with value m flips the bit that (i, m) hashes to. Bits
in which two sketches differ count the samples in which the sets differ, and so tell high similarities closely; pairs
whose sketches differ too much are no candidates. What is left is confirmed on the full sets.

Equal sets are one node. First every node is compared with the least node of each of its buckets, which takes one row a
node however large the bucket, and the closest is confirmed: a large group of near copies falls together. Only buckets
that then still hold several components are gone through pair by pair, on sketches; large ones in blocks, in which rows
of the largest component meet the others but not each other. A pair is looked at in the first of the buckets that its
two nodes share; rows with a candidate there are confirmed on their sets, until no two components of a bucket are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import drop_stash, group_starts, join_hot, small_batches, sorted_groups, stash
from pitgrid.llm.components import connected_components
from pitgrid.llm.simhash import shingle_hashes

#: A pair of similarity 0.8 meets in no band with a chance of 1.4e-7.
BANDS, ROWS = 52, 6
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: Standard deviations by which the sketches of a pair at the asked similarity may differ more than they do on average.
SIGMAS = 5
BLOCK_ROWS = 500
#: Up to so many keys of wanted texts are broadcast (8 bytes each), so that the other texts stay where they are; more are
#: joined by a shuffle.
BROADCAST_TEXTS = 2_000_000
_CHUNK = 1 << 16
_rng = np.random.Generator(np.random.PCG64(67))
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_PLACE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def sketch_limit(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, sigmas: float = SIGMAS) -> int:
    """Differing bits up to which a pair of sketches is a candidate.

    Of the samples, d differ, a binomial count; each flips two bits, so 2 d flips fall on `bits` places, and the number of
    places with an odd count has mean n/2 (1 - (1 - 2/n)^2d). Both spreads are added.
    """
    n, d = bits, samples * (1 - similarity)
    shrink = (1 - 2 / n) ** (2 * d)
    mean = n / 2 * (1 - shrink)
    places = max(0.0, n / 4 + n * (n - 1) / 4 * (1 - 4 / n) ** (2 * d) - (n / 2 * shrink) ** 2)
    slope = 2 * shrink
    return math.ceil(mean + sigmas * math.sqrt(places + slope * slope * samples * similarity * (1 - similarity)))


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SAMPLES MinHash values (32 bits) for each set of 64-bit hashes, none of them empty."""
    h = np.concatenate(sets)
    h = ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    least, buffer = np.empty((SAMPLES, len(sets)), np.uint32), np.empty_like(h)
    for p in range(SAMPLES):
        np.bitwise_xor(h, _XOR[p], out=buffer)
        np.multiply(buffer, _TIMES[p], out=buffer)
        least[p] = np.minimum.reduceat(buffer, starts)
    return least.T


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(samples), b + 1, np.uint64)
        for r in range(ROWS):
            k = (k ^ samples[:, b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        keys[:, b] = k
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """A row of SKETCH_WORDS words for each row of samples: the parity of the samples that hash to each bit."""
    places = (samples.astype(np.uint64) * _PLACE) ^ _PLACE
    places ^= places >> np.uint64(31)
    places = (places * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    at = places.astype(np.int64) + SKETCH_BITS * np.arange(len(samples))[:, None]
    odd = np.bincount(at.ravel(), minlength=SKETCH_BITS * len(samples)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def _words(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(column), SKETCH_WORDS)


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def _sign(width: int):
    def flush(sets: list[np.ndarray], bands: list[np.ndarray], sketches: list[np.ndarray]) -> None:
        samples = samples_of(sets)
        bands.append(band_keys(samples))
        sketches.append(odd_sketches(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            bands, sketches = [np.zeros((0, BANDS), np.uint64)], [np.zeros((0, SKETCH_WORDS), np.uint64)]
            sets, held = [], 0
            for text in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(text, width))
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), 1))
                sizes.append(len(own))
                sets.append(own if len(own) else np.zeros(1, np.uint64))
                held += len(own)
                if held >= _CHUNK:
                    flush(sets, bands, sketches)
                    sets, held = [], 0
            if sets:
                flush(sets, bands, sketches)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(np.concatenate(bands)), _lists(np.concatenate(sketches))],
                ["doc_id", "th", "node", "n_shingles", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(sets, pa.list_(pa.int64()))], ["th", "shingles"])

    return run


def _candidates(table: pa.Table, lo: int, hi: int, limit: int, percent: int) -> Iterator[tuple[int, list[int]]]:
    """(i, others): rows before i of the bucket's rows lo:hi that are near to it by sketch and size, in another component,
    and in no earlier bucket with it. Rows of two chunks of a large bucket are only held against the other chunk's."""
    sketch, comp, size, side = _words(table["sketch"].slice(lo, hi - lo)), *(table[c].slice(lo, hi - lo).to_numpy() for c in ("comp", "n_shingles", "side"))
    shared = table["buckets"].slice(lo, hi - lo)
    band = table["band"][lo].as_py()
    two_chunks = table["side_a"][lo].as_py() != table["side_b"][lo].as_py()
    lists: dict[int, list[int]] = {}

    def buckets(i: int) -> list[int]:
        if i not in lists:
            lists[i] = shared[i].as_py()
        return lists[i]

    for i in range(1, hi - lo):
        other = comp[:i] != comp[i]
        if two_chunks:
            other &= side[:i] != side[i]
        near = np.flatnonzero(other & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i])))
        if len(near):
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(1, dtype=np.int64) <= limit]
        if len(near):
            own = set(buckets(i))
            if first := [j for j in near.tolist() if next(b for b in buckets(j) if b in own) == band]:
                yield i, first


_KEYS = ["band", "side_a", "side_b"]


def _near_rows(limit: int, percent: int):
    """Rows that have a candidate in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, _KEYS):
            starts = [*group_starts(table, _KEYS).tolist(), table.num_rows]
            wanted: set[int] = set()
            for lo, hi in zip(starts, starts[1:]):
                for i, others in _candidates(table, lo, hi, limit, percent):
                    wanted.add(lo + i)
                    wanted.update(lo + j for j in others)
            yield from table.take(pa.array(sorted(wanted), pa.int64())).combine_chunks().to_batches(max_chunksize=500)

    return run


def _confirm(limit: int, percent: int):
    """Links between components, confirmed on the full sets: a forest of each bucket, not all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, _KEYS):
            starts = [*group_starts(table, _KEYS).tolist(), table.num_rows]
            nodes, comps, shingles = table["node"].to_numpy().tolist(), table["comp"].to_numpy().tolist(), table["shingles"].combine_chunks()
            left, right = [], []
            for lo, hi in zip(starts, starts[1:]):
                parent: dict[int, int] = {}

                def find(x: int) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i, others in _candidates(table, lo, hi, limit, percent):
                    own = shingles[lo + i].values.to_numpy()
                    for j in others:
                        a, b = find(comps[lo + i]), find(comps[lo + j])
                        if a == b:
                            continue
                        other = shingles[lo + j].values.to_numpy()
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            parent[a] = b
                            left.append(nodes[lo + i])
                            right.append(nodes[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


# Sets and sketches grow with the corpus: joins with them are merge joins at any size, so that a plan tried on little data
# is the plan of much.


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in wanted, from one text of each."""
    texts = stash(nodes.join(wanted, "node", "left_semi").select("node", "th"))
    keyed = docs.select(F.xxhash64("text").alias("th"), "text").where("text is not null")
    # one row of each text: copies are told apart by nothing but their ids
    keys = texts.select("th")
    found = keyed.join(F.broadcast(keys) if texts.count() <= BROADCAST_TEXTS else keys, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    sets = stash(found.mapInArrow(_sets(width), "th long, shingles array<long>").join(texts, "th").select("node", "shingles"))
    drop_stash(texts)
    return sets


def _star_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, limit: int) -> DataFrame:
    """Confirmed links of each node with the closest of the least nodes of its buckets: at most one a node."""
    pairs = members.where("node <> least").select("node", "least").distinct()
    mine = stash(pairs.join(nodes.select("node", "sketch", F.col("n_shingles").alias("n")).hint("merge"), "node"))
    theirs = nodes.select(F.col("node").alias("least"), F.col("sketch").alias("least_sketch"), F.col("n_shingles").alias("least_n"))
    met = join_hot(mine, theirs.join(mine.select("least").distinct(), "least", "left_semi"), ["least"], ["node"], mine.count())
    apart = F.aggregate(F.zip_with("sketch", "least_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sized = 100 * F.least("n", "least_n") >= percent * F.greatest("n", "least_n")
    near = met.where(sized).withColumn("apart", apart).where(F.col("apart") <= limit)
    edges = stash(near.groupBy("node").agg(F.min(F.struct("apart", "least")).alias("m")).select("node", F.col("m.least").alias("least")))
    sets = _sets_of(docs, nodes, edges.select("node").union(edges.select("least")).distinct(), width)
    theirs = sets.join(edges.select("least").distinct(), sets.node == F.col("least"), "left_semi").select(F.col("node").alias("least"), F.col("shingles").alias("least_shingles"))
    both = join_hot(edges, theirs, ["least"], ["node"], edges.count()).join(sets.hint("merge"), "node")
    inter = F.size(F.array_intersect("shingles", "least_shingles"))
    alike = 100 * inter >= percent * (F.size("shingles") + F.size("least_shingles") - inter)
    links = stash(both.where(alike).select(F.col("node").alias("a"), F.col("least").alias("b")))
    for table in (mine, edges, sets):
        drop_stash(table)
    return links


def _meet_across(placed: DataFrame, block_rows: int) -> DataFrame:
    """Rows (band, node, comp) of the buckets that hold several components, with the blocks (side_a, side_b, side) in which
    they meet. A bucket of up to block_rows rows is one block. In a larger one, chunks of the largest component's rows
    meet the chunks of the others, and these each other: rows of the largest never meet."""
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("comps"))
    mixed = sizes.where("comps > 1").select("band", F.col("most.comp").alias("largest"), F.col("most.n").alias("most"), "total")
    chunks = lambda n: F.ceil(n / block_rows).cast("int")
    whole, own = F.col("total") <= block_rows, F.xxhash64("node")
    rows = placed.join(mixed, "band").withColumn("is_largest", F.col("comp") == F.col("largest"))
    rows = rows.withColumn("of_largest", chunks(F.col("most"))).withColumn("of_others", chunks(F.col("total") - F.col("most")))
    place = lambda a, b, side: F.struct(a.cast("int").alias("side_a"), b.cast("int").alias("side_b"), side.cast("int").alias("side"))
    big, small = -1 - F.pmod(own, F.col("of_largest")), F.pmod(own, F.col("of_others"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    of_largest = to(F.col("of_others"), lambda k: place(big, k, big))
    of_others = F.concat(to(F.col("of_largest"), lambda k: place(-1 - k, small, small)), to(F.col("of_others"), lambda k: place(F.least(k, small), F.greatest(k, small), small)))
    zero = F.lit(0)
    blocks = F.when(whole, F.array(place(zero, zero, zero))).when(F.col("is_largest"), of_largest).otherwise(of_others)
    return rows.select("band", "node", "comp", F.explode(blocks).alias("block")).select("band", "node", "comp", "block.*")


def near_links(nodes: DataFrame, docs: DataFrame, width: int, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between nodes (node, th, n_shingles, bands, sketch) that keep together all that are alike."""
    limit = sketch_limit(percent / 100)
    banded = stash(nodes.select("node", F.explode("bands").alias("band")))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("least")).where("n > 1")
    once = buckets.groupBy("n", "members").agg(F.min("band").alias("band"), F.min("least").alias("least")).select("band", "least")
    members = stash(banded.join(once, "band").select("band", "least", "node"))
    drop_stash(banded)
    stars = _star_links(members, nodes, docs, width, percent, limit)
    comps = connected_components(stars, "a", "b").select("node", "root")
    placed = stash(members.join(comps, "node", "left").select("band", "node", F.coalesce("root", "node").alias("comp")))
    drop_stash(members)
    asked = stash(_meet_across(placed, block_rows))
    lists = asked.select("node", "band").distinct().groupBy("node").agg(F.sort_array(F.collect_list("band")).alias("buckets"))  # BANDS at most
    rows = asked.join(lists.join(nodes.select("node", "n_shingles", "sketch").hint("merge"), "node").hint("merge"), "node").select(*_KEYS, "side", "node", "comp", "n_shingles", "sketch", "buckets")
    left = stash(rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node").mapInArrow(_near_rows(limit, percent), rows.schema))
    sets = _sets_of(docs, nodes, left.select("node").distinct(), width)
    checked = left.join(sets.hint("merge"), "node").select(*left.columns, "shingles").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node")
    links = stash(stars.union(checked.mapInArrow(_confirm(limit, percent), "a long, b long")))
    for table in (stars, placed, asked, left, sets):
        drop_stash(table)
    return links


def near_components(docs: DataFrame, width: int = 5, similarity_percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): every row of docs (doc_id, text; other columns are ignored) with its
    near-duplicate class.

    A text's set holds its distinct shingles of `width` words (A-Z lower-cased); with fewer words, the whole sequence as
    one. Rows are linked whose sets' intersection is similarity_percent (80 or more) of their union or more, and links are
    closed. component_id is the smallest doc_id reachable, kept tells whether the row has it. Null, empty and blank texts
    have an empty set and are linked with nothing, not even with each other. Repeated rows are all returned. A row without
    an id has the class of its text (null if no row there has an id) and isn't kept. An empty table gives an empty one.
    Equal shingles, sets and texts are known by 64-bit hashes.
    """
    if similarity_percent < 80:
        raise ValueError("bands are made for similarities of 0.8 and more")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = stash(rows.mapInArrow(_sign(width), "doc_id long, th long, node long, n_shingles long, bands array<long>, sketch array<long>"))
    one = signed.where("n_shingles > 0").groupBy("node").agg(F.min("th").alias("th"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stash(one)
    light = stash(signed.select("doc_id", "th", "node", "n_shingles"))
    drop_stash(signed)
    some = light.where("n_shingles > 0")
    roots = connected_components(near_links(nodes, docs, width, similarity_percent), "a", "b")
    rooted = nodes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stash(rooted.join(least, "root").select("node", "component_id"))
    drop_stash(nodes)
    found = join_hot(some, named, ["node"], ["doc_id", "th"], some.count())
    empty = light.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = found.select("doc_id", "n_shingles", "component_id").union(empty)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: Shingles of two words, every two documents that share one, and the reach of each document.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
        JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""
