"""Packing token sequences by the harmonic method.

A document's tokens are cut into pieces whose lengths fall (almost) exactly on reciprocals of the capacity. Pieces of
class j (longest length capacity // j) always go j to a bin, so a bin's content follows from a piece's rank in its
class alone, and every worker fills bins on its own. The few bins that a class leaves part-filled, one a class at
most, are merged first-fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.llm.common import global_rank, small_batches, stash

END_ID = 1
#: A piece that fills this share of its class's length or more is not cut further.
FULL_ENOUGH = 63 / 64
#: Entries of each half of a worker's memo of pre-tokens: when the newer half is full, it takes the place of the older. A memo
#: only: results don't depend on it.
MEMO_ENTRIES = 500_000


def cut_plan(n: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        longest = capacity // j
        if rest >= FULL_ENOUGH * longest:
            pieces.append((rest, j))
            break
        part = capacity // (j + 1)
        pieces.append((part, j + 1))
        rest -= part
    return pieces


class TokenIds(dict):
    """Little-endian 32-bit ids by pre-token, from the tokenizer's own BPE model; misses are encoded once.

    A text that holds one of the tokenizer's added tokens is encoded by the tokenizer itself, which reads it as that token
    (`added_as_text`: as ordinary text)."""

    def __init__(self, tokenizer_path: str, pattern: str, added_as_text: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.model = self.whole.model
        self.older: dict[str, bytes] = {}
        self.added = [] if added_as_text else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = regex.compile(pattern).findall
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # byte-level BPE's

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(token)
        if ids is None:
            seen = token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join([self[token] for token in self.split(text)])


@lru_cache(maxsize=2)
def worker_ids(tokenizer_path: str, pattern: str, added_as_text: bool) -> TokenIds:
    """The tokenizer and its memo, loaded once in a worker and used by all tasks that it is given."""
    return TokenIds(tokenizer_path, pattern, added_as_text)


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, with_ids: bool = False, added_as_text: bool = False, order: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, piece_class, position[, ids]: the pieces of every row of docs; position
    is the column named by order, or 0."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_class int, position long" + ", ids binary" * with_ids
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_ids(tokenizer_path, pattern, added_as_text)
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, text, position in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "position"))):
                ids = encoder.encode(text or "") + end
                total, at = len(ids) // 4, 0
                for length, j in cut_plan(total, capacity):
                    part = ids[4 * at : 4 * (at + length)]
                    for col, v in zip(out, (doc_id, at, length, zlib.crc32(part), total, j, position, part)):
                        col.append(v)
                    at += length
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece_class", "position", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names[: len(out)])

    position = F.lit(0) if order is None else F.col(order)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", position.cast("long").alias("position")).mapInArrow(run, schema)


def _merge_part_filled(loads: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """First-fit decreasing of the part-filled bins, (class, tokens): class -> (bin, offset). One a class at most."""
    bins: list[int] = []
    out = {}
    for j, tokens in sorted(loads, key=lambda x: (-x[1], x[0])):
        k = next((i for i, used in enumerate(bins) if used + tokens <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out[j] = (k, bins[k])
        bins[k] += tokens
    return out


def _spread(pieces: DataFrame, position: Column) -> Column:
    """Positions stretched over the whole range of longs, in the same order: what global_rank() cuts into even buckets."""
    last = pieces.agg(F.max("position")).first()[0] or 0
    return (((position + 0.5) / float(last + 1) - 0.5) * float((1 << 64) - (1 << 12))).cast("long")


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, with_ids: bool = False, added_as_text: bool = False, order: str | None = None) -> DataFrame:
    """Pack all rows of docs (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the ids
    (little-endian 32-bit) themselves. Ids are those of Tokenizer.encode(text, add_special_tokens=False), so the string of
    an added token is that token, unless added_as_text. Null and empty texts are the end id alone; repeated rows and rows of a null
    doc_id are packed one by one; very long texts fill whole sequences. An empty table gives an empty one. With order, the name of a
    column of places from 0, pieces of a class are put together in that order, and sequences are numbered by the first place
    in them, so that sequences by number follow it.
    """
    pieces = stash(token_pieces(docs, tokenizer_path, pattern, capacity, with_ids, added_as_text, order))
    if order is None:
        hashed, by = pieces.withColumn("order_hash", F.xxhash64("doc_id", "start", "ids_crc32")), ["order_hash", "doc_id", "start"]
    else:
        hashed, by = pieces.withColumn("order_hash", _spread(pieces, F.col("position"))), ["order_hash", "position", "doc_id", "start", "ids_crc32"]
    ranked = global_rank(hashed, ["piece_class"], by)
    in_bin = W.partitionBy("piece_class", "bin").orderBy("rank_in_group").rowsBetween(W.unboundedPreceding, -1)
    placed = ranked.withColumn("bin", F.floor(F.col("rank_in_group") / F.col("piece_class"))).withColumn("inside", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    placed = stash(placed.drop("order_hash", "rank_in_group"))

    # A row a class: `capacity` at most.
    classes = {r.piece_class: r.n // r.piece_class for r in pieces.groupBy("piece_class").agg(F.count("*").alias("n")).collect()}
    loads = placed.groupBy("piece_class", "bin").agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).where("n < piece_class")
    moved = _merge_part_filled([(r.piece_class, r.tokens) for r in loads.collect()], capacity)
    rows, first = [], 0
    total = sum(classes.values())
    for j, full in sorted(classes.items()):
        k, at = moved.get(j, (0, 0))
        rows.append((j, full, first, total + k, at))
        first += full
    table = docs.sparkSession.createDataFrame(rows, "piece_class int, full_bins long, first_bin long, part_bin long, part_offset long")
    whole = F.col("bin") < F.col("full_bins")
    out = placed.join(F.broadcast(table), "piece_class").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(whole, F.col("first_bin") + F.col("bin")).otherwise(F.col("part_bin")).cast("long").alias("sequence_id"),
        F.when(whole, F.col("inside")).otherwise(F.col("inside") + F.col("part_offset")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []), "position",
    )
    if order is None:
        return out.drop("position")
    out = stash(out)
    sequences = out.groupBy("sequence_id").agg(F.min("position").alias("position")).withColumn("one", F.lit(0))
    numbered = global_rank(sequences.withColumn("order_hash", _spread(out, F.col("position"))), ["one"], ["order_hash", "position", "sequence_id"])
    return out.drop("position").join(numbered.select("sequence_id", F.col("rank_in_group").alias("new_id")), "sequence_id").select(*[F.col("new_id").alias(c) if c == "sequence_id" else c for c in out.columns if c != "position"])
