"""Language identification by prediction by partial matching.

Every language has a context tree over bytes (A-Z folded) of variable order: contexts of up to ORDER bytes that were seen
in training. A byte's probability is that of the longest context seen, escapes (method C, with exclusion) lead to shorter
ones, and order -1 is uniform over all 256 bytes: each node's distribution sums to one, so a text's code length under a
tree is exact. The statistics are frozen after training.

A tree is sparse: per order, the sorted codes of the contexts and bytes seen with their code lengths, and what an escape
costs in each context. Seen bytes of a context are seen in its suffixes too, so the mass that exclusion leaves is summed
over seen bytes alone, and memory is linear in what was seen. A text is scored by its distinct strings of ORDER + 1
bytes: those not found at one order pay the escape and are looked for at the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import small_batches

#: Bound of the training sample, in documents a language (in expectation: each is drawn by a hash of its doc_id).
TRAINING_DOCS = 2000
ORDER = 4
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Tree:
    """By order from 0: codes of context and byte with the byte's bits, codes of contexts with an escape's bits."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


_grown: dict[str, list[Tree]] = {}


@dataclass(frozen=True)
class Model:
    """counts: per language, sorted codes of ORDER + 1 bytes and how often they occur."""

    langs: list[str]
    counts: list[tuple[np.ndarray, np.ndarray]]

    def trees(self) -> list[Tree]:
        """Grown once in a worker, whatever the number of its tasks."""
        key = xxhash.xxh3_128_hexdigest(b"".join(x.tobytes() for pair in self.counts for x in pair))
        if key not in _grown:
            _grown.clear()
            _grown[key] = [grow(codes, n) for codes, n in self.counts]
        return _grown[key]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def codes_of(text: str) -> np.ndarray:
    """Of each byte with the ORDER bytes before it; ORDER spaces stand in front of the text."""
    data = np.frombuffer((b" " * ORDER + text.encode("utf-8", "surrogatepass")).translate(_FOLD), np.uint8).astype(np.int64)
    n = len(data) - ORDER
    out = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        out = (out << 8) | data[j : j + n]
    return out


def train(docs: DataFrame, limit: int = TRAINING_DOCS) -> Model:
    """Learn from text and lang of documents that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(counts)
    if not langs:
        return Model([], [])
    number = {lang: i for i, lang in enumerate(langs)}
    draws = spark.createDataFrame([(lang, number[lang], min(1.0, limit / n)) for lang, n in counts.items()], "lang string, lang_no int, share double")
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = rows.join(F.broadcast(draws), "lang").where(drawn).select("lang_no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_no, texts = np.array(batch.column("lang_no").to_pylist()), batch.column("text").to_pylist()
            for k in np.unique(lang_no).tolist():
                found, n = np.unique(np.concatenate([codes_of(texts[i]) for i in np.flatnonzero(lang_no == k).tolist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found), pa.array(n)], ["lang_no", "gram", "n"])

    tallied = sample.mapInArrow(count, "lang_no int, gram long, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = []
    for k in range(len(langs)):
        own = tallied[tallied.lang_no == k].sort_values("gram")
        counts.append((own.gram.to_numpy(np.int64), own.n.to_numpy(np.int64)))
    return Model(langs, counts)


def _suffix(codes: np.ndarray, n_bytes: int) -> np.ndarray:
    return codes & ((1 << 8 * n_bytes) - 1)


def grow(codes: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of sorted codes of ORDER + 1 bytes and their counts."""
    tree = Tree([], [], [], [])
    below = np.full(256, 1 / 256)  # of order -1
    shorter = np.arange(256)
    for k in range(ORDER + 1):
        grams, at = np.unique(_suffix(codes, k + 1), return_inverse=True)
        count = np.bincount(at, n, len(grams))
        contexts, of = np.unique(grams >> 8, return_inverse=True)
        total, distinct = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        taken = np.bincount(of, below[np.searchsorted(shorter, _suffix(grams, max(k, 1)))], len(contexts))
        left = np.where(distinct < 256, np.maximum(1 - taken, 1e-12), 0.0)  # exclusion: bytes seen here can't follow an escape
        escape = np.where(left > 0, distinct / (total + distinct), 0.0)
        p = count / total[of] * (1 - escape[of])
        tree.grams.append(grams)
        tree.bits.append(-np.log2(p))
        tree.contexts.append(contexts)
        tree.escapes.append(-np.log2(np.where(left > 0, escape / np.where(left > 0, left, 1), 1.0)))
        shorter, below = grams, p
    return tree


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, wanted), max(len(sorted_) - 1, 0))
    return at, sorted_[at] == wanted if len(sorted_) else np.zeros(len(wanted), bool)


def code_length(tree: Tree, codes: np.ndarray, n: np.ndarray) -> float:
    """Bits of the bytes whose codes occur n times."""
    total = 0.0
    for k in range(ORDER, -1, -1):
        at, seen = _find(tree.grams[k], _suffix(codes, k + 1))
        total += float(tree.bits[k][at[seen]] @ n[seen])
        codes, n = codes[~seen], n[~seen]
        if not len(codes):
            return total
        at, seen = _find(tree.contexts[k], _suffix(codes >> 8, k))
        total += float(tree.escapes[k][at[seen]] @ n[seen])
    return total + 8.0 * float(n.sum())


def code_lengths(trees: list[Tree], text: str) -> np.ndarray:
    """Bits of a text under each language's tree."""
    codes, n = np.unique(codes_of(text), return_counts=True)
    return np.array([code_length(t, codes, n) for t in trees])


def predict_language(docs: DataFrame, limit: int = TRAINING_DOCS) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    score is the posterior of the prediction under equal priors, from whole texts' code lengths. Texts that are null or
    have no letter, and all texts where nothing could be learned, give 'und' and 0; ties go to the first name. Rows of a
    null doc_id are neither held out nor learned from. An empty table gives an empty one.
    """
    model = train(docs, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.trees()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, text in enumerate(texts):
                if trees and text and any(map(str.isalpha, text)):
                    bits = code_lengths(trees, text)
                    best = int(np.argmin(bits))
                    langs[i] = model.langs[best]
                    scores[i] = float(1.0 / np.sum(np.exp2(np.maximum(bits[best] - bits, -1000.0))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    inputs = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "text")
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
