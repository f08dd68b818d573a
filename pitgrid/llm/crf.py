"""Quality rules: base counts of a text, and line labelling by a linear-chain conditional random field.

Each line is content or boilerplate. A two-state chain scores lines by features of their words and characters and
neighbouring labels by transitions; Viterbi decoding labels the lines of a whole text, and a text stays if the lines
labelled content hold a sufficient share of its words. The chain is fitted by penalised likelihood on a bounded sample
of labelled documents (their label is that of their lines), starting from, and drawn towards, PRIOR.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import small_batches

#: Bound of the labelled sample.
TRAINING_DOCS = 1500
#: Lines that a document teaches at most.
TRAINING_LINES = 300
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))

FEATURES = ("bias", "blank", "few_words", "symbols", "shouting", "exclamations", "digits", "repeated_line", "repeated_words", "long_words", "few_distinct", "markup")
#: Log-odds of content by feature before any label is seen.
PRIOR = np.array([2.0, -1.0, -0.5, -25.0, -6.0, -25.0, -8.0, -3.0, -4.0, -4.0, -2.0, -4.0])
PRIOR_STAY = 0.7


@dataclass(frozen=True)
class Chain:
    """weights: log-odds of content by feature; moves[a][b]: score of label b after a (0 boilerplate, 1 content)."""

    weights: np.ndarray
    moves: np.ndarray

    @staticmethod
    def prior() -> Chain:
        return Chain(PRIOR.copy(), np.array([[PRIOR_STAY, 0.0], [0.0, PRIOR_STAY]]))

    def viterbi(self, features: np.ndarray) -> list[int]:
        scores = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + s
        out = [int(b >= a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def repeated_words(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """True for each word in a window of words that the text has twice or more."""
    n = len(words) - window + 1
    out = np.zeros(len(words), dtype=bool)
    if n < 2:
        return out
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    names = ids[:n]
    for k in range(1, window):  # exact: windows are numbered level by level
        pairs = names * np.uint64(len(number) + 1) + ids[k : k + n] if names.max() < (1 << 62) // (len(number) + 1) else None
        if pairs is None:
            names = np.unique(names, return_inverse=True)[1].astype(np.uint64)
            pairs = names * np.uint64(len(number) + 1) + ids[k : k + n]
        names = pairs
    _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def describe(text: str) -> tuple[dict, list[int], np.ndarray]:
    """Base counts of a text, words by line, and the lines' features."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    split = [line.split() for line in lines]  # bytes.split() cuts at \x20 and \x09-\x0D
    words = [w for line in split for w in line]
    repeats = repeated_words(words)
    covered = np.concatenate(([0], np.cumsum(repeats)))
    seen: set[bytes] = set()
    rows, per_line, at, dup = [], [], 0, 0
    for line, ws in zip(lines, split):
        n = len(ws)
        again = n > 0 and line in seen
        seen.add(line)
        dup += again
        per_line.append(n)
        if not n:
            rows.append((1.0, 1.0) + (0.0,) * 10)
            continue
        size = len(line)
        upper, lower = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER))
        repeat = int(covered[at + n] - covered[at]) / n
        at += n
        rows.append((
            1.0, 0.0, 1.0 if n < 3 else 0.0,
            min(1.0, (size - len(line.translate(None, SYMBOLS))) / size * 4),
            upper / (upper + lower) if upper + lower > 2 * n or upper + lower > 20 else 0.0,
            line.count(b"!") / size,
            (size - len(line.translate(None, _DIGIT))) / size,
            float(again), repeat,
            min(1.0, sum(len(w) > 30 for w in ws) / n * 4),
            1.0 - len(set(ws)) / n if n >= WINDOW else 0.0,
            float(b"http" in line or b"</" in line or b"{" in line),
        ))
    chars = len(text) - sum(map(text.count, _BLANK))
    base = {"n_words": len(words), "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": int(covered[-1])}
    return base, per_line, np.array(rows)


def base_fails(base: dict) -> bool:
    return base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"]


def fit(sequences: list[tuple[np.ndarray, int]], rounds: int = 250, rate: float = 0.15, pull: float = 2.0) -> Chain:
    """Penalised maximum likelihood by Adam; (features of the lines, label of all of them) a document.

    Chains are walked step by step together, longest first, so each step is one array operation.
    """
    chain = Chain.prior()
    if len({y for _, y in sequences}) < 2:
        return chain
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(f) for f, _ in sequences])
    labels = np.array([y for _, y in sequences])
    steps = int(lengths[0])
    alive = [int(np.sum(lengths > t)) for t in range(steps)]
    by_step = [np.array([f[t] for f, _ in sequences[: alive[t]]]) for t in range(steps)]
    share = 1.0 / lengths  # a document counts once, however long
    w, moves = chain.weights.copy(), chain.moves.copy()
    start = np.concatenate([w, moves.ravel()])
    theta, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    d = len(w)
    for r in range(1, rounds + 1):
        w, moves = theta[:d], theta[d:].reshape(2, 2)
        score = [np.stack([np.zeros(alive[t]), by_step[t] @ w], 1) for t in range(steps)]
        alpha = [score[0]]
        for t in range(1, steps):
            before = alpha[-1][: alive[t], :, None] + moves
            alpha.append(np.logaddexp(before[:, 0], before[:, 1]) + score[t])
        beta = [None] * steps
        beta[-1] = np.zeros((alive[-1], 2))
        for t in range(steps - 1, 0, -1):
            after = moves + (score[t] + beta[t])[:, None, :]
            back = np.zeros((alive[t - 1], 2))
            back[: alive[t]] = np.logaddexp(after[:, :, 0], after[:, :, 1])
            beta[t - 1] = back
        z = np.logaddexp(*(alpha[0] + beta[0]).T)
        grad = np.zeros_like(theta)
        for t in range(steps):
            k = alive[t]
            p = np.exp(alpha[t] + beta[t] - z[:k, None])[:, 1]
            grad[:d] += ((labels[:k] - p) * share[:k]) @ by_step[t]
            if t:
                pair = np.exp(alpha[t - 1][:k, :, None] + moves + (score[t] + beta[t])[:, None, :] - z[:k, None, None])
                seen = np.zeros((k, 2, 2))
                seen[np.arange(k), labels[:k], labels[:k]] = 1
                grad[d:] += np.einsum("k,kab->ab", share[:k], seen - pair).ravel()
        grad -= pull * (theta - start) / 4
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Chain(theta[:d].copy(), theta[d:].reshape(2, 2).copy())


def training_sequences(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCS, most_lines: int = TRAINING_LINES) -> list[tuple[np.ndarray, int]]:
    """Line features of at most `limit` labelled documents, those of the smallest seeded hash of doc_id.

    Of a document with more than most_lines lines, as many in a row are taken, from a place that its id's CRC-32 picks; the
    sample is bounded so in documents and in lines. Documents that fail the base rules teach nothing about lines and are left out. Of labels that conflict the lower counts.
    """
    small_batches(docs.sparkSession)
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    picked = picked.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ys = [], []
            for doc_id, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                base, _, features = describe(text or "")
                if not base_fails(base):
                    first = zlib.crc32(str(doc_id).encode()) % max(1, len(features) - most_lines + 1)
                    features = features[first : first + most_lines]
                    found.append(features.ravel().tolist())
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["label", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "label int, features array<double>").collect()
    return sorted(((np.array(r.features).reshape(-1, len(FEATURES)), r.label) for r in rows), key=lambda s: (len(s[0]), s[1], s[0].sum()))


def judge(docs: DataFrame, chain: Chain, min_share: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, content_lines, content_share.

    Whole texts; null counts as empty (no words: base_failed, not kept). Repeated rows and rows of a null doc_id are
    judged one by one, other columns ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_lines", "content_share"]
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_lines long, content_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, per_line, features = describe(text or "")
                marks = chain.viterbi(features)
                share = sum(n for n, y in zip(per_line, marks) if y) / max(1, base["n_words"])
                failed = base_fails(base)
                for col, v in zip(out, (doc_id, *base.values(), failed, not failed and share >= min_share, len(marks), sum(marks), share)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge() with a chain fitted on the labelled documents; without labels of both kinds, with the prior's chain."""
    return judge(docs, fit(training_sequences(docs, labels)))


def keep_good(docs: DataFrame, labels: DataFrame, min_share: float = 0.5) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay. The verdict is a function of the text alone."""
    small_batches(docs.sparkSession)
    chain = fit(training_sequences(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                base, per_line, features = describe(text or "")
                content = sum(n for n, y in zip(per_line, chain.viterbi(features)) if y)
                keep.append(not base_fails(base) and content >= min_share * base["n_words"])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
