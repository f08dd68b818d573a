"""Vector codes: integer parts, and one codebook for each position of a part.

Equal parts of a position are first put together into one weighted row, so that what Lloyd's rounds read is as small
as the vectors allow and a part that very many vectors share costs one row. A round assigns the distinct rows to the
entries (tasks emit sums per entry, not rows) and moves the entries; codebooks are bounded by parts x entries and go
to the tasks with the plan. Codes and errors are then joined back to the vectors by position and part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.common import stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are held within this bound, so that all sums and distances are exact 64-bit integers.
BOUND = 1 << 28
#: A key with more than this share of all rows is looked up by broadcast: there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000
_CHUNK = 4096


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(row_id, own, vec): the rows that can be coded, own being all their columns, vec the integer components."""
    own = F.struct(*[F.col(c) for c in vectors.columns]).alias("own")
    x = F.col("own").getField(vector_column).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int")
    kept = vectors.select(own).where(x.isNotNull() & F.forall(x, finite) & (F.size(x) > 0))
    return kept.select("own", F.transform(x, whole).alias("vec"))


def cut(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book for each row (ties: the lowest) and the squared distance, exactly."""
    index, error = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    if not values.shape[1]:
        return index, error
    most = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * values.shape[1] * most * most < 1 << 53  # then every partial sum is a whole number that a double holds
    for lo in range(0, len(values), _CHUNK):
        v = values[lo : lo + _CHUNK]
        if exact:
            f, b = v.astype(np.float64), book.astype(np.float64)
            found = ((b * b).sum(1) - 2 * (f @ b.T)).argmin(1)
        else:
            found = np.stack([((v - e) ** 2).sum(1) for e in book], 1).argmin(1)
        index[lo : lo + _CHUNK] = found
        error[lo : lo + _CHUNK] = ((v - book[found]) ** 2).sum(1)
    return index, error


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.int64)
    return flat.reshape(len(column), -1)


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    positions = batch.column("pos").to_numpy()
    for p in np.unique(positions).tolist():
        yield p, np.flatnonzero(positions == p)


def _sums(books: list[np.ndarray]):
    """Sums and weights of the parts of each entry, added up over a whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, np.int64) for b in books]
        weights = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for p, at in _by_position(batch):
                values, weight = _rows(batch.column("part").take(pa.array(at))), batch.column("weight").to_numpy()[at]
                index, _ = nearest(values, books[p])
                np.add.at(totals[p], index, values * weight[:, None])
                np.add.at(weights[p], index, weight)
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(weights[p]).tolist()]
        columns = [[p for p, _ in used], [e for _, e in used], [totals[p][e].tolist() for p, e in used], [int(weights[p][e]) for p, e in used]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["pos", "entry", "total", "weight"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, at in _by_position(batch):
                codes[at], errors[at] = nearest(_rows(batch.column("part").take(pa.array(at))), books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32()), pa.array(errors)], [*batch.schema.names, "entry", "part_error"])

    return run


def _moved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: entries become the componentwise floor of the mean of their parts; unused ones stay."""
    sums = distinct.mapInArrow(_sums(books), "pos int, entry int, total array<bigint>, weight bigint")
    total = sums.select("pos", "entry", "weight", F.posexplode("total").alias("place", "part_sum"))
    added = total.groupBy("pos", "entry", "place").agg(F.sum("part_sum").alias("s"), F.sum("weight").alias("w"))
    new = [b.copy() for b in books]
    for r in added.collect():  # a row for each component of each entry at most
        new[r.pos][r.entry, r.place] = r.s // r.w
    return new


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int) -> DataFrame:
    """left joined with right, which is unique by keys and has every key of left. Keys with more than HEAVY of the rows are
    fewer than 1 / HEAVY and are broadcast; the others are joined by a shuffle, where none of them is hot."""
    is_heavy = F.col(weight) > HEAVY * rows
    heavy = F.broadcast(right.where(is_heavy).drop(weight))
    light = right.where(~is_heavy).drop(weight)
    return left.join(heavy, keys).unionByName(left.join(F.broadcast(right.where(is_heavy).select(*keys)), keys, "left_anti").join(light, keys))


def fit_codebooks(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    for _ in range(rounds):
        books = _moved(distinct, books)
    return books


def compress_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(coded, codebooks): the rows of vectors that can be coded, as columns own (all their columns), codes (an entry of
    each position's codebook) and error (squared distances summed over the parts); and the codebooks, one array of
    entries x components a position.

    A component x is floor(scale * x), held within BOUND (|x| of 262,144 at the default scale). Codebooks start as the parts of the `entries`
    smallest ids (fewer, if there are fewer rows; ties of an id by components; null ids last). Rows are dropped whose
    vector is null, empty, holds a null or non-finite component, or isn't as long as that of the smallest id. Repeated
    rows, and rows without an id, are coded one by one. A length that `parts` doesn't divide is cut at the floors of
    equal shares. An empty table gives an empty one and codebooks without entries.
    """
    spark = vectors.sparkSession
    able = integer_vectors(vectors, id_column, vector_column, scale)
    order = [F.col("own").getField(id_column).asc_nulls_last()]
    first = able.orderBy(*order).limit(1).select(F.size("vec").alias("n")).first()
    length = first.n if first else 0
    kept = stash(able.where(F.size("vec") == length).withColumn("row_id", F.monotonically_increasing_id()))
    starts = [r.vec for r in kept.orderBy(*order, "vec").limit(entries).select("vec").collect()]
    cuts = cut(length, parts)
    books = [np.array([s[a:b] for s in starts], np.int64).reshape(len(starts), b - a) for a, b in zip(cuts, cuts[1:])]
    pieces = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("vec", a + 1, b - a).alias("part")) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    exploded = kept.select("row_id", F.explode(pieces).alias("piece")).select("row_id", "piece.pos", "piece.part")
    distinct = stash(exploded.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    rows = kept.count()
    if rows:
        books = fit_codebooks(distinct, books, rounds)
    coded = stash(distinct.mapInArrow(_codes(books), "pos int, part array<int>, weight long, entry int, part_error long"))
    joined = lookup(exploded, coded, ["pos", "part"], "weight", rows)
    per_row = joined.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("found"), F.sum("part_error").alias("error"))
    return kept.select("row_id", "own").join(per_row, "row_id").select("own", F.col("found.entry").alias("codes"), "error"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the components of all entries, by position, entry and place, in decimal and joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over the rows of a label, null being a
    label of its own) and codebooks_sha256, for the rows (vec_id, embedding, label) that compress_vectors() codes."""
    coded, books = compress_vectors(vectors)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    key = F.coalesce(F.concat(F.lit("="), F.col("own.label").cast("string")), F.lit("null"))
    flat = stash(coded.select(F.col("own.vec_id").alias("vec_id"), code.alias("code"), "error", key.alias("label_key")))
    labels = flat.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    found = lookup(flat, labels, ["label_key"], "n", flat.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The same codes by plain joins of every part with every entry, a set of tables a round."""
    nearest_sql = """
    a{i} AS (SELECT pos, row_id, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY pos, row_id ORDER BY d, entry) AS best FROM (
        SELECT p.pos, p.row_id, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{i} b ON p.pos = b.pos AND p.place = b.place GROUP BY ALL)) WHERE best = 1)"""
    moved_sql = """
    m{i} AS (SELECT a.pos, a.entry, p.place, floor_div(sum(p.x), count(*)) AS x FROM a{i} a JOIN p ON a.pos = p.pos AND a.row_id = p.row_id GROUP BY ALL),
    b{j} AS (SELECT b.pos, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.pos = b.pos AND m.entry = b.entry AND m.place = b.place)"""
    steps = []
    for i in range(ROUNDS):
        steps += [nearest_sql.format(i=i), moved_sql.format(i=i, j=i + 1)]
    steps.append(nearest_sql.format(i=ROUNDS))
    # // truncates in this dialect: the remainder tells where the floor is one lower
    text = ",".join(steps).replace("floor_div(sum(p.x), count(*))", "CAST(sum(p.x) AS BIGINT) // count(*) - CASE WHEN CAST(sum(p.x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END")
    return text.replace("sum((p.x - b.x) * (p.x - b.x))", "CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT)")


SQL = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT row_id, i // (len(e) // {PARTS}) AS pos, i % (len(e) // {PARTS}) AS place, CAST(floor(CAST(e[i + 1] AS DOUBLE) * {SCALE}) AS BIGINT) AS x
        FROM (SELECT row_id, e, unnest(range(len(e))) AS i FROM k)),
    b0 AS (SELECT pos, row_id AS entry, place, x FROM p WHERE row_id < {ENTRIES}),{_rounds_sql()},
    c AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN k USING (row_id)"""
