"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Slots are handed out one block of documents at a time. Block j (from 0) of a source of weight w is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); each slot takes, of the released blocks, the one due first, ties to the
first source. With that every block is in time, so after any number of slots a source is less than one block off its
weight's share, for exact weights and however long the mix (quotients within 1e-6 of a whole number count as whole).

Slots are folded in chunks, each in its own row, and what comes out is the schedule of one run through all slots. A chunk's
opening state is guessed: some slots earlier, every source has the whole blocks of its share, and the places left over
go to the blocks due first (from such a state no deadline is missed). Two runs from different states take the same blocks
as soon as the blocks in which they differ are taken, by the later of their deadlines at the latest: a few slots of
warming up bring nearly every guess to the one state. Then each chunk's opening is held against the end of the chunk
before, and chunks that differ are folded again from it, until none does.

The mix at the target weights ends before a source could run out. What is left goes on in phases, each of which ends where
a source has run out by the clock; in a phase, blocks are scheduled the same way, by their shares of that phase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.llm.common import global_rank, stash

#: Slots that are folded in one row; the schedule doesn't depend on it.
PERIOD = 1000
#: Slots before a chunk from which its opening state is guessed; the schedule doesn't depend on it either.
WARM_UP = 200
BLOCK_DOCS = 4
#: Chunks that a task folds, where there are many more of them than cores.
PERIODS_A_TASK = 50
SMOOTHING = 0.7
_LATER = 1 << 60
_EPS = 1e-6


def _key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def source_weights(docs: DataFrame, smoothing: float = SMOOTHING, targets: DataFrame | None = None) -> DataFrame:
    """One row a source: source_key, n_docs, target (they sum to one).

    Targets are given as (source, weight), or a source's number of documents to the power of `smoothing`. Sources without
    a target, or with one that isn't positive, have no row; a null source is a source of its own.
    """
    sizes = docs.groupBy(_key(F.col("source")).alias("source_key")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(smoothing)))
    else:
        given = targets.groupBy(_key(F.col("source")).alias("source_key")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = sizes.join(given, "source_key").where("weight > 0")
    everything = W.partitionBy(F.lit(0))  # a row a source
    return weighted.select("source_key", "n_docs", (F.col("weight") / F.sum("weight").over(everything)).alias("target"))


def _whole(quotient) -> F.Column:
    return F.floor(quotient + F.lit(_EPS))


def _whole_up(quotient) -> F.Column:
    return F.ceil(quotient - F.lit(_EPS))


def _slots(first, end) -> F.Column:
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def _earliest_due(done):
    """Place in s of the source whose next block is due first of those released by a slot."""

    def pick(slot):
        n = lambda i: F.element_at(done, i + 1)
        late = lambda x, i: F.when(_whole(n(i) / x.target) <= slot, F.lit(0)).otherwise(F.lit(_LATER))
        due = F.transform(F.col("s"), lambda x, i: F.struct((_whole_up((n(i) + 1) / x.target) + late(x, i)).alias("by"), i.alias("i")))
        return F.array_min(due).i

    return pick


def _taken(done, pick):
    return F.transform(done, lambda d, i: F.when(i == pick, d + 1).otherwise(d))


def _warm(first, end) -> F.Column:
    """Blocks that each source has at slot `end`, folded from the guess at slot `first`."""
    whole = F.transform("s", lambda x: _whole(x.target * first))
    left = first - F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x)
    open_blocks = F.filter(F.transform("s", lambda x, i: F.struct(_whole_up((_whole(x.target * first) + 1) / x.target).alias("by"), i.alias("i"), (x.target * first - _whole(x.target * first)).alias("part"))), lambda o: o.part > _EPS)
    ahead = F.transform(F.slice(F.array_sort(open_blocks), F.lit(1), F.greatest(left, F.lit(0)).cast("int")), lambda o: o.i)
    guess = F.transform(whole, lambda d, i: F.when(F.array_contains(ahead, i), d + 1).otherwise(d))
    return F.aggregate(_slots(first, end), guess, lambda done, slot: _taken(done, _earliest_due(done)(slot)))


def _fold(chunks: DataFrame) -> DataFrame:
    """Chunks (system, chunk, s, first, end, opening) with their order, the source (its place in s) and turn of every slot,
    and closing, the blocks that each source has at their end."""

    def step(state, slot):
        pick = _earliest_due(state.done)(slot)
        turn = F.element_at(state.done, pick + 1)
        return F.struct(_taken(state.done, pick).alias("done"), F.concat(state.order, F.array(F.struct(pick.alias("i"), turn.alias("turn")))).alias("order"))

    start = F.struct(F.col("opening").alias("done"), F.array().cast("array<struct<i:int,turn:bigint>>").alias("order"))
    state = chunks.withColumn("state", F.aggregate(_slots(F.col("first"), F.col("end")), start, step))
    return state.select("system", "chunk", "first", "end", "opening", F.col("state.order").alias("order"), F.col("state.done").alias("closing"))


def edf_schedule(systems: DataFrame, period: int = PERIOD, warm_up: int = WARM_UP) -> DataFrame:
    """Chunks of the schedules of systems (system, length, s: array of source_key and target, which sum to one), earliest
    deadline first over `length` slots: system, chunk, first and end slot, opening, order, closing, as in _fold."""
    spark = systems.sparkSession
    counts = systems.where("length > 0").select("system", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / period))).alias("chunk"))
    counts = stash(counts)
    n_chunks, cores = counts.count(), spark.sparkContext.defaultParallelism
    # a chunk is few bytes but many steps: by size alone, all chunks would be put together into one task
    tasks = max(1, min(n_chunks, max(4 * cores, n_chunks // PERIODS_A_TASK)))
    with_sources = lambda chunks: chunks.repartition(tasks, "system", "chunk").join(systems.select("system", "s"), "system")
    spans = counts.select("system", "chunk", (F.col("chunk") * period).alias("first"), F.least((F.col("chunk") + 1) * period, "length").alias("end"))
    guessed = with_sources(spans).withColumn("opening", _warm(F.greatest(F.col("first") - warm_up, F.lit(0).cast("long")), F.col("first")))
    folded = stash(_fold(guessed))
    while True:
        ends = folded.select("system", (F.col("chunk") + 1).alias("chunk"), F.col("closing").alias("true_opening"))
        wrong = stash(folded.join(ends, ["system", "chunk"]).where("opening != true_opening").select("system", "chunk", "first", "end", F.col("true_opening").alias("opening")))
        if wrong.isEmpty():
            return folded
        again = _fold(with_sources(wrong))
        folded = stash(folded.join(wrong.select("system", "chunk"), ["system", "chunk"], "left_anti").unionByName(again))


def _handed_out(folded: DataFrame, systems: DataFrame) -> DataFrame:
    """(system, source_key, target, turn, slot_in_system) of every slot."""
    slots = folded.select("system", "first", F.posexplode("order").alias("at", "o"))
    sources = systems.select("system", F.posexplode("s").alias("i", "x"))
    return slots.join(sources, (slots.system == sources.system) & (F.col("o.i") == F.col("i"))).select(
        slots.system, F.col("x.source_key").alias("source_key"), F.col("x.target").alias("target"), F.col("o.turn").alias("turn"), (F.col("first") + F.col("at")).alias("slot_in_system")
    )


def period_schedule(weights: DataFrame) -> DataFrame:
    """(source_key, turn, slot_in_period): earliest deadline first over one period of sources with `parts` slots of the
    `period`; ties go to the first source_key."""
    share = F.struct("source_key", (F.col("parts") / F.col("period")).alias("target"))
    system = weights.where("parts > 0").groupBy(F.lit(0).cast("long").alias("system")).agg(F.array_sort(F.collect_list(share)).alias("s"), F.max("period").alias("length"))
    return _handed_out(edf_schedule(system), system).select("source_key", "turn", F.col("slot_in_system").alias("slot_in_period"))


def block_slots(weights: DataFrame, blocks: DataFrame, period: int = PERIOD, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source_key, block, release, deadline, slot, gone) of all blocks (source_key, block) of the sources in weights; gone
    is 0 in the mix at the target weights, and after it 1 and the number of times at which sources have run out since."""
    sized = weights.select("source_key", "target", F.ceil(F.col("n_docs") / block_docs).alias("blocks"))
    share = F.struct("source_key", "target")
    mixed = stash(sized.groupBy(F.lit(0).cast("long").alias("system")).agg(F.array_sort(F.collect_list(share)).alias("s"), _whole(F.min(F.col("blocks") / F.col("target"))).alias("length")))
    length = next((r.length for r in mixed.select("length").collect()), 0)
    folded = edf_schedule(mixed, period)

    last = folded.where(F.col("end") == length).join(mixed.select("system", "s"), "system").select(F.explode(F.arrays_zip("s", "closing")).alias("z"))
    taken = last.select(F.col("z.s.source_key").alias("source_key"), F.col("z.closing").alias("taken"))
    rest = stash(sized.join(taken, "source_key", "left").fillna(0, ["taken"]).where("blocks > taken"))
    ends = rest.select(((F.col("blocks") - F.col("taken")) / F.col("target")).alias("end")).distinct().agg(F.array_sort(F.collect_list("end")).alias("ends"))
    # a phase in which a source ends has, by the clock, all of its blocks that stand before that end
    until = lambda e: F.least(F.col("blocks") - F.col("taken"), F.ceil(e * F.col("target") - 0.5 - _EPS))
    since = lambda i: F.when(i == 0, F.lit(0)).otherwise(until(F.element_at("ends", i)))
    spans = F.transform("ends", lambda e, i: F.struct((i + 1).cast("long").alias("system"), since(i).alias("from"), (until(e) - since(i)).alias("parts")))
    parts = rest.join(F.broadcast(ends)).select("source_key", "taken", F.explode(F.filter(spans, lambda x: x.parts > 0)).alias("x"))
    parts = stash(parts.select("x.system", "source_key", (F.col("taken") + F.col("x.from")).alias("first_block"), F.col("x.parts").alias("parts")))
    lengths = parts.groupBy("system").agg(F.sum("parts").alias("length"))
    in_order = W.partitionBy(F.lit(0)).orderBy("system")  # a row a phase
    starts = stash(lengths.withColumn("start", F.lit(length) + F.sum("length").over(in_order) - F.col("length")))
    shares = parts.join(starts, "system").withColumn("target", F.col("parts") / F.col("length"))
    phases = stash(shares.groupBy("system", "length").agg(F.array_sort(F.collect_list(share)).alias("s")))
    first = _handed_out(folded, mixed).select("*", F.lit(0).cast("long").alias("first_block"), F.lit(0).cast("long").alias("start"))
    later = _handed_out(edf_schedule(phases, period), phases).join(shares.select("system", "source_key", "first_block", "start"), ["system", "source_key"])
    turns = first.unionByName(later)
    return turns.select(
        "source_key", (F.col("first_block") + F.col("turn")).alias("block"),
        (F.col("start") + _whole(F.col("turn") / F.col("target"))).alias("release"),
        (F.col("start") + _whole_up((F.col("turn") + 1) / F.col("target"))).alias("deadline"),
        (F.col("start") + F.col("slot_in_system")).alias("slot"), F.col("system").alias("gone"),
    )


def mix(docs: DataFrame, smoothing: float = SMOOTHING, targets: DataFrame | None = None, block_docs: int = BLOCK_DOCS, seed: int = 23, period: int = PERIOD) -> DataFrame:
    """Each row of docs with its place in the mix.

    Returns doc_id, th (hash of the text), source, block (of its source, in a seeded random order), release, deadline,
    slot, place (in the block) and in_mix. A source that runs out hands its slots to the others, so all rows of sources
    with a target have a slot and no source ends the mix. Only where targets are given, in_mix tells the rows up to the
    slot from which a source is missing, as the given targets can't be held from there on; else it is all rows. Rows of
    sources without a target have no slot. Nulls in any column, repeated rows and ids are placed like any other; texts
    are only hashed; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("source").cast("string").alias("source"))
    rows = rows.withColumn("source_key", _key(F.col("source"))).withColumn("order_hash", F.xxhash64(F.lit(seed), "doc_id", "th"))
    weights = stash(source_weights(rows, smoothing, targets))
    ranked = global_rank(rows, ["source_key"], ["order_hash", "doc_id", "th"]).withColumn("block", F.floor(F.col("rank_in_group") / block_docs))
    ranked = stash(ranked.withColumn("place", F.pmod("rank_in_group", F.lit(block_docs)).cast("int")).drop("rank_in_group", "order_hash"))
    slots = block_slots(weights, ranked.where("place = 0").select("source_key", "block"), period, block_docs)
    held = F.lit(True) if targets is None else F.col("gone") == 0
    return ranked.join(slots, ["source_key", "block"], "left").select(
        "doc_id", "th", "source", "block", "release", "deadline", "slot", "place", (F.col("slot").isNotNull() & F.coalesce(held, F.lit(False))).alias("in_mix")
    )


def mix_positions(docs: DataFrame, name: str = "mix_position", **options) -> DataFrame:
    """docs in the mix, all columns, with their place in its order added as the column `name` (gaps are possible). Repeated
    rows stand where the first of them does. A column of that name is replaced."""
    block_docs = options.get("block_docs", BLOCK_DOCS)
    placed = mix(docs, **options).where("in_mix").groupBy("doc_id", "th", "source").agg(F.min(F.col("slot") * block_docs + F.col("place")).alias("mix_at"))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != name]).alias("own"))  # whatever the caller's columns are named
    own = lambda c: F.col("own").getField(c)
    same = own("doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(own("text")) == F.col("th")) & own("source").cast("string").eqNullSafe(F.col("source"))
    return keyed.join(placed, same).select("own.*", F.col("mix_at").alias(name))


def keep_mix(docs: DataFrame, **options) -> DataFrame:
    """docs in the mix, sorted by slot; all columns stay. Files don't promise the order to who reads them: mix_positions()
    of the rows gives it again, as it depends on nothing but the rows."""
    ordered = mix_positions(docs, "_mix_order", **options)
    return ordered.orderBy("_mix_order").select(*docs.columns)
