"""I-Match fingerprints, in DataFrame functions alone.

A text's terms whose inverse document frequency lies in a band form the lexicon's share of it. The lexicon is split at
random (by hash) into several subsets; for each, a text's distinct terms are sorted and hashed. Two texts are alike in
so far as their subsets' hashes agree, so an edit spoils only the subsets of the terms that it touches. One more hash, of
all distinct terms of the text whatever their frequency, tells texts apart that have few terms or none in the band.

The lexicon is bounded whatever the corpus: a term of idf <= max_idf occurs in a share exp(-max_idf) of the documents
at least, so there are at most exp(max_idf) times as many as a document has distinct terms on average. It is
gathered once, as a table of hashes by bucket, and looked up in place: texts are neither exploded nor regrouped.

Terms and subsets are compared by 64-bit and 16-bit hashes, and rows are told apart by doc_id and a 64-bit hash of both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.llm.common import stash

#: DRAWS random subsets of the lexicon at each of SHARES, nested: one term of 8, of 32, ... Long texts differ in the
#: wide subsets and compare in the narrow ones, short texts are absent from the narrow ones and compare in the wide ones.
DRAWS, SHARES, DIGITS = 16, (8, 32, 128, 512), 4
#: Draws of one hash of a term, and the bits from one to the next: a draw of the narrowest share reads nine.
DRAWS_A_HASH, STRIDE = 8, 7
MIN_IDF, MAX_IDF = math.log(1 / 0.3), math.log(1 / 0.004)
_BUCKETS = 1 << 14
_EMPTY = "0" * DIGITS


def terms(text: Column) -> Column:
    """Distinct terms of a text, as hashes."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """One row, `lexicon`: hashes of the terms in the band, array by bucket. df counts every row of docs."""
    total = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = df.where(F.col("df").between(math.ceil(total * math.exp(-max_idf)), math.floor(total * math.exp(-min_idf))))
    by_bucket = kept.groupBy(F.pmod("term", F.lit(_BUCKETS)).cast("int").alias("bucket")).agg(F.collect_list("term").alias("found"))
    all_ = docs.sparkSession.range(0, _BUCKETS, 1, 8).select(F.col("id").cast("int").alias("bucket")).join(by_bucket, "bucket", "left")
    none = F.array().cast("array<bigint>")
    return all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("found", none).alias("found")))), lambda s: s.found).alias("lexicon"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: the optimizer would put a column used in one place into a lambda's body,
    where it is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lexicon_terms(own: Column, known: Column) -> Column:
    """Those of a text's distinct terms that are in the lexicon `known`."""
    bucket = lambda t: (F.pmod(t, F.lit(_BUCKETS)) + 1).cast("int")
    return F.filter(own, lambda t: F.array_contains(F.element_at(known, bucket(t)), t))


def _digits(hashes: Column) -> Column:
    """Hex digits of a sorted array of hashes; 0 of an empty one."""
    number = F.pmod(F.xxhash64(hashes), F.lit((1 << 4 * DIGITS) - 1)) + 1
    return F.when(F.size(hashes) == 0, F.lit(_EMPTY)).otherwise(F.lpad(F.lower(F.hex(number)), DIGITS, "0"))


def subset_hashes(used: Column) -> Column:
    """Digits a subset, share by share and draw by draw. Draws read bits of the terms' own hashes, the second half bits of
    hashes of these: a term is in a draw's subset at a share of 1 in n if the draw's lowest log2(n) bits are 0."""
    draws = F.sequence(F.lit(0), F.lit(DRAWS_A_HASH - 1))
    drawn = lambda terms_, k, share: F.filter(terms_, lambda t: F.call_function("shiftright", t, k * STRIDE).bitwiseAND(F.lit(share - 1).cast("long")) == 0)

    def widest(terms_: Column) -> Column:
        return F.transform(draws, lambda k: F.struct(k.alias("k"), drawn(terms_, k, SHARES[0]).alias("s")))

    def at_share(subsets: Column, share: int) -> Column:
        return F.transform(subsets, lambda x: _let(drawn(x.s, x.k, share) if share > SHARES[0] else x.s, _digits))

    def of(terms_: Column) -> Column:
        again = F.array_sort(F.transform(terms_, lambda t: F.xxhash64(t)))
        subsets = _let(again, lambda second: F.concat(widest(terms_), widest(second)))
        return _let(subsets, lambda w: F.array_join(F.concat(*[at_share(w, n) for n in SHARES]), ""))

    return _let(F.array_sort(used), of)


def fingerprint_of(text: Column, known: Column) -> Column:
    """The subsets' digits, and those of all distinct terms."""
    return _let(terms(text), lambda own: F.concat(subset_hashes(lexicon_terms(own, known)), _digits(F.array_sort(own))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of which either text has a term, over the shares at which not every
    subset is used (else the narrowest): wider subsets hold several terms each and say less. The hash of all terms counts
    as one subset more. 1 if neither text has a term."""
    part = lambda x, k: F.substr(x, k * DIGITS + 1, F.lit(DIGITS))
    counts = lambda used, same: F.struct(used.alias("used"), same.alias("same"))
    by_share = []
    for i in range(len(SHARES)):
        numbers = F.sequence(F.lit(i * DRAWS), F.lit((i + 1) * DRAWS - 1))
        used = F.filter(numbers, lambda k: (part(a, k) != _EMPTY) | (part(b, k) != _EMPTY))
        same = F.filter(used, lambda k: part(a, k) == part(b, k))
        by_share.append(counts(F.size(used), F.size(same)))
    counted = F.filter(F.array(*by_share), lambda x, i: (x.used < DRAWS) | (i == len(SHARES) - 1))
    last = F.lit(DRAWS * len(SHARES))
    any_term = (part(a, last) != _EMPTY) | (part(b, last) != _EMPTY)
    whole = counts(any_term.cast("int"), (any_term & (part(a, last) == part(b, last))).cast("int"))
    all_ = F.concat(counted, F.array(whole))
    total = lambda f: F.aggregate(all_, F.lit(0), lambda acc, x: acc + x[f])
    return F.when(~any_term, F.lit(1.0)).otherwise(total("same") / total("used"))


def fingerprints(docs: DataFrame, known: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column (null: empty) added. The lexicon is one value of bounded size that each
    task gets once."""
    lexical = docs.withColumn("imatch_lexicon", known.scalar())
    return lexical.withColumn(name, fingerprint_of(F.coalesce(text, F.lit("")), F.col("imatch_lexicon"))).drop("imatch_lexicon")


def next_documents(keys: DataFrame) -> DataFrame:
    """keys (doc_id, did, th, ...) with next_did and next_th of the row that follows by descending doc_id (nulls last) and
    th; after the last, the first. Ranges of doc_id are sorted apart, and joined by the first row of each range."""
    order = [F.desc_nulls_last("doc_id"), F.desc("th")]
    dealt = stash(keys.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    inside = W.partitionBy("range_no").orderBy(*order)
    own = F.struct("did", "th")
    heads = dealt.withColumn("at", F.row_number().over(inside)).where("at = 1").select("range_no", own.alias("head"))  # a row a range
    by_range = W.orderBy("range_no")
    first = F.first("head").over(by_range.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("range_no", F.coalesce(F.lead("head").over(by_range), first).alias("after"))
    found = dealt.withColumn("follows", F.lead(own).over(inside)).join(F.broadcast(heads), "range_no")
    found = found.withColumn("follows", F.coalesce("follows", "after"))
    return found.select(*keys.columns, F.col("follows.did").alias("next_did"), F.col("follows.th").alias("next_th"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of docs (doc_id, text; other columns are ignored), and its text with the last third
    replaced by the start of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null counts as
    empty. Equal texts have equal fingerprints. Rows of equal doc_id and text count as one document in the order of
    documents, and come back as often as they occur; a null doc_id comes last; a single document follows itself. An empty
    table gives an empty one. Texts without any term are alike (1).

    Whole texts are shuffled once, by row: the same exchange serves as donors of the texts' starts and as their receivers.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("did"), F.xxhash64("doc_id", "text").alias("th")]
    rows = ids.select(*key, "text")
    known = stash(lexicon(rows.select("text")))
    keys = ids.select("doc_id", *key, F.char_length("text").cast("long").alias("n_chars")).distinct()
    follow = stash(next_documents(keys).withColumn("take", F.floor(F.col("n_chars") / 3).cast("int")))

    asked = follow.select(F.col("next_did").alias("did"), F.col("next_th").alias("th"), F.col("did").alias("to_did"), F.col("th").alias("to_th"), "take")
    tails = rows.join(asked, ["did", "th"]).select(F.col("to_did").alias("did"), F.col("to_th").alias("th"), F.left("text", F.col("take")).alias("tail"))
    tails = tails.groupBy("did", "th").agg(F.first("tail").alias("tail"))  # a repeated row gives the same tail as often
    both = rows.join(tails, ["did", "th"])
    n = F.char_length("text")
    both = both.withColumn("edited", F.concat(F.left("text", (n - F.floor(n / 3)).cast("int")), "tail"))
    out = fingerprints(fingerprints(both, known, "text", "fingerprint"), known, "edited", "edited_fingerprint")
    out = stash(out.select("did", "th", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"))

    others = out.groupBy(F.col("did").alias("next_did"), F.col("th").alias("next_th")).agg(F.first("fingerprint").alias("next_fingerprint"))
    after = follow.join(others, ["next_did", "next_th"]).select("did", "th", "doc_id", "n_chars", "next_fingerprint")
    return out.join(after, ["did", "th"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
