"""Secret scans: patterns with known forms, and a battery of randomness tests for what has none.

Candidate tokens (long runs of code characters with letters and digits) are read in the encoding that their characters
suggest. Three tests ask whether the symbols are uniform and independent, as those of generated keys are: chi-squared
over equal parts of the alphabet and over its kinds of characters, Wald-Wolfowitz runs about the middle of the alphabet
and of kinds, and lag-one serial correlation. A token's randomness is the Bonferroni combination of their p-values.

What is controlled is the rate of false secrets among those reported. The null hypothesis of a token is therefore that it
was put together from words, as identifiers, slugs and file names are: every document gives decoys, runs of its own words
and a number joined to the lengths of each class, and some made of syllables by rule stand in where documents are few.
The share of a class's decoys that look at least as random as a token is its p-value, and the Benjamini-Hochberg procedure
over all tokens of the class decides at `rate`. A class is an encoding and a range of lengths: longer tokens and richer
alphabets give the tests more power, so classes are not mixed. Short tokens of lower-case letters and digits, which the
battery can't tell from joined words, are not reported.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.llm.common import small_batches, stash

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
LENGTH_CLASSES = (32, 48, 64, 128)
#: Levels a decade of p-values. Bounds what the procedure sorts; levels are rounded against reporting.
LEVELS, LEAST_P = 100, 1e-300
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,15}(?![A-Za-z0-9])", re.ASCII)
#: Decoys a class made by rule.
RULE_DECOYS = 300

#: Encodings in the order in which they are tried: name, characters by value.
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", _DIG + "abcdef"),
    ("hex", _DIG + "ABCDEF"),
    ("base32", _UP + "234567"),
    ("base36", _DIG + _LOW),
    ("base36", _DIG + _UP),
    ("base62", _UP + _LOW + _DIG),
    ("base64", _UP + _LOW + _DIG + "+/"),
    ("base64url", _UP + _LOW + _DIG + "-_"),
    ("mixed", _UP + _LOW + _DIG + "+/-_"),
)
FAMILIES = {"hex": 0, "base32": 1, "base36": 2, "base62": 3, "base64": 4, "base64url": 4, "mixed": 4}
CLASSES = 5 * (len(LENGTH_CLASSES) + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the known forms; leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of a chi-squared variable, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 400):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, h * scale)


def encoding(token: str) -> tuple[str, str]:
    """Name and alphabet of the first encoding that has all the token's characters."""
    body = set(token.rstrip("="))
    return next((e for e in ENCODINGS if not body - set(e[1])), ENCODINGS[-1])


def token_class(token: str) -> int:
    return FAMILIES[encoding(token)[0]] * (len(LENGTH_CLASSES) + 1) + sum(len(token) >= c for c in LENGTH_CLASSES)


def kind_runs(body: str, shares: list[float]) -> float:
    """Two-sided p-value of the number of runs of upper-case, lower-case and other characters, if independent."""
    n = len(body)
    of = ["U" if c in _UP else "L" if c in _LOW else "O" for c in body]
    q = 1 - sum(x * x for x in shares)
    both = sum(x * (1 - x) ** 2 for x in shares)
    var = (n - 1) * q * (1 - q) + 2 * (n - 2) * (both - q * q)
    changes = sum(x != y for x, y in zip(of, of[1:]))
    return math.erfc(abs(changes - (n - 1) * q) / math.sqrt(2 * var)) if var > 0 else 1.0


def randomness(token: str) -> float:
    """Combined p-value of the tests against uniform, independent symbols of the inferred encoding."""
    body = token.rstrip("=")
    alphabet = encoding(token)[1]
    v = [alphabet.index(c) for c in body]
    n, m = len(v), len(alphabet)
    parts = max(2, min(m, n // 5, 16))
    expected = [0] * parts
    counts = [0] * parts
    for s in range(m):
        expected[s * parts // m] += 1
    for s in v:
        counts[s * parts // m] += 1
    p = [chi2_tail(sum((c - n * e / m) ** 2 / (n * e / m) for c, e in zip(counts, expected)), parts - 1)]
    kinds = [(sum(c in k for c in alphabet), sum(c in k for c in body)) for k in (_UP, _LOW)]
    kinds.append((m - sum(e for e, _ in kinds), n - sum(c for _, c in kinds)))
    kinds = [(n * e / m, c) for e, c in kinds if e]
    if len(kinds) > 1:
        p.append(chi2_tail(sum((c - e) ** 2 / e for e, c in kinds), len(kinds) - 1))
        p.append(kind_runs(body, [e / n for e, _ in kinds]))
    high = [s >= m // 2 for s in v]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    mid = sum(v) / n
    spread = sum((s - mid) ** 2 for s in v)
    r = sum((s - mid) * (t - mid) for s, t in zip(v, v[1:])) / spread if spread else 1.0
    p.append(math.erfc(abs(r) * math.sqrt(n / 2)))
    return min(1.0, len(p) * min(p))


def level(p: float, up: bool) -> int:
    """-LEVELS times the decimal logarithm of p: 0 is wholly random."""
    x = -LEVELS * math.log10(max(p, LEAST_P))
    return math.ceil(x) if up else math.floor(x)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, class, level) of each token that may be a key."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if any(c in _DIG for c in t) and t.lower() != t.upper():
            out.append((m.start(), m.end(), token_class(t), level(randomness(t), True)))
    return out


#: Separators and cases of joined words; the fourth to sixth only by rule.
JOINTS = (("-", str.lower), ("_", str.lower), ("", str.lower), ("", str.capitalize), ("", str.upper), ("/", str.lower))


def join_words(words: list[str], number: int, length: int, style: int) -> str:
    """A token such as people write: words and a number, joined in one of the ways of JOINTS."""
    joint, change = JOINTS[style]
    return joint.join([change(words[0]), str(number % 2100), *map(change, words[1:])])[:length]


def decoys(text: str) -> list[tuple[int, int]]:
    """(class, level) of one decoy a range of lengths, from words at a place of the text that its hash names; none where the
    words there, to the end and once more from the start, are too few."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    lengths = [lo + (seed >> 3 * i) % 12 for i, lo in enumerate((20, *LENGTH_CLASSES))]
    words: list[str] = []
    size = 0
    for lo, hi in ((seed % len(text), len(text)), (0, seed % len(text))) if text else ():
        for m in _WORD.finditer(text, lo, hi):
            words.append(m[0])
            size += len(m[0])
            if size >= lengths[-1]:
                break
        if size >= lengths[-1]:
            break
    tokens = [join_words(words, seed >> 7, n, (seed >> 2 * i) % 4) for i, n in enumerate(lengths)] if words else []
    return [(token_class(t), level(randomness(t), False)) for t, n in zip(tokens, lengths) if len(t) == n]


def rule_decoys() -> list[tuple[int, int]]:
    """RULE_DECOYS of each kind and range of lengths: words of syllables in every joint, and hexadecimal counters, times and
    repeated groups."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(("", "n", "r", "s"))
    out = []
    for lo in (20, *LENGTH_CLASSES):
        for k in range(RULE_DECOYS):
            n = lo + k % 12
            made = [join_words([word() for _ in range(n)], rng.randint(0, 9999), n, style) for style in range(len(JOINTS))]
            group = f"{rng.getrandbits(32):08x}"
            made.append((f"{rng.randint(1, 10**6):0{n}x}", (group * n)[:n], f"{rng.randint(2000, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}{rng.randint(0, 10**6):0{n - 8}x}")[k % 3])
            out += [(token_class(t), level(randomness(t), False)) for t in made]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    token_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token_class", pa.int32()), ("level", pa.int32())]))
    decoy_kind = pa.list_(pa.struct([("token_class", pa.int32()), ("level", pa.int32())]))
    for batch in batches:
        base, tokens, false, digests = [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            tokens.append([{"start": s, "end": e, "token_class": c, "level": v} for s, e, c, v in candidates(text or "")])
            false.append([{"token_class": c, "level": v} for c, v in decoys(text or "")])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, base_kind), pa.array(tokens, token_kind), pa.array(false, decoy_kind), pa.array(digests)], ["doc_id", "base", "tokens", "decoys", "base_sha256"])


def reported_levels(tokens: DataFrame, false: DataFrame, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg by class: the largest level that is reported. tokens and false: token_class, level."""
    tally = lambda df, own: df.groupBy("token_class", "level").agg(F.count("*").alias("n")).withColumn("own", F.lit(own))
    tallied = tally(tokens, True).union(tally(false, False))  # bounded: classes times levels
    by_class = W.partitionBy("token_class")
    so_far = by_class.orderBy("level").rangeBetween(W.unboundedPreceding, 0)
    many = lambda own, w: F.coalesce(F.sum(F.when(F.col("own") == own, F.col("n"))).over(w), F.lit(0))
    ranked = tallied.select("token_class", "level", "own", many(True, so_far).alias("rank"), many(True, by_class).alias("total"), many(False, so_far).alias("false_rank"), many(False, by_class).alias("false_total"))
    kept = ranked.where(F.col("own") & ((F.col("false_rank") + 1) / (F.col("false_total") + 1) <= rate * F.col("rank") / F.col("total")))
    return {r.token_class: r.level for r in kept.groupBy("token_class").agg(F.max("level").alias("level")).collect()}


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans names all spans, kind:start:end in code points by start and kind; those of kind random come from the battery.
    Null counts as empty; repeated rows and rows of a null doc_id are scanned one by one and count in the corpus
    statistics as often as they occur; other columns are ignored. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, base array<struct<start:long,kind:int,end:long>>, tokens array<struct<start:long,end:long,token_class:int,level:int>>, decoys array<struct<token_class:int,level:int>>, base_sha256 string"
    found = stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, schema))
    each = lambda c: found.select(F.explode(c).alias("t")).select("t.token_class", "t.level")
    ruled = docs.sparkSession.createDataFrame(rule_decoys(), "token_class int, level int")
    most = reported_levels(each("tokens"), each("decoys").union(ruled), rate)
    levels = F.array(*[F.lit(most.get(c, -1)) for c in range(CLASSES)])
    random = F.transform(F.filter("tokens", lambda t: t.level <= F.element_at(levels, t.token_class + 1)), lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind"), t.end.alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform(F.array_sort(F.concat("base", "random")), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.withColumn("random", random).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
        F.array_join(told, ",").alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
