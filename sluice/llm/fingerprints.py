"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is the weighted set of its words (maximal runs without white space), a word's weight being its number
of occurrences.  For each of `samples` independent draws, the term whose

    a = c exp(-r (t - beta) - r),   t = floor(ln(weight) / r + beta)

is least is taken, where r and c are Gamma(2, 1) and beta is uniform, all three fixed by the term and the draw.  Two
documents take the same (term, t) in a draw with a probability that equals their generalised Jaccard similarity,
sum of minima over sum of maxima.  A fingerprint is the list of the draws' 32-bit hashes of (term, t).

Defined cases: a null, empty or blank text has one pseudo-term, so all such texts share a fingerprint that is
unlike any other; very long texts are sampled whole; repeated rows are kept as rows; rows with equal ids follow each other by
a hash of their texts, and all of them are in one bucket; rows without an id come last in the order of neighbours; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, SPACES

SAMPLES = 32
#: Rows a bucket of neighbours should have, and the most buckets (a list of so many ids goes to the driver).
BUCKET_ROWS, MOST_BUCKETS = 256, 65536
_LOW32 = 0xFFFFFFFF


def terms(text: Column) -> Column:
    """The words of a text, with repetitions; one empty word for a text without words."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), SPACES)


#: Coefficients of -ln(1 - v / 2) for v in [0, 1), from the constant term on; off by 1.4e-4 at most.
_TAIL = [0.0001029035611695428, 0.4970652322892366, 0.14401403110556357, -0.0030440762776153193, 0.05486825642469363]


def _exponential(z: Column, shift: int, bits: int) -> Column:
    """An Exp(1) variate from a field of random bits: ln 2 times a geometric count plus the remainder's polynomial.

    The engine's own logarithm takes most of the time of a draw; this takes a few arithmetic operations.
    """
    field = F.shiftrightunsigned(z, shift) if shift else z
    low = field.bitwiseOR(F.lit(1 << 10)).bitwiseAND(F.lit(2047))
    count = F.bit_count((low - 1).bitwiseAND(F.bitwise_not(low)))
    v = F.shiftrightunsigned(field, 11).bitwiseAND(F.lit((1 << (bits - 11)) - 1)) * 2.0 ** -(bits - 11)
    rest = F.lit(_TAIL[-1])
    for c in _TAIL[-2::-1]:
        rest = rest * v + c
    return count * math.log(2) + rest


def _sample(h: Column, log_weight: Column, draw: Column) -> Column:
    """One draw of a term as one long: a as a fixed-point number in the upper half, the hash of (term, t) in the lower.

    a follows Exp(weight), so 27 bits after the point keep the least of millions apart; ties go to the lower half.
    """
    x, y = F.xxhash64(h, draw), F.xxhash64(draw, h)
    r = _exponential(x, 0, 32) + _exponential(x, 32, 32)
    c = _exponential(y, 0, 26) + _exponential(y, 26, 26)
    beta = F.shiftrightunsigned(y, 52) * 2.0**-12
    t = F.floor(log_weight / r + beta)
    a = c * F.exp(r * (beta - t - 1))
    place = h.bitwiseXOR(F.shiftleft(t, 17)).bitwiseAND(F.lit(_LOW32))
    return F.shiftleft((F.least(a, F.lit(15.9)) * 2.0**27).cast("long"), 32).bitwiseOR(place)


#: Draws made side by side for a term.  Few keep the compiled method small enough for the JVM's compiler.
_ABREAST = 8


def signatures(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys, part and draws: the samples of each combination of keys, in samples / _ABREAST rows of _ABREAST longs.

    Words leave the rows as 64-bit hashes; the two aggregations need no exchange of their own where the rows are
    already dealt out by some of the keys.
    """
    words = rows.select(*keys, F.explode(terms(F.col(text))).alias("word")).select(*keys, F.xxhash64("word").alias("h"))
    weighted = words.groupBy(*keys, "h").agg(F.count("*").alias("n"))
    parts = F.array(*map(F.lit, range(0, samples, _ABREAST)))
    drawn = weighted.select(*keys, "h", F.log(F.col("n").cast("double")).alias("w"), F.explode(parts).alias("part"))
    least = drawn.groupBy(*keys, "part").agg(
        *(F.min(_sample(F.col("h"), F.col("w"), F.col("part") + k)).alias(f"s{k}") for k in range(_ABREAST))
    )
    return least.select(*keys, "part", F.array(*(f"s{k}" for k in range(_ABREAST))).alias("draws"))


def gathered(which: int) -> Column:
    """The signature of one of the texts of a row, from its parts."""
    mine = F.when(F.col("which") == which, F.struct("part", "draws"))
    return F.flatten(F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["draws"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of draws in which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def hexed(signature: Column) -> Column:
    return F.array_join(
        F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(_LOW32))), 8, "0"))), ""
    )


def boundaries(rows: DataFrame, key: str) -> list[int]:
    """Ids that cut the table into buckets of about BUCKET_ROWS rows; each is the largest id of its bucket."""
    count = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n")).first()["n"]
    buckets = max(1, min(MOST_BUCKETS, round(count / BUCKET_ROWS)))
    shares = _constant([(i + 1) / buckets for i in range(buckets)], "double")
    found = rows.agg(F.percentile_approx(key, shares, 20 * buckets + 1000).alias("p")).first()["p"]
    top = rows.agg(F.max(key).alias("m")).first()["m"]
    return sorted({*(found or []), *([top] if top is not None else [])})


def _constant(values: list, kind: str) -> Column:
    """A foldable array of any length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of cuts below a key, by two looks into short lists; 0 for null."""
    if len(cuts) < 2:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda c: c < key))
    coarse, fine = _constant(cuts[step - 1 :: step], "bigint"), _constant(cuts, "bigint")
    first = below(coarse) * step
    return F.when(key.isNull(), 0).otherwise(first + below(F.slice(fine, first + 1, F.lit(step))))


def neighbours(rows: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, rank, doc_id, own, text and next_text: each row with the text of the row that comes next by descending key.

    The row after the last is the first.  One shuffle: rows are dealt out by ranges of the key, and the top rows of
    each range also go, as guests, to the range above it.  Guests stay in the result (own is false).
    """
    cuts = boundaries(rows, key)
    last = max(0, len(cuts) - 1)
    rows = rows.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket = _bucket(F.col("doc_id"), cuts)
    place = lambda at, own: F.struct(at.cast("int").alias("bucket"), F.lit(own).alias("own"))
    home, guest = place(F.col("b"), True), place(F.when(F.col("b") == last, F.lit(0)).otherwise(F.col("b") + 1), False)
    if cuts:
        is_top = F.coalesce(F.element_at(_constant(cuts, "bigint"), F.col("b") + 1) == F.col("doc_id"), F.lit(False))
    else:  # no row has an id
        is_top = F.lit(True)
    places = F.when(is_top, F.array(home, guest)).otherwise(F.array(home))
    dealt = rows.withColumn("b", bucket).select("doc_id", "text", F.explode(places).alias("at"))
    dealt = dealt.select(
        "at.bucket", "at.own", "doc_id", "text", F.xxhash64("text").alias("h")
    ).repartition(max(16, min(len(cuts) // 4, 4096)), "bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc("own"), F.desc_nulls_last("doc_id"), "h", "text")
    return dealt.select(
        "bucket",
        F.row_number().over(order).alias("rank"),
        "own",
        "doc_id",
        "text",
        F.lead("text").over(order).alias("next_text"),
    )


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many from the start of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprint_query(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    near = neighbours(docs, "doc_id", "text")
    both = near.select(
        "bucket",
        "rank",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                F.struct(F.lit(1).alias("which"), edited(F.col("text"), F.col("next_text")).alias("t")),
            )
        ).alias("x"),
    ).select("bucket", "rank", F.col("x.which").alias("which"), F.col("x.t").alias("t"))
    found = signatures(both, ["bucket", "rank", "which"], "t", samples)
    pair = found.groupBy("bucket", "rank").agg(gathered(0).alias("mine"), gathered(1).alias("theirs"))
    order = Window.partitionBy("bucket").orderBy("rank")
    pair = pair.withColumn("after", F.lead("mine").over(order))
    pair = pair.select(
        "bucket",
        "rank",
        hexed(F.col("mine")).alias("fingerprint"),
        hexed(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("theirs")).alias("near_edited"),
        likeness(F.col("mine"), F.col("after")).alias("near_next"),
    )
    facts = near.where("own").select(
        "bucket",
        "rank",
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(edited(F.col("text"), F.col("next_text")), 256).alias("edited_sha256"),
    )
    return facts.join(pair, ["bucket", "rank"]).drop("bucket", "rank")
