"""What five document filters do to each other, in every order they can be applied in.

Filters fail a document if: A it has under 100 words; B under 80 of 100 words are distinct; C over 10 of 100 code points are
capitals A-Z; D it holds one of #$%&*|; E a row with a smaller doc_id has the same text.

One pass counts, for each of the 32 sets of filters, the rows that fail all of the set: products of flags, summed.  All else follows
from these numbers, without the rows: by Moebius inversion, survivors of a set S are the sum over T in S of (-1)^|T| N(T), and
rows that fail f alone those of the sets around {f} with alternating signs.  What f takes away over all 120 orders is 120 times its
Shapley value in the game "rows removed by a set", whose Harsanyi dividends are (-1)^(|T|+1) N(T), each shared alike by its members.

E needs no join of texts.  A to D depend on the text alone, so rows are grouped by the text's digest and part; of a group, only the
rows with the least doc_id of that digest pass E.  A text that a third of all rows have is a few rows after partial aggregation.

Defined cases: a null text is empty and a null part is the empty string; an empty text fails A only (and E, if not the first);
rows without a doc_id never fail E and make no other row fail it; rows with one doc_id and text are first together; a doc_id with
several labels has the largest of each, one without labels none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import SPACES

FILTERS = "ABCDE"
#: What is counted: all rows, and those of good quality and with toxic text.
MEASURES = ("n", "good", "toxic")
_E = 1 << FILTERS.index("E")


def flags(text: Column) -> dict[str, Column]:
    """The filters that look at the text alone, as conditions under which a text fails.

    Words are counted in one array of the text; separators at its ends give an empty string there, which is no word."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return {"words": F.size(words), "distinct": F.size(F.array_distinct(words)), "capitals": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")), "chars": F.char_length(text), "marked": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each text and part: part, mask (failed filters A to D as bits), and of each measure all rows and those that fail E."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *(c.alias(k) for k, c in flags(text).items()))
    tests = (F.col("words") < 100, 100 * F.col("distinct") < 80 * F.col("words"), 100 * F.col("capitals").cast("long") > 10 * F.col("chars").cast("long"), F.col("marked"))
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    rows = rows.select("__id", "part", "digest", mask.alias("mask"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    # rows without an id find no label; a key of their own deals them out
    rows = rows.withColumn("__key", F.coalesce(F.col("__id").cast("long"), F.xxhash64("digest", "part")))
    known = known.select(F.col("__id").cast("long").alias("__key"), F.lit(True).alias("__known"), "good", "toxic")
    mine = F.col("__known") & F.col("__id").isNotNull()
    rows = rows.join(known, "__key", "left").withColumns({m: F.when(mine, F.col(m)).otherwise(0) for m in ("good", "toxic")})
    same = rows.groupBy("__key", "__id", "digest", "part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    named = F.when(F.col("__id").isNotNull(), F.struct("__id", *MEASURES))
    unnamed = [F.sum(F.when(F.col("__id").isNull(), F.col(m)).otherwise(0)).alias(f"free_{m}") for m in MEASURES]
    texts = same.groupBy("digest", "part", "mask").agg(F.min(named).alias("first"), *(F.sum(m).alias(m) for m in MEASURES), *unnamed)
    least = F.min("first.__id").over(Window.partitionBy("digest"))  # as many rows as the text has parts
    texts = texts.withColumn("leads", F.coalesce(F.col("first.__id") == least, F.lit(False)))
    kept = {m: F.col(f"free_{m}") + F.when(F.col("leads"), F.col(f"first.{m}")).otherwise(0) for m in MEASURES}
    return texts.select("part", "mask", *MEASURES, *((F.col(m) - c).alias(f"{m}_again") for m, c in kept.items()))


def joint_counts(failed: DataFrame) -> DataFrame:
    """One row for each part: of each measure an array of 32 counts, of the rows that fail all filters of each set."""
    out = []
    for m in MEASURES:
        for s in range(1 << len(FILTERS)):
            of_text = s & ~_E
            here = (F.col("mask").bitwiseAND(F.lit(of_text)) == of_text).cast("long")  # the product of the text's flags
            out.append(F.sum(here * F.col(f"{m}_again" if s & _E else m)).alias(f"{m}_{s}"))
    sums = failed.groupBy("part").agg(*out)
    return sums.select("part", *(F.array(*(F.col(f"{m}_{s}") for s in range(1 << len(FILTERS)))).alias(m) for m in MEASURES))


def _survivors(counts: str, among: Column) -> Column:
    """Rows that pass all filters of a set, from the counts of its subsets."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    signed = lambda s: F.when(F.bit_count(s) % 2 == 0, F.element_at(counts, s + 1)).otherwise(-F.element_at(counts, s + 1))
    return F.aggregate(sets, F.lit(0).cast("long"), lambda sum_, s: sum_ + F.when(s.bitwiseAND(among) == s, signed(s)).otherwise(0))


def _over_supersets(counts: str, own: Column, weight: dict[int, int]) -> Column:
    """The sum over all sets around a filter of the set's count times a weight by the set's size."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    by_size = F.create_map(*(F.lit(x) for k, w in weight.items() for x in (k, w)))
    return F.aggregate(sets, F.lit(0).cast("long"), lambda sum_, s: sum_ + F.when(s.bitwiseAND(own) == own, F.element_at(counts, s + 1) * by_size[F.bit_count(s)]).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step in it; see the module."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(f) for f in o[:k])) for o in orders for k in range(len(FILTERS))]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")  # 600 rows
    counts = joint_counts(failures(docs, labels, part))
    rows = counts.join(F.broadcast(table))
    after = F.col("own").bitwiseOR(F.col("before"))
    fewer = lambda m: _survivors(m, F.col("before")) - _survivors(m, after)
    fails = F.element_at("n", F.col("own") + 1)
    share = {k: (120 // k) * (-1) ** (k + 1) for k in range(1, 6)}
    alone = {k: (-1) ** (k + 1) for k in range(1, 6)}
    return rows.select("part", "filter_order", "step", _survivors("n", after).alias("kept"), fewer("n").alias("removed"), (fails - fewer("n")).alias("redundant"), _over_supersets("n", F.col("own"), alone).alias("unique_fails"), fewer("good").alias("good_lost"), fewer("toxic").alias("toxic_lost"), _over_supersets("n", F.col("own"), share).alias("shapley"))
