"""Scans over ordered logs in two or more levels: clamped running totals, and pairing points with the intervals they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No bound: far beyond any sum of a log, and far enough from the largest number for sums with it.
FREE = 1 << 61
MAP = ("__add", "__low", "__high")


def _clamp(x: Column, add: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x + add, low), high)


def _prefixes(rows: DataFrame, keys: list[str], seq: str, reach: int) -> DataFrame:
    """Each row's map replaced by that of all rows of its key up to it, `reach` of them at most.  In each step a row takes in what the
    rows 1, 2 and 3 spans before it have, and a span is four times as long as in the last; all steps have one sort order, so rows are
    shuffled once."""
    w = Window.partitionBy(*keys).orderBy(seq)
    others, nothing = [c for c in rows.columns if c not in MAP], (0, -FREE, FREE)
    span = 1
    while span < reach:
        lags = [F.lag(c, i * span, none).over(w).alias(f"{c}{i}") for i in (1, 2, 3) for c, none in zip(MAP, nothing)]
        rows = rows.select(*others, *MAP, *lags)
        add, low, high = (F.col(f"{c}3") for c in MAP)
        for i in (2, 1, ""):  # first what came before
            own = [F.col(f"{c}{i}") for c in MAP]
            add, low, high = add + own[0], _clamp(low, *own), _clamp(high, *own)
        rows = rows.select(*others, add.alias(MAP[0]), low.alias(MAP[1]), high.alias(MAP[2]))
        span *= 4
    return rows


def _block(at: str, width: int) -> Column:
    """The block of a number; no block has more than `width` numbers, also below 0."""
    return F.expr(f"(`{at}` - pmod(`{at}`, {width}L)) div {width}L")


def clamp_scan(log: DataFrame, add: Column, *keys: str, low: Column | int = -FREE, high: Column | int = FREE, seq: str = "seq", start: int = 0, out: str = "fill", width: int = 1 << 10) -> DataFrame:
    """log with out, a total after each row, and out_before: each row in order makes x to min(max(x + add, low), high).

    Such maps compose to one of the same kind, so they are folded in blocks of `width` numbers of seq (unique inside a key),
    the block table is scanned in the same way, and each block starts from what the blocks before it made.  A key is
    spread over as many tasks as it has blocks.  A null add is 0.
    """
    bound = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    rows = log.withColumns({"__block": _block(seq, width), "__add": F.coalesce(add.cast("bigint"), F.lit(0).cast("bigint")), "__low": bound(low), "__high": bound(high)})
    own = [*keys, "__block"]
    inside = _prefixes(rows, own, seq, width)
    blocks = inside.groupBy(*own).agg(F.max_by(F.struct(*MAP), seq).alias("__m")).select(*own, *(F.col(f"__m.{c}").alias(c) for c in MAP))
    ends = log.agg(F.min(seq).alias("a"), F.max(seq).alias("b")).first()
    count = 0 if ends["a"] is None else ends["b"] // width - ends["a"] // width + 2
    if count <= width:
        done = _prefixes(blocks, list(keys), "__block", count).withColumn("__end", _clamp(F.lit(start).cast("bigint"), *(F.col(c) for c in MAP)))
    else:
        table = blocks.select(*keys, F.col("__block").alias("__at"), *(F.col(c).alias(f"{c}_") for c in MAP))
        done = clamp_scan(table, F.col("__add_"), *keys, low=F.col("__low_"), high=F.col("__high_"), seq="__at", start=start, out="__end", width=width).withColumnRenamed("__at", "__block")
    before = F.lag("__end", 1, start).over(Window.partitionBy(*keys).orderBy("__block"))  # one row for each block
    starts = done.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(own)), before.cast("bigint").alias("__start"))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(own)]
    after = _clamp(F.col("__start"), *(F.col(c) for c in MAP))
    rows = inside.join(starts, same).withColumn("__after", after)
    previous = F.coalesce(F.lag("__after").over(Window.partitionBy(*own).orderBy(seq)), F.col("__start"))
    return rows.select(*log.columns, F.col("__after").alias(out), previous.alias(f"{out}_before"))


def locate(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, *keys: str, width: int = 1 << 12) -> DataFrame:
    """points, each with the columns of the range (low <= at < high) of its key that it lies in; null where there is none.

    Ranges of a key do not overlap.  Points and ranges meet in blocks of `width` numbers, a range in each block that it
    reaches into; inside a block both are put in order and a point takes the last range that began.  That is linear, and a key is spread
    over its blocks, however many ranges or points it has.  Empty ranges hold nothing.
    """
    new = [c for c in ranges.columns if c not in keys]
    own = F.struct(*(F.col(c) for c in new))
    wide = ranges.where(F.col(high) > F.col(low)).select(*keys, own.alias("__range"), F.explode(F.sequence(_block(low, width), F.expr(f"(`{high}` - 1 - pmod(`{high}` - 1, {width}L)) div {width}L"))).alias("__block"))
    wide = wide.withColumn("__at", F.greatest(F.col(f"__range.{low}"), F.col("__block") * width))
    left = points.select(*keys, F.struct(*points.columns).alias("__point"), _block(at, width).alias("__block"), F.col(at).cast("bigint").alias("__at"))
    both = left.unionByName(wide.select(*keys, "__range", "__block", F.col("__at").cast("bigint").alias("__at")), allowMissingColumns=True)
    # at one number, the range comes first
    w = Window.partitionBy(*keys, "__block").orderBy("__at", F.col("__point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__range", ignorenulls=True).over(w)).where("__point is not null")
    holds = F.col(f"__last.{high}") > F.col("__at")
    return found.select(*(F.col(f"__point.{c}").alias(c) for c in points.columns), *(F.when(holds, F.col(f"__last.{c}")).alias(c) for c in new))
