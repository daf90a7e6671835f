"""Events pushed from outside, paired first in first out with demand (A5, A6, B5), and messages that cross partitions' backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scan import locate
from sluice.functions.sequence import positions, prefix_sum, prefix_sums
from sluice.operators.dispatch import small


def pair(pushes: DataFrame, asks: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """pushes with asked_at, the ask that each is given to (null: none yet), and given_at, when it is handed out: as soon as both are there.

    asks: keys, seq and n.  The i-th push of a key goes to the ask whose demand spans i.  Cumulated demand is a range for each ask, so
    pairs are found in blocks of numbers; no key is in one task.
    """
    numbered = positions(pushes, *keys, seq=seq, out="__i")
    ranges = prefix_sum(asks.where("n > 0").select(*keys, seq, "n"), F.col("n"), *keys, seq=seq, out="__low")
    ranges = ranges.select(*keys, F.col(seq).alias("asked_at"), "__low", (F.col("__low") + F.col("n")).alias("__high"))
    found = locate(numbered, "__i", ranges, "__low", "__high", *keys)
    at = F.when(F.col("asked_at").isNotNull(), F.greatest(seq, "asked_at"))
    return found.select(*pushes.columns, "asked_at", at.alias("given_at"))


def common_demand(asks: DataFrame, consumers: list[str], *keys: str, consumer: str = "consumer", seq: str = "seq") -> DataFrame:
    """keys, seq and n: what asks of several consumers come to where each event goes to all of them.  That is the least of their sums,
    so an ask counts as far as it raises the least.  consumers: their names; a row's others ask for nothing."""
    own = {f"__c{i}": F.when(F.col(consumer) == name, F.col("n")).otherwise(0) for i, name in enumerate(consumers)}
    rows = prefix_sums(asks, own, *keys, seq=seq)
    least, grown = [F.col(c) for c in own], [F.col(c) + v for c, v in own.items()]
    before, after = (c[0] if len(c) == 1 else F.least(*c) for c in (least, grown))
    return rows.select(*keys, seq, (after - before).alias("n")).where("n > 0")


def counts_before(rows: DataFrame, points: DataFrame, key: str, seq: str = "seq", width: int = 1 << 12) -> DataFrame:
    """points (name, seq) for each key that has rows before it, with n: how many.

    Rows are counted by blocks on the map side.  Only inside the blocks of points rows are compared with points one by one, and
    summed at once; the points are sent to the rows where they are few, so rows are never dealt out.
    """
    block = F.expr(f"`{seq}` div {width}L")
    sums = rows.groupBy(key, block.alias("block")).agg(F.count("*").alias("__one"))
    marks = points.select("name", F.col(seq).alias("__t"), block.alias("__b"))
    keyed = rows.select(key).distinct().crossJoin(small(marks))  # a row for each point and key: the size of the result
    both = sums.select(key, F.col("block").alias("at"), "__one").unionByName(keyed.select(key, F.col("__b").alias("at"), "name", "__t"), allowMissingColumns=True)
    both = both.withColumn("__later", F.col("name").isNull())  # a point counts the blocks before its own
    whole = prefix_sum(both, F.col("__one"), key, seq="at", out="__base", width=1 << 20, ties=("__later",)).where("name is not null")
    some = rows.select(key, F.col(seq).alias("__s"), block.alias("__b")).join(small(marks), "__b").where("__s < __t")
    some = some.groupBy("name", key).agg(F.count("*").alias("__in"))
    n = F.col("__base") + F.coalesce("__in", F.lit(0))
    return whole.join(some, ["name", key], "left").select("name", F.col("__t").alias(seq), key, n.alias("n")).where("n > 0")


def info_partitions(events: DataFrame, asks: DataFrame, infos: DataFrame, p: str = "p", seq: str = "seq") -> DataFrame:
    """infos with given_at, when each is delivered (null: not yet).

    events: p, seq of what was given to partitions.  asks: p, seq, n.  infos: name, seq.  A message waits in each partition that has had
    events and has no demand left over then, until demand goes beyond the events before it: demand that ends with them leaves it
    waiting.  It is delivered when the last partition lets it through, or at once if none holds it.
    """
    backlog = counts_before(events, infos, p, seq)
    ranges = prefix_sum(asks.where("n > 0").select(p, seq, "n"), F.col("n"), p, seq=seq, out="__low")
    ranges = ranges.select(p, F.col(seq).alias("crossed"), "__low", (F.col("__low") + F.col("n")).alias("__high"))
    through = locate(backlog, "n", ranges, "__low", "__high", p)
    last = through.groupBy("name").agg(F.max("crossed").alias("__last"), F.bool_or(F.col("crossed").isNull()).alias("__held"))
    at: Column = F.when(F.coalesce("__held", F.lit(False)), F.lit(None)).otherwise(F.greatest(seq, F.coalesce("__last", seq)))
    return infos.join(last, "name", "left").select(*infos.columns, at.cast("bigint").alias("given_at"))
