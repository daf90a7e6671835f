"""Assignment of events to consumers, in closed form: by demand, by broadcast and by partition.

Consumer tables have one row for each subscription; they are broadcast only under a checked size (BROADCAST_ROWS), above
which the same joins run without the hint.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.sequence import portable_hash, positions
from sluice.options import OptionError, PartitionOptions, SubscriptionOptions

BROADCAST_ROWS = 100_000


class Dispatcher(Protocol):
    """What a custom dispatcher has to offer (E22): events with `consumer`, the name of the one that gets it, repeated for several."""

    def assign(self, events: DataFrame, subscriptions: dict[str, SubscriptionOptions]) -> DataFrame: ...


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint, if its size allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def demand_dispatch(events: DataFrame, consumers: DataFrame, seed: int | None = None, seq: str = "seq") -> DataFrame:
    """One dispatch, greedy to the largest demand: events with consumer (null: left over).

    consumers: consumer, pos (subscription order), demand.  Ties keep their order; with a seed it is drawn instead.
    """
    # drawn by a hash, so that the order does not depend on where a consumer's row lies
    pos = F.xxhash64(F.lit(seed).cast("bigint"), F.col("consumer"), F.col("pos")) if seed is not None else F.col("pos")
    order = Window.orderBy(F.desc("demand"), pos)  # consumers only
    ranges = consumers.where("demand > 0").select("consumer", "demand", F.sum("demand").over(order).alias("high"))
    ranges = ranges.select("consumer", (F.col("high") - F.col("demand")).alias("low"), "high")
    here = (F.col(seq) >= F.col("low")) & (F.col(seq) < F.col("high"))
    return events.join(small(ranges), here, "left").drop("low", "high")


def round_robin(events: DataFrame, consumers: int, demand: int, seq: str = "seq") -> DataFrame:
    """Equal consumers that are refilled when a round is drained: blocks of `demand` events in turn."""
    return events.withColumn("consumer", (F.floor(F.col(seq) / demand) % consumers).cast("bigint"))


def broadcast_dispatch(events: DataFrame, consumers: DataFrame, seq: str = "seq") -> DataFrame:
    """Every event to every consumer, as far as the least demand goes.

    consumers: consumer, demand, and joined (least seq it sees) where there is such a column.
    """
    least = consumers.agg(F.min("demand").alias("waiting"))
    sees = F.col(seq) >= F.col("joined") if "joined" in consumers.columns else F.lit(True)
    sent = events.join(F.broadcast(least), F.col(seq) < F.col("waiting")).drop("waiting")
    return sent.join(small(consumers.drop("demand")), sees).drop("joined")


def select_dispatch(events: DataFrame, selectors: dict[str, Column | str]) -> DataFrame:
    """Every event to each consumer whose predicate it meets.  Predicates are columns, so that what none of them takes is
    filtered at the scan."""
    tests = {k: F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(False)) for k, v in selectors.items()}
    some = F.lit(False)
    for t in tests.values():
        some = some | t
    named = F.array(*(F.when(t, F.lit(k)) for k, t in tests.items()))
    return events.where(some).withColumn("consumer", F.explode(F.filter(named, lambda x: x.isNotNull())))


def reasked(events: DataFrame, selectors: dict[str, Column | str]) -> DataFrame:
    """consumer and n: events that a selector discarded, which are asked again for that consumer; one pass."""
    tests = {k: F.expr(v) if isinstance(v, str) else v for k, v in selectors.items()}
    counts = events.agg(*(F.count_if(~F.coalesce(t, F.lit(False))).alias(f"c{i}") for i, t in enumerate(tests.values())))
    rows = F.array(*(F.struct(F.lit(k).alias("consumer"), F.col(f"c{i}").alias("n")) for i, k in enumerate(tests)))
    return counts.select(F.inline(rows))


def partition_by(events: DataFrame, options: PartitionOptions, key: Column | None = None) -> DataFrame:
    """events with p, their partition; without those whose hash is null.  An unknown partition stops the query."""
    if options.hash is not None:
        p = F.expr(options.hash).cast("string")
    else:
        if key is None:
            raise OptionError("a key or a hash is required")
        p = portable_hash(key, options.partitions).cast("string")
    out = events.withColumn("p", p).where(F.col("p").isNotNull())
    unknown = F.raise_error(F.concat(F.lit("unknown partition "), F.col("p")))
    return out.withColumn("p", F.when(F.col("p").isin(options.names), F.col("p")).otherwise(unknown))


def partition_gate(events: DataFrame, demands: DataFrame, p: str = "p", seq: str = "seq", rank: str | None = None) -> DataFrame:
    """events with status: accepted, queued, discarded (no partition) or leftover.

    In order, events are taken until as many with a partition as all demands together were; the rest is left over.  In each
    partition, so many as its own demand are accepted and the others queued.  demands: p, demand (bounded by partitions).
    rank: a column with the number of partitioned events before each, where the caller has it; else it is counted in two
    passes over ranges of seq.  The place in a partition comes from two passes too, so a partition may hold all events.
    """
    total = demands.agg(F.coalesce(F.sum("demand"), F.lit(0)).alias("waiting"))
    rows = events if rank else prior_count(events, F.col(p).isNotNull(), seq).withColumnRenamed("prior", "__prior")
    prior = F.col(rank or "__prior")
    rows = rows.join(F.broadcast(total)).withColumn("__in", prior < F.col("waiting"))
    taken = positions(rows.where(F.col("__in") & F.col(p).isNotNull()), p, seq=seq, out="__at")
    taken = taken.join(small(demands.select(F.col(p), "demand")), p, "left")
    status = F.when(F.col("__at") < F.coalesce("demand", F.lit(0)), "accepted").otherwise("queued")
    taken = taken.withColumn("status", status).select(*events.columns, "status")
    rest = rows.where(~F.col("__in") | F.col(p).isNull()).withColumn("status", F.when(F.col("__in"), "discarded").otherwise("leftover"))
    return taken.unionByName(rest.select(*events.columns, "status"))


def prior_count(events: DataFrame, test: Column, seq: str = "seq", width: int = 1 << 16) -> DataFrame:
    """events with prior: how many before each meet the test.  Counts of blocks of seq, then windows inside each block."""
    rows = events.withColumn("__block", F.floor(F.col(seq) / width)).withColumn("__one", test.cast("bigint"))
    blocks = rows.groupBy("__block").agg(F.sum("__one").alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    blocks = blocks.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(small(blocks), "__block").withColumn("prior", F.col("__base") + F.coalesce(F.sum("__one").over(inside), F.lit(0)))
    return rows.drop("__block", "__one", "__base")


def backlog(statuses: DataFrame, p: str = "p") -> DataFrame:
    """Queued events of each partition."""
    return statuses.groupBy(p).agg(F.count_if(F.col("status") == "queued").alias("queued"))
