"""Cutting events into batches from minimum and maximum demand (D2 to D5, D9), and rate limiting."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.sequence import positions
from sluice.options import SubscriptionOptions


def split_message(size: int, asked: int, outstanding: int, opts: SubscriptionOptions) -> tuple[list[tuple[int, int, int]], int, int]:
    """One message of `size` events: ((batch size, ask after it, excess in it) ...), new asked, new outstanding.

    asked: events asked for and not yet received; outstanding: demand not yet processed.
    """
    out = []
    while size > 0:
        take = min(size, opts.chunk)
        size -= take
        counted = min(take, asked)
        excess, asked = take - counted, asked - counted
        left, ask = outstanding - counted, 0
        if left <= opts.min_demand:
            ask, left = opts.max_demand - left, opts.max_demand
        outstanding = left
        asked += ask
        out.append((take, ask, excess))
    return out, asked, outstanding


def cycle(opts: SubscriptionOptions) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(size, ask) of the batches of one consumer at a producer that answers each ask with one message at once.

    The first list leads in, the second repeats for ever; it ends when (demand, messages under way) is met again.
    """
    waiting, demand, seen, out = deque([opts.max_demand]), opts.max_demand, {}, []
    while (state := (demand, tuple(waiting))) not in seen:
        seen[state] = len(out)
        size = waiting.popleft()
        while size > 0:
            take = min(size, opts.chunk)
            size -= take
            demand -= take
            ask = 0
            if demand <= opts.min_demand:
                ask, demand = opts.max_demand - demand, opts.max_demand
                waiting.append(ask)
            out.append((take, ask))
    lead, rest = out[: seen[state]], out[seen[state] :]
    while lead and lead[-1] == rest[-1]:
        lead, rest = lead[:-1], rest[-1:] + rest[:-1]
    return lead, rest


_BLOCK = 1 << 16


def _place(pos: Column, opts: SubscriptionOptions) -> tuple[Column, Column, Column]:
    """(batch_no, ask after the batch, is the batch's last event) of a position."""
    lead, rest = cycle(opts)
    if lead:  # unroll: the lead-in is as a cycle of its own before the others
        raise ValueError("the first batches differ from the later ones; use split_message over the messages")
    period = sum(s for s, _ in rest)
    inside, number, ask, last, end = pos % period, F.lit(0), F.lit(0), F.lit(False), 0
    for i, (size, a) in enumerate(rest):
        here = inside >= end
        number, ask = F.when(here, F.lit(i)).otherwise(number), F.when(here, F.lit(a)).otherwise(ask)
        end += size
        last = last | (inside == end - 1)
    return (F.floor(pos / period) * len(rest) + number).cast("bigint"), ask.cast("bigint"), last


def assign_batches(events: DataFrame, opts: SubscriptionOptions, seq: str = "seq", producer: str | None = None, message: str | None = None) -> DataFrame:
    """events with batch_no and ask, the demand asked after that batch.

    seq: dense from 0 for one prompt producer.  producer: each has its own demand and order.  message: message borders
    are data; each message is cut on its own, in chunks of max - min (ask is null: it depends on earlier messages).
    """
    if message:
        keys = [*([producer] if producer else []), message]
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(seq)) - 1
        return events.withColumn("batch_no", F.floor(number / opts.chunk).cast("bigint")).withColumn("ask", F.lit(None).cast("bigint"))
    if producer:
        number, ask, _ = _place(F.col("__pos"), opts)
        return positions(events, producer, seq=seq, out="__pos").select(*events.columns, number.alias("batch_no"), ask.alias("ask"))
    number, ask, _ = _place(F.col(seq).cast("bigint"), opts)
    return events.withColumn("batch_no", number).withColumn("ask", ask)


def rate_limit(events: DataFrame, per_tick: int, seq: str = "seq", arrival: str | None = None) -> DataFrame:
    """events with tick, the interval at which each is handled when `per_tick` are asked at each tick.

    arrival: ticks at which events become available; an event is handled at the first tick with room, in order.
    """
    if arrival is None:
        return events.withColumn("tick", F.floor(F.col(seq) / per_tick).cast("bigint"))
    # with n events before it, event i starts no earlier than any j <= i arrived plus the ticks that j to i need;
    # slots, not whole ticks, keep the prefix maximum exact
    slot = F.col(arrival) * per_tick - F.col(seq)
    rows = events.withColumn("__block", F.floor(F.col(seq) / _BLOCK)).withColumn("__slot", slot)
    blocks = rows.groupBy("__block").agg(F.max("__slot").alias("__most"))  # one row for each _BLOCK events
    blocks = blocks.select("__block", F.max("__most").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__base"))
    inside = F.max("__slot").over(Window.partitionBy("__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    best = F.greatest(F.coalesce("__base", "__in"), "__in")
    rows = rows.withColumn("__in", inside).join(blocks, "__block")
    return rows.withColumn("tick", F.floor((best + F.col(seq)) / per_tick).cast("bigint")).drop("__block", "__slot", "__in", "__base")
