"""Buffers of leftover events, and messages that wait behind buffered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scan import FREE, clamp_scan, locate
from sluice.functions.sequence import ensure_checkpoint_dir, prefix_sums
from sluice.operators.dispatch import small


def keep(leftovers: DataFrame, size: int | None, which: str = "last", seq: str = "seq") -> DataFrame:
    """The buffered events: the first or the last `size`, or all.  seq is any total order; a bounded buffer is a top-k,
    which needs no sort of all rows."""
    if size is None:
        return leftovers
    if size < 1:
        raise ValueError("a buffer holds one event at least")
    return leftovers.orderBy(F.asc(seq) if which == "first" else F.desc(seq)).limit(size)


def discarded(leftovers: DataFrame, size: int | None) -> DataFrame:
    """One row: stored, buffered and discarded events."""
    n = F.count("*")
    over = F.greatest(n - size, F.lit(0)) if size is not None else F.lit(0)
    return leftovers.agg(n.alias("stored"), (n - over).cast("bigint").alias("buffered"), over.cast("bigint").alias("discarded"))


def fills(log: DataFrame, size: int | None, producer: str = "producer", seq: str = "seq") -> DataFrame:
    """log with fill and fill_before (buffered events, or if below 0 demand that waits), and what each row does: delivered events
    and discarded ones (F1 to F3, F5, F11).

    log: asked (what is asked for at that row) and events (an array of what is dispatched there); of the two one is null.
    Arrivals fill the buffer up to its size and asks empty it; demand that finds nothing waits for the next arrivals.  So a
    row is a clamped sum, and the fill after each row is a scan of such sums.
    """
    if size is not None and size < 1:
        raise ValueError("a buffer holds one event at least")
    came = F.coalesce(F.when(F.col("events").isNotNull(), F.size("events")), F.lit(0)).cast("bigint")
    asked = F.coalesce(F.col("asked").cast("bigint"), F.lit(0).cast("bigint"))
    rows = clamp_scan(log, came - asked, producer, high=FREE if size is None else size, seq=seq)
    waiting, stored = F.greatest(-F.col("fill_before"), F.lit(0)), F.greatest("fill_before", F.lit(0))
    delivered = F.when(came > 0, F.least(came, waiting)).otherwise(F.least(asked, stored))
    discarded = F.when(came > 0, F.col("fill_before") + came - F.col("fill")).otherwise(0)
    return rows.withColumns({"delivered": delivered.cast("bigint"), "discarded": discarded.cast("bigint")})


def buffer_log(log: DataFrame, size: int | None, keep: str = "last", producer: str = "producer", seq: str = "seq") -> DataFrame:
    """producer, event, stored_at, status (delivered, discarded or buffered) and left_at (the row of the log where that happened,
    null for what is buffered at the end), for each event of a log of interleaved arrivals and asks; log as in fills().

    Events leave in the order they came.  `last` gives up the oldest buffered ones, so deliveries and discards both take from the
    front: the i-th event leaves in the row whose removals span i.  `first` turns new ones away: those are known by
    their place in their own row, and the i-th of the others leaves in the row whose deliveries span i.
    """
    ensure_checkpoint_dir(log.sparkSession)
    rows = fills(log, size, producer, seq).checkpoint()  # read by several branches below
    came = F.coalesce(F.when(F.col("events").isNotNull(), F.size("events")), F.lit(0)).cast("bigint")
    refused = F.col("discarded") if keep == "first" else F.lit(0)
    dropped = F.lit(0) if keep == "first" else F.col("discarded")
    rows = rows.select(producer, seq, "events", "delivered", refused.cast("bigint").alias("refused"), dropped.cast("bigint").alias("dropped"), (came - refused).alias("stored"))
    rows = prefix_sums(rows, {"number": F.col("stored"), "gone": F.col("delivered") + F.col("dropped")}, producer, seq=seq)
    events = rows.where("events is not null").select(producer, F.col(seq).alias("stored_at"), "number", "stored", F.posexplode("events").alias("i", "event"))
    events = events.withColumn("number", F.when(F.col("i") < F.col("stored"), F.col("number") + F.col("i")))
    part = lambda status, low, n: F.struct(F.lit(status).alias("status"), low.alias("low"), (low + n).alias("high"))
    parts = F.array(part("delivered", F.col("gone"), F.col("delivered")), part("discarded", F.col("gone") + F.col("delivered"), F.col("dropped")))
    ends = rows.select(producer, F.col(seq).alias("left_at"), F.explode(parts).alias("x")).select(producer, "left_at", "x.*")
    kept = locate(events.where("number is not null"), "number", ends, "low", "high", producer)
    kept = kept.select(producer, "event", "stored_at", F.coalesce("status", F.lit("buffered")).alias("status"), "left_at")
    away = events.where("number is null").select(producer, "event", "stored_at", F.lit("discarded").alias("status"), F.col("stored_at").alias("left_at"))
    return kept.unionByName(away)


def info_anchors(events: DataFrame, infos: DataFrame, takes: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """infos with anchor_seq, the last event buffered when the message came (null: delivered at once), and after_take.

    infos: info, stored_at (events below that number were buffered before it).  takes: take, upto (events below it have
    been taken by then).  Events are not dealt out: each block's last event is found on the map side, and a running maximum over
    the blocks gives what comes before a message's own block; inside that block, events meet the messages, which are sent to them where
    they are few, and only the last one of each is kept.
    """
    width = 1 << 16
    block = lambda c: F.expr(f"`{c}` div {width}L")
    asks = infos.select(F.col("info").cast("string").alias("info"), F.col("stored_at").cast("bigint").alias("stored_at"), block("stored_at").alias("__block"))
    lasts = events.groupBy(block(seq).alias("__block")).agg(F.max(seq).alias("__most"))
    both = lasts.unionByName(asks, allowMissingColumns=True).withColumn("__event", F.col("info").isNull())  # a message comes before its block
    before = Window.orderBy("__block", "__event").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block and message
    base = both.withColumn("__base", F.max("__most").over(before)).where("not __event")
    here = events.select(F.col(seq).alias("__seq"), block(seq).alias("__block")).join(small(asks), "__block").where("__seq < stored_at")
    own = here.groupBy("info", "stored_at").agg(F.max("__seq").alias("__own"))
    out = base.join(own, ["info", "stored_at"], "left").select("info", "stored_at", F.coalesce("__own", "__base").alias("anchor_seq"))
    if takes is None:
        return out
    first = out.join(F.broadcast(takes), F.col("upto") > F.col("anchor_seq"), "left").groupBy("info", "stored_at", "anchor_seq")
    return first.agg(F.min("take").alias("after_take"))
