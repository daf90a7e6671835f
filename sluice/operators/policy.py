"""Decisions by truth table: cancellation, restarts and their intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.sequence import positions


def is_soft(reason: Column) -> Column:
    """Reasons of an ordinary end."""
    return reason.isin("normal", "shutdown") | reason.startswith("shutdown:")


def cancel_action(mode: Column, reason: Column) -> Column:
    """stop or keep, for a consumer whose subscription was cancelled (noproc: its producer was not there)."""
    stop = (mode == "permanent") | ((mode == "transient") & ~is_soft(reason))
    return F.when(stop & (reason != "already_subscribed"), "stop").otherwise("keep")


def restart_action(restart: Column, reason: Column) -> Column:
    """restarted, removed or rejected, for a child that ended."""
    return F.when(restart == "permanent", "rejected").when((restart == "transient") & ~is_soft(reason), "restarted").otherwise("removed")


def start_outcome(result: Column) -> Column:
    """running or down, for what starting a child returned."""
    return F.when(result.isin("ok", "ok_extra"), "running").otherwise("down")


def restart_intensity(restarts: DataFrame, max_restarts: int = 3, max_seconds: int = 5, seq: str | tuple[str, ...] = "seq", sec: str = "sec", group: str | None = None) -> DataFrame:
    """restarts with recent (those of the last max_seconds, itself included) and breach (more than max_restarts).

    Whole seconds, both ends included; of the same second only those up to now count, in the order of seq (a column or
    several).  Seconds are counted first.  Counts slide inside buckets of seconds; the last ones of a bucket also count in
    the next.  A restart's own second gives its rank, counted in blocks of seq.  So neither a group nor a second, nor having no group, brings
    the restarts together in one task.
    """
    keys = [group] if group else []
    order = (seq,) if isinstance(seq, str) else seq
    width = 64 * max(1, max_seconds)
    seconds = restarts.groupBy(*keys, F.col(sec).cast("bigint").alias("__sec")).agg(F.count("*").alias("__n"))
    bucket = F.floor(F.col("__sec") / width)
    late = F.col("__sec") - bucket * width >= width - max_seconds
    copies = F.when(late, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    near = Window.partitionBy(*keys, "__bucket").orderBy("__sec").rangeBetween(-max_seconds, -1)
    slid = seconds.withColumn("__bucket", F.explode(copies)).withColumn("__earlier", F.coalesce(F.sum("__n").over(near), F.lit(0)))
    slid = slid.where(F.col("__bucket") == bucket).select(*(F.col(k).alias(f"__{k}") for k in keys), "__sec", "__earlier")
    rows = positions(restarts.withColumn("__at", F.col(sec).cast("bigint")), *keys, "__at", seq=order[0], out="__rank", ties=order[1:])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    found = rows.join(slid, [*same, F.col("__at") == F.col("__sec")])
    return found.withColumn("recent", F.col("__earlier") + F.col("__rank") + 1).select(*restarts.columns, "recent").withColumn("breach", F.col("recent") > max_restarts)


def supervisor_asks(downs: DataFrame, min_demand: int, seq: str = "seq") -> DataFrame:
    """Downs that arrive singly, with ask: what the supervisor asks for after each (n counts them from 1)."""
    n = max(min_demand, 1)
    return downs.withColumn("ask", F.when((F.col(seq) + 1) % n == 0, F.lit(n)).otherwise(F.lit(0)).cast("bigint"))
