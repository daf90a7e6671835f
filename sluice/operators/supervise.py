"""Supervised work for each event (H1 to H7, H11): bounded concurrency, restarts in rounds within limits, and attempts as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.sequence import ensure_checkpoint_dir
from sluice.operators import policy
from sluice.operators.dispatch import small
from sluice.options import SubscriptionOptions, SupervisorOptions


def _outcome(work: Callable, event: dict) -> tuple[str, str]:
    """(status, reason) of one start: what the work returns, or how it failed."""
    try:
        got = work(event)
    except SystemExit as e:
        return "down", "normal" if not e.code else f"exit:{e.code}"
    except Exception as e:
        return "down", f"error:{type(e).__name__}"
    if got in (None, "ok") or isinstance(got, tuple) and got and got[0] == "ok":
        return "running", "normal"
    if got == "ignore":
        return "ignored", "normal"
    return "down", f"bad_return:{got}" if not isinstance(got, tuple) else f"error:{got[-1]}"


def start_children(events: DataFrame, work: Callable[[dict], object], demand: SubscriptionOptions | None = None) -> DataFrame:
    """events with status and reason, the outcome of one start of a child for each.

    At most `max_demand` children run at a time over all tasks: there are no more tasks than that, and each has its share of
    threads, which take the next event of a batch as soon as they have ended one.
    """
    abreast = (demand or SubscriptionOptions()).max_demand
    tasks = min(abreast, events.sparkSession.sparkContext.defaultParallelism)
    share = abreast // tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(share) as pool:
            for batch in batches:
                rows = batch.to_pylist()
                out: list = [None] * len(rows)
                places = iter(range(len(rows)))

                def loop() -> None:
                    for i in places:  # shared: each place is taken once
                        out[i] = _outcome(work, rows[i])

                if share == 1:
                    loop()
                else:
                    for f in [pool.submit(loop) for _ in range(min(share, len(rows)))]:
                        f.result()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[*batch.schema.names, "status", "reason"])

    schema = events.select("*", F.lit("").alias("status"), F.lit("").alias("reason")).schema
    return events.coalesce(tasks).mapInArrow(run, schema)


def supervise(
    events: DataFrame,
    work: Callable[[dict], object],
    options: SupervisorOptions | None = None,
    demand: SubscriptionOptions | None = None,
    supervisor: str | None = None,
    seq: str = "seq",
    sec: str = "sec",
) -> DataFrame:
    """events with one row for each attempt: attempt, status, reason and action (removed, restarted, shutdown).

    work gets the event's columns and `attempt`.  Temporary children have one attempt.  Transient ones are restarted after an
    abnormal end, at once, so in the same second; one that fails to start again is tried again.  In rounds: each starts
    the children that the last one left to be restarted.  Before the next, the restarts of all rounds tell for each
    supervisor (a column; null: one for all) at which restart, in the order of sec, seq and attempt, there are more than
    max_restarts in max_seconds.  There it shuts down: later starts do not happen, and those that a round made ahead of
    it are taken back out.  More restarts only move that point ahead, so the result is that of the order in time.
    """
    options = options or SupervisorOptions()
    first = start_children(events.withColumn("attempt", F.lit(1)), work, demand)
    soft = policy.is_soft(F.col("reason"))
    if options.restart == "temporary":
        return first.withColumn("action", F.lit("removed"))
    ensure_checkpoint_dir(events.sparkSession)
    keys = [supervisor] if supervisor else []
    failed = (F.col("status") == "down") & ~soft
    rounds = left = first.checkpoint()
    while True:
        limit = breaches(rounds.where(failed), options, supervisor, seq, sec).checkpoint()  # a row for each supervisor
        left = _before(left.where(failed), limit, keys, seq, sec, F.col("attempt"))
        again = left.drop("status", "reason").withColumn("attempt", F.col("attempt") + 1)
        left = start_children(again, work, demand).checkpoint()
        if left.isEmpty():
            break
        rounds = rounds.unionByName(left)
    started = _before(rounds, limit, keys, seq, sec, F.col("attempt") - 1, "__stop")
    here = F.struct(F.col(sec).cast("bigint"), F.col(seq).cast("bigint"), F.col("attempt").cast("bigint"))
    action = F.when(~failed, "removed").when(here == F.col("__stop"), "shutdown").otherwise("restarted")
    return started.withColumn("action", action).select(*first.columns, "action")


def breaches(restarts: DataFrame, options: SupervisorOptions, supervisor: str | None = None, seq: str = "seq", sec: str = "sec") -> DataFrame:
    """For each supervisor the first restart that breaks its limits: stop, a struct of sec, seq and attempt; restarts has attempt.

    A restart breaks them if the one max_restarts before it is no more than max_seconds older.  That is looked up inside buckets of seconds,
    the last ones of which also stand before those of the next, so that a supervisor is spread over tasks.
    """
    keys = [supervisor] if supervisor else []
    width = 64 * options.max_seconds
    at = F.col(sec).cast("bigint")
    bucket = F.floor(at / width)
    late = at - bucket * width >= width - options.max_seconds
    place = F.struct(at.alias("sec"), F.col(seq).cast("bigint").alias("seq"), F.col("attempt").cast("bigint").alias("attempt"))
    rows = restarts.select(*keys, place.alias("stop"), bucket.alias("__own"), F.explode(F.when(late, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))).alias("__bucket"))
    earlier = F.lag("stop.sec", options.max_restarts).over(Window.partitionBy(*keys, "__bucket").orderBy("stop")) if options.max_restarts else F.col("stop.sec")
    found = rows.withColumn("__earlier", earlier).where((F.col("__bucket") == F.col("__own")) & (F.col("__earlier") >= F.col("stop.sec") - options.max_seconds))
    return found.groupBy(*keys).agg(F.min("stop").alias("stop")).where("stop is not null")


def _before(rows: DataFrame, limit: DataFrame, keys: list[str], seq: str, sec: str, attempt, stop: str | None = None) -> DataFrame:
    """Rows that are earlier than their supervisor's stop, or all where there is none."""
    at = limit.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("stop").alias("__stop"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] or F.lit(True)
    joined = rows.join(small(at) if keys else F.broadcast(at), same, "left")
    here = F.struct(F.col(sec).cast("bigint"), F.col(seq).cast("bigint"), attempt.cast("bigint"))
    kept = joined.where(F.col("__stop").isNull() | (here < F.col("__stop")))
    return kept if stop else kept.select(*rows.columns)


def child_counts(attempts: DataFrame) -> DataFrame:
    """specs, active, supervisors and workers, from the last attempt of each child."""
    last = attempts.where("action <> 'restarted'")
    active = F.count_if(F.col("status") == "running")
    return last.agg(F.lit(1).cast("bigint").alias("specs"), active.alias("active"), F.lit(0).cast("bigint").alias("supervisors"), active.alias("workers"))


def children(attempts: DataFrame) -> DataFrame:
    """Children that run."""
    return attempts.where("status = 'running' and action <> 'restarted'")
