"""Scans, the buffer log, queues and restart limits against step-by-step models."""

import random
from collections import defaultdict

import pytest
from model import Buffer, DemandState, PartitionState, Producer
from pyspark.sql import functions as F

from sluice.functions.scan import FREE, clamp_scan, locate
from sluice.operators import buffer, policy, queue, supervise
from sluice.options import SubscriptionOptions, SupervisorOptions


@pytest.mark.parametrize("width", [4, 16, 1024])
def test_clamp_scan(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([None, 1, 1, 1]), s, rng.choice([None, *range(-9, 10)]), rng.choice([-FREE, -5, 0]), rng.choice([FREE, 7, 3])) for s in rng.sample(range(-40, 400), 260)]
    df = spark.createDataFrame(rows, "k long, seq long, a long, low long, high long").repartition(3)
    want, at = {}, defaultdict(lambda: 2)
    for k, s, a, low, high in sorted(rows, key=lambda r: r[1]):
        before = at[k]
        at[k] = min(max(before + (a or 0), low), high)
        want[s] = (before, at[k])
    got = clamp_scan(df, F.col("a"), "k", low=F.col("low"), high=F.col("high"), start=2, width=width).collect()
    assert {r.seq: (r.fill_before, r.fill) for r in got} == want and len(got) == len(rows)
    assert clamp_scan(df.limit(0), F.col("a"), "k").count() == 0


def test_locate(spark):
    rng = random.Random(1)
    ranges, low = [], 0
    for i in range(60):
        low += rng.choice([0, 0, 3])
        high = low + rng.choice([0, 1, 2, 50])
        ranges.append((rng.choice(["a", None]), low, high, f"r{i}"))
        low = high
    points = [(rng.choice(["a", None, "b"]), rng.randrange(-3, low + 5), i) for i in range(400)]
    got = locate(spark.createDataFrame(points, "k string, x long, i int"), "x", spark.createDataFrame(ranges, "k string, low long, high long, name string"), "low", "high", "k", width=8).collect()
    want = {i: next((n for q, a, b, n in ranges if q == k and a <= x < b), None) for k, x, i in points}
    assert {r.i: r.name for r in got} == want and len(got) == len(points)


def traffic(rng, n):
    return [(rng.randrange(3), s, rng.randrange(5), None) if rng.random() < 0.5 else (rng.randrange(3), s, None, [s * 10 + j for j in range(rng.randrange(7))]) for s in range(n)]


@pytest.mark.parametrize(("size", "keep"), [(5, "last"), (5, "first"), (1, "last"), (None, "last")])
def test_buffer_log_equals_the_model(spark, size, keep):
    rng = random.Random(size)
    rows = traffic(rng, 300)
    df = spark.createDataFrame(rows, "producer long, seq long, asked long, events array<long>").repartition(3)
    want = {}
    for p in range(3):
        stage = Producer(DemandState(), Buffer(size, keep))
        stage.step("subscribe", "a")
        held = []
        for _, s, n, events in (r for r in rows if r[0] == p):
            came = [(e, s) for e in events or []]
            out = stage.step("ask", "a", n) if events is None else stage.step("dispatch", events=[e for e, _ in came])
            held += came
            for x in (x for x in out if x[0] == "deliver"):
                for e in x[2]:
                    want[e] = ("delivered", s)
            now = {e for _, e in stage.buffer.events}
            for e, _ in held:
                if e not in want and e not in now:
                    want[e] = ("discarded", s)
        want |= {e: ("buffered", None) for _, e in stage.buffer.events}
    got = buffer.buffer_log(df, size, keep).collect()
    assert {r.event: (r.status, r.left_at) for r in got} == want and len(got) == len(want)
    assert buffer.buffer_log(df.limit(0), size, keep).count() == 0


def test_a_hot_producer_is_split_over_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        log = spark.range(0, 20_000).select(F.lit(1).alias("producer"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 2).alias("asked"), F.when(F.col("id") % 3 > 0, F.array("id")).alias("events"))
        out = buffer.fills(log, 5)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("fill")).collect()
        assert len(tasks) > 8 and max(r.n for r in tasks) < 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_infos_through_partitions_equal_the_model(spark):
    rng = random.Random(8)
    events, asks, infos, want, at = [], [], [], {}, 0
    state = PartitionState(["0", "1", "2"], lambda e: (e, str(e % 3)))
    for p in "012":
        state.subscribe(p, partition=p)
    state.ask(10_000, "0")  # the gate of all partitions together stays open; this one is never behind
    asks.append(("0", -1, 10_000))
    for s in range(500):
        kind = rng.random()
        if kind < 0.4:
            events.append((str(s % 3), s))
            out = state.dispatch([s])[1]
        elif kind < 0.65:
            p, n = rng.choice("12"), 1
            asks.append((p, s, n))
            out = state.ask(n, p)[1]
        else:
            infos.append((s, s))
            want[s] = None
            out = state.info(s)
        for x in out:
            if x[0] == "info":
                for m in x[2]:
                    want[m] = s
    got = queue.info_partitions(spark.createDataFrame(events, "p string, seq long"), spark.createDataFrame(asks, "p string, seq long, n long"), spark.createDataFrame(infos, "name long, seq long")).collect()
    assert {r.name: r.given_at for r in got} == want and any(v is None for v in want.values()) and any(v == k for k, v in want.items())


@pytest.mark.parametrize("group", [None, "g"])
def test_restart_intensity(spark, group):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([rng.randrange(2000), 640, 319, 320])) for i in range(500)]
    got = policy.restart_intensity(spark.createDataFrame(rows, "g string, seq long, sec long").repartition(3), 3, 5, group=group).collect()
    want = {s: sum(t - 5 <= u <= t and (u < t or q <= s) and (not group or h == g) for h, q, u in rows) for g, s, t in rows}
    assert {r.seq: r.recent for r in got} == want and all(r.breach == (r.recent > 3) for r in got)


def brute_supervisor(rows, fails, most, seconds):
    """One supervisor at a time, restarts in the order of time."""
    out = set()
    for name in {r[0] for r in rows}:
        restarts, stopped = [], False
        for g, seq, sec in sorted((r for r in rows if r[0] == name), key=lambda r: (r[2], r[1])):
            attempt = 1
            while not stopped:
                if attempt > fails(seq):
                    out.add((seq, attempt, "running", "removed"))
                    break
                restarts = [t for t in restarts if sec <= t + seconds] + [sec]
                stopped = len(restarts) > most
                out.add((seq, attempt, "down", "shutdown" if stopped else "restarted"))
                attempt += 1
    return out


def _failing():
    def work(event):
        return "ok" if event["attempt"] > event["seq"] % 4 else ("error", "x")

    return work


@pytest.mark.parametrize("most", [0, 2, 6, 1000])
def test_restarts_in_rounds(spark, most):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, i * i % 97) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, seq long, sec long").repartition(3)
    got = supervise.supervise(df, _failing(), SupervisorOptions(restart="transient", max_restarts=most), supervisor="g").collect()
    assert {(r.seq, r.attempt, r.status, r.action) for r in got} == brute_supervisor(rows, lambda s: s % 4, most, 5)
    assert len(got) == len({(r.seq, r.attempt) for r in got})
    alone = supervise.supervise(df.drop("g"), _failing(), SupervisorOptions(restart="transient", max_restarts=most)).collect()
    assert {(r.seq, r.attempt, r.status, r.action) for r in alone} == brute_supervisor([(0, *r[1:]) for r in rows], lambda s: s % 4, most, 5)


def test_children_abreast(spark, tmp_path):
    """Over all tasks no more children run at a time than are asked for."""
    folder = str(tmp_path)

    def work(event):
        import os
        import time

        own = f"{folder}/{event['seq']}"
        open(own, "w").close()
        n = len(os.listdir(folder))
        time.sleep(0.01)
        os.remove(own)
        return ("error", n)

    rows = spark.range(120).withColumnRenamed("id", "seq").repartition(12)
    got = supervise.start_children(rows, work, SubscriptionOptions(max_demand=6)).collect()
    seen = [int(r.reason.split(":")[1]) for r in got]
    assert len(got) == 120 and max(seen) <= 6 and max(seen) > 2
