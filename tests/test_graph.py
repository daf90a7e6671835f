"""Graphs of stages: a diamond with a dispatcher of its own, policies, hooks, resubscription, discards, groups of children, acknowledgements."""

import time

import pytest
from pyspark.sql import functions as F

from sluice.options import OptionError, ProducerOptions, SubscriptionOptions
from sluice.sources.counter import CounterSource
from sluice.sources.pushed import PushedSource, Queue
from sluice.streaming.graph import ByDemand, ByPartition, ChildGroups, Graph, Metrics, buffered_count


def until(test, seconds=90):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.2)
    assert test()


def stream(spark, tmp_path, name, low, high):
    path = str(tmp_path / name)
    spark.range(low, high).withColumnRenamed("id", "seq").write.parquet(path)
    return spark.readStream.schema("seq long").parquet(path)


class Evens:
    """Even events to the first consumer, those above 50 also to the second."""

    def assign(self, events, subscriptions):
        a, b = subscriptions
        to = F.array_compact(F.array(F.when(F.col("seq") % 2 == 0, F.lit(a)), F.when(F.col("seq") > 50, F.lit(b))))
        return events.withColumn("consumer", F.explode(to))


def test_diamond_runs_and_stops_by_policy(spark, tmp_path):
    got, told = {"left": [], "right": []}, []
    put = lambda name: lambda df, n: got[name].extend(r.seq for r in df.collect())
    cancelled = lambda name: lambda to, reason: told.append((name, to, reason))
    graph = Graph(spark, str(tmp_path / "graph"))
    graph.sink("left", [("middle", {"cancel": "permanent"})], put("left"), on_cancel=cancelled("left"), on_subscribe=lambda to, o: told.append(("left", to, o.cancel)))
    graph.sink("right", [("middle", {"cancel": "temporary"})], put("right"), on_cancel=cancelled("right"))
    graph.stage("middle", ["a", "b"], lambda df: df.where("seq <> 7"), dispatcher=Evens())
    graph.source("a", stream(spark, tmp_path, "a", 0, 60)).source("b", stream(spark, tmp_path, "b", 100, 110))
    assert graph.order()[:2] == ["a", "b"] and graph.order()[2] == "middle"
    queries = graph.start()
    try:
        until(lambda: len(got["left"]) == 35 and len(got["right"]) == 19)
        assert sorted(got["left"]) == [*range(0, 60, 2), *range(100, 110, 2)]
        assert sorted(got["right"]) == [*range(51, 60), *range(100, 110)]
        assert graph.stop("middle", "normal") == ["left"]
        assert not queries["left"].isActive and queries["right"].isActive
        assert told == [("left", "middle", "permanent"), ("left", "middle", "normal"), ("right", "middle", "normal")]
    finally:
        graph.close()
    assert not queries["right"].isActive


def test_a_stage_that_fails_takes_its_consumers_along(spark, tmp_path):
    told = []
    graph = Graph(spark, str(tmp_path / "graph"))
    graph.source("a", stream(spark, tmp_path, "a", 0, 5))
    graph.stage("bad", ["a"], lambda df: df.withColumn("x", F.raise_error(F.lit("bad event"))))
    graph.sink("soft", [("bad", {"cancel": "transient"})], lambda df, n: None, on_cancel=lambda to, reason: told.append(reason))
    queries = graph.start()
    try:
        until(lambda: not queries["soft"].isActive)
        assert told == ["error"]
    finally:
        graph.close()


def test_graphs_are_checked(spark, tmp_path):
    make = lambda: Graph(spark, str(tmp_path)).source("a", spark.range(3))
    sink = lambda df, n: None
    with pytest.raises(OptionError, match="unknown stages: b"):
        make().sink("s", ["b"], sink).order()
    with pytest.raises(OptionError, match="subscribe to each other"):
        make().stage("x", ["y"]).stage("y", ["x", "a"]).order()
    with pytest.raises(OptionError, match="is a consumer"):
        make().sink("s", ["a"], sink).sink("t", ["s"], sink).order()
    with pytest.raises(OptionError, match="already_subscribed"):
        make().sink("s", ["a", "a"], sink)
    with pytest.raises(OptionError, match="already started"):
        make().source("a", spark.range(3))
    with pytest.raises(OptionError, match="assign"):
        make().stage("x", ["a"], dispatcher=object())
    with pytest.raises(OptionError, match="max_demand"):
        make().sink("s", [("a", {"max_demand": 0})], sink)


def test_dispatchers_of_stages(spark, tmp_path):
    for name, dispatcher, left, right in (
        ("demand", ByDemand(), {"max_demand": 3}, {"max_demand": 1}),
        ("partition", ByPartition("CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 4 < 3 THEN 'x' ELSE 'y' END"), {"partition": "x"}, {"partition": "y"}),
    ):
        graph = Graph(spark, str(tmp_path / name))
        graph.source("a", stream(spark, tmp_path, f"in-{name}", 0, 40)).stage("middle", ["a"], dispatcher=dispatcher)
        got = {"left": [], "right": []}
        for s, o in (("left", left), ("right", right)):
            graph.sink(s, [("middle", o)], lambda df, n, s=s: got[s].extend(r.seq for r in df.collect()))
        graph.start(once=True)
        graph.close()
        keep = (lambda i: True) if name == "demand" else (lambda i: i % 5)
        assert sorted(got["left"]) == [i for i in range(40) if i % 4 < 3 and keep(i)] and sorted(got["right"]) == [i for i in range(40) if i % 4 == 3 and keep(i)]
    with pytest.raises(OptionError, match="already taken"):
        ByPartition("seq").assign(spark.range(1), {"p": SubscriptionOptions(partition="0"), "q": SubscriptionOptions(partition="0")})


def test_a_larger_demand_than_the_first_is_warned_of(spark, caplog):
    subscriptions = {"a": SubscriptionOptions(max_demand=2), "b": SubscriptionOptions(max_demand=5), "c": SubscriptionOptions(max_demand=1)}
    with caplog.at_level("WARNING", "sluice"):
        ByDemand().assign(spark.range(3).withColumnRenamed("id", "seq"), subscriptions)
    assert [r.getMessage() for r in caplog.records] == ["a maximum demand of 2 is expected, b has 5: different ones overload greedy consumers"]


def test_resubscribe_goes_on_from_the_checkpoint(spark, tmp_path):
    spark.dataSource.register(CounterSource)
    batches, told = [], []
    graph = Graph(spark, str(tmp_path / "graph"))
    graph.source("counter", lambda o: spark.readStream.format("counter").option("demand", o.max_demand).load())
    graph.sink("s", [("counter", {"max_demand": 10})], lambda df, n: batches.append(sorted(r.seq for r in df.collect())), on_cancel=lambda to, reason: told.append(reason))
    graph.start()
    try:
        until(lambda: len(batches) >= 2)
        graph.resubscribe("s", "counter", max_demand=7, selector="seq % 2 = 0")
        n = len(batches)
        until(lambda: len(batches) >= n + 4)
    finally:
        graph.close()
    assert told == ["resubscribe"]
    first = [b for b in batches if any(x % 2 for x in b)]
    seen = [x for b in batches for x in b]
    assert len(seen) == len(set(seen)) and all(len(b) == 10 for b in first)
    turn = max(max(b) for b in first) + 1
    # one batch may have been planned before the change, so the turn is at most one later; then every even number follows
    later = sorted(x for x in seen if x >= turn)
    assert later and later == list(range(later[0], later[-1] + 1, 2)) and later[0] - turn <= 1
    assert min(len(b) for b in batches[len(first) + 1 :]) in (3, 4)


def test_discards_are_told_once_a_batch(spark, tmp_path, caplog):
    lost, got = [], []

    def told(n):
        lost.append(n)
        return len(lost) == 1  # the first is logged, the others not

    path = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 20, i * 20 + 12 - i * 5).withColumnRenamed("id", "seq").coalesce(1).write.mode("append").parquet(path)
    graph = Graph(spark, str(tmp_path / "graph"))
    graph.source("a", spark.readStream.schema("seq long").option("maxFilesPerTrigger", 1).parquet(path))
    graph.sink("s", ["a"], lambda df, n: got.append(sorted(r.seq for r in df.collect())), producer=ProducerOptions(buffer_size=5, buffer_keep="last"), on_discard=told)
    with caplog.at_level("WARNING", "sluice"):
        graph.start(once=True)
    graph.close()
    assert sorted(lost) == [2, 7] and sorted(got) == [[7, 8, 9, 10, 11], [22, 23, 24, 25, 26], [40, 41]]
    assert [r.getMessage() for r in caplog.records] == [f"s has discarded {lost[0]} events from buffer"]


def test_metrics_of_batches_reach_their_hook(spark, tmp_path):
    seen = []
    metrics = Metrics({"buffer": seen.append})
    spark.streams.addListener(metrics)
    try:
        df = stream(spark, tmp_path, "a", 0, 30).observe("buffer", F.count("*").alias("stored"), F.count_if(F.col("seq") >= 25).alias("discarded"))
        df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        until(lambda: seen)
        assert seen == [{"stored": 30, "discarded": 5}]
    finally:
        spark.streams.removeListener(metrics)


def test_buffered_count_is_the_distance_of_offsets():
    progress = {"sources": [{"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7, "2": 3}}}, {"endOffset": 4, "latestOffset": 6}, {"endOffset": None, "latestOffset": None}]}
    assert buffered_count(progress) == 9


def test_a_group_of_children_is_terminated(spark):
    groups = ChildGroups(spark, max_demand=3)

    def children(seconds):
        def wait(batches):
            for batch in batches:
                time.sleep(seconds)
                yield batch

        return lambda: spark.range(2).repartition(2).mapInArrow(wait, "id long").count()

    slow, quick = groups.start("slow", children(60), 2), groups.start("quick", children(3))
    with pytest.raises(OptionError):
        groups.start("more", children(0))
    assert groups.free == 0
    time.sleep(1)
    began = time.time()
    assert groups.terminate("slow") == "ok" and time.time() - began < 30
    assert slow.exception() is not None and groups.free >= 2
    assert quick.result(60) == 2 and groups.free == 3
    assert groups.terminate("slow") == groups.terminate("unknown") == "not_found"


def test_pushes_are_acknowledged_when_their_batch_is_done(spark, tmp_path):
    spark.dataSource.register(PushedSource)
    queue = Queue(str(tmp_path / "queue"))
    for i in range(4):
        queue.push([f"{i}a", f"{i}b"])
    got, acks, fail = [], [], [True]

    def put(df, n):
        rows = [(r.push, r.i, r.event) for r in df.orderBy("push", "i").collect()]
        acks.append((max((r[0] for r in rows), default=-1), queue.acknowledged()))
        if fail[0] and any(r[0] == 2 for r in rows):
            raise RuntimeError("lost")
        got.extend(rows)

    def run():
        return spark.readStream.format("pushed").option("path", str(tmp_path / "queue")).option("demand", 1).load().writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()

    query = run()
    until(lambda: not query.isActive)
    assert queue.acknowledged() <= 2 and [r[0] for r in got] == [0, 0, 1, 1]
    fail[0] = False
    query = run()  # after the crash
    try:
        until(lambda: len(got) >= 8)
        queue.push(["late"])
        until(lambda: len(got) == 9 and queue.acknowledged() >= 4)
    finally:
        query.stop()
    assert got == [(i, j, f"{i}{'ab'[j]}") for i in range(4) for j in range(2)] + [(4, 0, "late")]
    assert all(acked <= last for last, acked in acks)  # no push was acknowledged while its batch was worked on


def test_a_stage_stops_when_its_last_consumer_has_ended(spark, tmp_path):
    graph = Graph(spark, str(tmp_path / "graph"), stop_sources=True)
    graph.source("a", stream(spark, tmp_path, "a", 0, 5)).stage("middle", ["a"])
    for name in ("s", "t"):
        graph.sink(name, ["middle"], lambda df, n: None)
    queries = graph.start()
    try:
        assert graph.stop("s") == [] and queries["middle"].isActive
        assert "middle" in graph.stop("t")
        assert not queries["middle"].isActive
    finally:
        graph.close()
