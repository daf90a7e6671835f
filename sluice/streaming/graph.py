"""A graph of stages on Structured Streaming.

Sources are streams.  A stage takes what it subscribes to, works on it, and its dispatcher says which consumer gets which event;
a sink puts what it gets somewhere.  Each stage and each sink is a query of its own with a checkpoint of its own: a stage writes its
events, by consumer, to a table in the graph's folder, from which its consumers stream.  So a query that ends is a process that ends, and
cancel policies decide about those that subscribed to it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field, replace
from threading import Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from sluice.operators import buffer
from sluice.operators.dispatch import Dispatcher, select_dispatch
from sluice.options import OptionError, ProducerOptions, SubscriptionOptions
from sluice.streaming.pipeline import Subscriptions

_LOG = logging.getLogger("sluice")


class Broadcast:
    """Every event to every consumer whose selector takes it."""

    def assign(self, events: DataFrame, subscriptions: dict[str, SubscriptionOptions]) -> DataFrame:
        return select_dispatch(events, {name: o.selector or "true" for name, o in subscriptions.items()})


class ByDemand:
    """Each event to one consumer: in each round of events a consumer gets a run as long as its demand."""

    def __init__(self, seq: str = "seq"):
        self.seq = seq

    def assign(self, events: DataFrame, subscriptions: dict[str, SubscriptionOptions]) -> DataFrame:
        expected = next(iter(subscriptions.values())).max_demand
        for name, o in subscriptions.items():
            if o.max_demand > expected:
                _LOG.warning("a maximum demand of %d is expected, %s has %d: different ones overload greedy consumers", expected, name, o.max_demand)
        place, low, to = F.pmod(F.col(self.seq), F.lit(sum(o.max_demand for o in subscriptions.values()))), 0, F.lit(None).cast("string")
        for name, o in subscriptions.items():
            to = F.when(place >= low, F.lit(name)).otherwise(to)
            low += o.max_demand
        return events.withColumn("consumer", to)


class ByPartition:
    """Each event to the consumer of its partition; those of partitions without a consumer wait in the stage's table."""

    def __init__(self, partition: str):
        self.partition = partition

    def assign(self, events: DataFrame, subscriptions: dict[str, SubscriptionOptions]) -> DataFrame:
        taken: dict[str, str] = {}
        for name, o in subscriptions.items():
            if o.partition is None:
                raise OptionError(f"{name} has to name a partition")
            if o.partition in taken:
                raise OptionError(f"the partition {o.partition} is already taken by {taken[o.partition]}")
            taken[o.partition] = name
        p, to = F.expr(self.partition).cast("string"), F.lit(None).cast("string")
        for partition, name in taken.items():
            to = F.when(p == partition, F.lit(name)).otherwise(to)
        return events.where(p.isNotNull()).withColumn("consumer", to)


@dataclass
class Node:
    """A source (read), a stage (work) or a sink (put)."""

    name: str
    subscribe_to: list[SubscriptionOptions] = field(default_factory=list)
    read: Callable[[SubscriptionOptions], DataFrame] | None = None
    work: Callable[[DataFrame], DataFrame] | None = None
    put: Callable[[DataFrame, int], None] | None = None
    dispatcher: Dispatcher | None = None
    producer: ProducerOptions = field(default_factory=ProducerOptions)
    on_subscribe: Callable[[str, SubscriptionOptions], None] | None = None
    on_cancel: Callable[[str, str], None] | None = None
    on_discard: Callable[[int], bool] | None = None


class Graph(Subscriptions):
    """Stages by name, started in topological order; as a listener it applies the cancel policies to running queries."""

    def __init__(self, spark: SparkSession, folder: str, stop_sources: bool = False):
        super().__init__(spark, stop_sources)
        self.folder, self.nodes, self.queries, self.lock = folder, {}, {}, Lock()
        self.stopping: dict[str, str] = {}

    # --- building

    def source(self, name: str, stream: DataFrame | Callable[[SubscriptionOptions], DataFrame]) -> Graph:
        """A stream, or a function of the subscription that reads it: its max_demand is what one trigger may bring."""
        return self._add(Node(name, read=stream if callable(stream) else lambda _: stream))

    def stage(self, name: str, subscribe_to: list, work: Callable[[DataFrame], DataFrame] = lambda df: df, dispatcher: Dispatcher | None = None, **hooks) -> Graph:
        """dispatcher: anything with assign(events, subscriptions); broadcast if there is none."""
        if dispatcher is not None and not callable(getattr(dispatcher, "assign", None)):
            raise OptionError("a dispatcher has to offer assign(events, subscriptions)")
        return self._add(Node(name, self._options(subscribe_to), work=work, dispatcher=dispatcher or Broadcast(), **hooks))

    def sink(self, name: str, subscribe_to: list, put: Callable[[DataFrame, int], None], producer: ProducerOptions | None = None, **hooks) -> Graph:
        """put(events, batch number).  producer: its buffer_size is the most events of a batch that put gets, and buffer_keep which."""
        return self._add(Node(name, self._options(subscribe_to), put=put, producer=producer or ProducerOptions(buffer_size=None), **hooks))

    def _add(self, node: Node) -> Graph:
        if node.name in self.nodes:
            raise OptionError(f"{node.name} is already started")
        if node.read is None and not node.subscribe_to:
            raise OptionError(f"{node.name} subscribes to nothing")
        self.nodes[node.name] = node
        return self

    @staticmethod
    def _options(subscribe_to: list) -> list[SubscriptionOptions]:
        found = [s if isinstance(s, SubscriptionOptions) else SubscriptionOptions(to=s) if isinstance(s, str) else SubscriptionOptions(to=s[0], **s[1]) for s in subscribe_to]
        if any(not o.to for o in found):
            raise OptionError("a subscription has to name what it subscribes to")
        if len({o.to for o in found}) < len(found):
            raise OptionError("already_subscribed")
        return found

    def order(self) -> list[str]:
        """Names, each after all that it subscribes to."""
        out, left = [], dict(self.nodes)
        while left:
            ready = [n for n, node in left.items() if all(o.to in out for o in node.subscribe_to)]
            if not ready:
                unknown = {o.to for node in left.values() for o in node.subscribe_to} - set(self.nodes)
                raise OptionError(f"unknown stages: {', '.join(sorted(unknown))}" if unknown else f"the stages {', '.join(sorted(left))} subscribe to each other")
            out += ready
            for n in ready:
                del left[n]
        for node in self.nodes.values():
            for o in node.subscribe_to:
                if self.nodes[o.to].put is not None:
                    raise OptionError(f"{o.to} is a consumer, which has no events to give")
        return out

    def subscriptions(self, name: str) -> dict[str, SubscriptionOptions]:
        """Who subscribes to a stage."""
        return {n: o for n, node in self.nodes.items() for o in node.subscribe_to if o.to == name}

    # --- running

    def start(self, once: bool = False) -> dict[str, StreamingQuery]:
        """One query for each stage and sink, those upstream first.  once: only what is there now, stage after stage; a stage's end is
        then no end of a subscription, and its failure is the caller's."""
        names = self.order()
        if not once:
            self.spark.streams.addListener(self)
        for name in names:
            if self.nodes[name].read is None:
                self.queries[name] = self._run(name, once)
                if once:
                    self.queries[name].awaitTermination()
        return self.queries

    def events(self, name: str, options: SubscriptionOptions) -> DataFrame:
        """What a consumer gets by one subscription."""
        producer = self.nodes[options.to]
        if producer.read is not None:
            df = producer.read(options)
            return df.where(options.selector) if options.selector else df
        table = f"{self.folder}/{options.to}/events"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)  # before its stage has written anything
        schema = self._schema(options.to)
        return self.spark.readStream.schema(StructType([*schema.fields, StructField("consumer", StringType())])).parquet(table).where(F.col("consumer") == name).drop("consumer")

    def _schema(self, name: str) -> StructType:
        node = self.nodes[name]
        return node.work(self._union([self.events(name, o) for o in node.subscribe_to])).schema

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other)
        return df

    def _run(self, name: str, once: bool) -> StreamingQuery:
        node = self.nodes[name]
        for o in node.subscribe_to:
            if not any(c == name and x.to == o.to for c, x in self.links):
                self.links.append((name, o))
            if node.on_subscribe:
                node.on_subscribe(o.to, o)
        df = self._union([self.events(name, o) for o in node.subscribe_to])
        if node.put is None:
            consumers = self.subscriptions(name)
            given = node.dispatcher.assign(node.work(df), consumers) if consumers else node.work(df).withColumn("consumer", F.lit(None).cast("string"))
            writer = given.writeStream.format("parquet").partitionBy("consumer").option("path", f"{self.folder}/{name}/events")
        else:
            writer = df.writeStream.foreachBatch(self._sink(node))
        writer = writer.queryName(name).option("checkpointLocation", f"{self.folder}/{name}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def _sink(self, node: Node) -> Callable[[DataFrame, int], None]:
        size, which = node.producer.buffer_size, node.producer.buffer_keep

        def put(df: DataFrame, batch: int) -> None:
            if size is None:
                return node.put(df, batch)
            seen = Observation()
            kept = buffer.keep(df.observe(seen, F.count("*").alias("stored")), size, which)
            node.put(kept, batch)
            lost = seen.get["stored"] - size  # counted by the same pass that the sink made
            if lost > 0 and (node.on_discard is None or node.on_discard(lost)):
                _LOG.warning("%s has discarded %d events from buffer", node.name, lost)

        return put

    def resubscribe(self, name: str, to: str, **options) -> StreamingQuery:
        """Cancel a subscription and subscribe anew with other options, from where the consumer's checkpoint stands."""
        node = self.nodes[name]
        if not any(o.to == to for o in node.subscribe_to):
            raise OptionError(f"{name} does not subscribe to {to}")
        self.stop(name, "resubscribe", apply=False)
        if node.on_cancel:
            node.on_cancel(to, "resubscribe")
        node.subscribe_to = [replace(o, **options) if o.to == to else o for o in node.subscribe_to]
        self.links = [(c, o) for c, o in self.links if c != name]
        self.queries[name] = self._run(name, False)
        return self.queries[name]

    def stop(self, name: str, reason: str = "normal", apply: bool = True) -> list[str]:
        """Stop a stage for a reason; the names of the consumers that stop with it, by their cancel policies."""
        with self.lock:
            self.stopping[name] = reason
        query = self.queries.get(name)
        if query is not None and query.isActive:
            query.stop()
            query.awaitTermination()
        return self._ended(name, reason) if apply else []

    def _ended(self, name: str, reason: str) -> list[str]:
        with self.lock:
            told = [c for c, o in self.links if o.to == name]
            stop = self.ended(name, reason)
        for consumer in told:
            if self.nodes[consumer].on_cancel:
                self.nodes[consumer].on_cancel(name, reason)
        for consumer in stop:
            stop = stop + self.stop(consumer, "shutdown")
        return stop

    def close(self) -> None:
        """Stop everything, consumers first."""
        for name in reversed(self.order()):
            if name in self.queries:
                self.stop(name, "shutdown", apply=False)
        self.spark.streams.removeListener(self)

    # --- listening; a query that goes on from a checkpoint has its id again, so runs are told apart

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        with self.lock:
            known = name in self.stopping
            self.stopping.pop(name, None)
        if name in self.nodes and not known:  # ended by itself
            self._ended(name, "error" if event.exception else "normal")


class Metrics(StreamingQueryListener):
    """Calls a hook once a batch with what a query observes: hooks by the name of the observation."""

    def __init__(self, hooks: dict[str, Callable[[dict], None]]):
        self.hooks = hooks

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name in self.hooks:
                self.hooks[name](row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def buffered_count(progress: dict) -> int:
    """Events that a stream's sources have and its last batch did not take: the distance of offsets, summed over their parts."""

    def distance(last, end) -> int:
        if isinstance(last, dict):
            return sum(distance(v, end.get(k) if isinstance(end, dict) else None) for k, v in last.items())
        return max(0, int(last) - int(end or 0)) if isinstance(last, (int, float)) else 0

    return sum(distance(s.get("latestOffset"), s.get("endOffset")) for s in progress.get("sources", []))


class ChildGroups:
    """Groups of children that run side by side, each as tagged jobs, and can be ended one by one."""

    def __init__(self, spark: SparkSession, max_demand: int):
        self.spark, self.free, self.groups, self.lock = spark, max_demand, {}, Lock()

    def start(self, name: str, run: Callable[[], object], demand: int = 1) -> Future:
        """Run a function that starts Spark jobs; its demand is taken until it ends."""
        with self.lock:
            if name in self.groups:
                raise OptionError(f"{name} is already started")
            if demand > self.free:
                raise OptionError(f"{name} asks for {demand} children, {self.free} are free")
            self.free -= demand
            done: Future = Future()
            self.groups[name] = done
        tag = f"sluice-{name}"

        def body() -> None:
            self.spark.sparkContext.addJobTag(tag)
            try:
                out, error = run(), None
            except Exception as e:
                out, error = None, e
            with self.lock:
                self.groups.pop(name, None)
                self.free += demand
            done.set_exception(error) if error else done.set_result(out)

        InheritableThread(target=body, daemon=True).start()
        return done

    def terminate(self, name: str) -> str:
        """End a group: ok, or not_found if none of that name runs.  Returns when it has ended and its demand is free."""
        with self.lock:
            done = self.groups.get(name)
        if done is None:
            return "not_found"
        while not done.done():  # a job that starts just now is cancelled the next time
            self.spark.sparkContext.cancelJobsWithTag(f"sluice-{name}")
            try:
                done.exception(0.2)
            except TimeoutError:
                continue
        return "ok"
