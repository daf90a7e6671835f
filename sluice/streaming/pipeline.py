"""Pipelines: sources, transformations, dispatch and batching as one declared plan, run as a batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sluice.operators.batching import assign_batches
from sluice.options import OptionError, SubscriptionOptions


class Pipeline:
    """Stages applied in order to a source.  Nothing runs before collect(), iterate() or start() (demand mode
    accumulate); a stream is read at its triggers' pace (forward)."""

    def __init__(self, df: DataFrame, seq: str = "seq"):
        self.df, self.seq = df, seq

    @classmethod
    def source(cls, df: DataFrame, seq: str = "seq") -> Pipeline:
        return cls(df, seq)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """map, filter, flat-map: any DataFrame function; column expressions stay in the JVM."""
        return Pipeline(f(self.df), self.seq)

    def where(self, selector: Column | str) -> Pipeline:
        return Pipeline(self.df.where(selector), self.seq)

    def batch(self, options: SubscriptionOptions, producer: str | None = None) -> Pipeline:
        return Pipeline(assign_batches(self.df, options, self.seq, producer), self.seq)

    def merge(self, *others: Pipeline) -> Pipeline:
        """Fan-in: events of several producers, each in its own order."""
        df = self.df
        for o in others:
            df = df.unionByName(o.df)
        return Pipeline(df, self.seq)

    def take(self, n: int) -> list[Row]:
        return self.df.orderBy(self.seq).limit(n).collect()

    def iterate(self) -> Iterator[Row]:
        """Events in order, partition by partition: demand is what the caller pulls."""
        return self.df.orderBy(self.seq).toLocalIterator(prefetchPartitions=True)

    def start(self, sink: Callable[[DataFrame, int], None], name: str, checkpoint: str, options: SubscriptionOptions | None = None, once: bool = True) -> StreamingQuery:
        """Run a streaming source into a sink, batch by batch.  A batch's offsets are committed after its sink returned,
        so that demand for the next one follows the work on this one."""
        if not self.df.isStreaming:
            raise OptionError("the source is not a stream")
        writer = self.df.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(sink)
        return (writer.trigger(availableNow=True) if once else writer).start()


class Subscriptions(StreamingQueryListener):
    """Applies cancel policies: when a query ends, the queries that subscribed to it stop or go on (G5, G7), and a source
    stops when its last subscriber has ended (A4)."""

    def __init__(self, spark: SparkSession, stop_sources: bool = False):
        self.spark, self.stop_sources, self.links, self.names = spark, stop_sources, [], {}
        self.log: list[tuple[str, str, str]] = []

    def connect(self, consumer: str, to: str, **options) -> None:
        opts = SubscriptionOptions(to=to, **options)
        if any(c == consumer and o.to == to for c, o in self.links):
            raise OptionError("already_subscribed")
        self.links.append((consumer, opts))

    def reconnect(self, consumer: str, to: str, **options) -> None:
        self.disconnect(consumer, to)
        self.connect(consumer, to, **options)

    def disconnect(self, consumer: str, to: str) -> None:
        self.links = [(c, o) for c, o in self.links if not (c == consumer and o.to == to)]

    def ended(self, name: str, reason: str) -> list[str]:
        """Names of the queries to stop after one ended."""
        soft = reason in ("normal", "shutdown") or reason.startswith("shutdown:")
        stop = [c for c, o in self.links if o.to == name and (o.cancel == "permanent" or o.cancel == "transient" and not soft)]
        sources = {o.to for c, o in self.links if c == name}
        self.links = [(c, o) for c, o in self.links if o.to != name and c != name]
        if self.stop_sources:
            stop += [s for s in sources if not any(o.to == s for _, o in self.links)]
        self.log += [(name, reason, s) for s in stop]
        return stop

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.id), None)
        if name is None:
            return
        stop = set(self.ended(name, "error" if event.exception else "normal"))
        for q in self.spark.streams.active:
            if q.name in stop:
                q.stop()
