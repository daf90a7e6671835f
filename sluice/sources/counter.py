"""Sources: a counter as a Python data source (A1, A2) and finite collections (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sluice.functions.sequence import add_seq


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _spans(start: int, end: int, parts: int) -> list[Span]:
    size = -(-(end - start) // parts) if end > start else 0
    return [Span(a, min(end, a + size)) for a in range(start, end, size)] if size else [Span(start, start)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.count, self.parts = (int(options.get(k, d)) for k, d in (("start", 0), ("count", 1000), ("parts", 4)))

    def partitions(self):
        return _spans(self.start, self.start + self.count, self.parts)

    def read(self, partition):
        yield from ((i,) for i in range(partition.start, partition.end))


class _Stream(DataSourceStreamReader):
    """Each trigger plans `demand` events from the last offset; commit() is the acknowledgement."""

    def __init__(self, options: dict):
        self.start, self.demand, self.parts = (int(options.get(k, d)) for k, d in (("start", 0), ("demand", 500), ("parts", 1)))
        self.planned = None

    def initialOffset(self):
        return {"seq": self.start}

    def latestOffset(self):
        self.planned = (self.start if self.planned is None else self.planned) + self.demand
        return {"seq": self.planned}

    def partitions(self, start, end):
        self.planned = max(self.planned or 0, end["seq"])
        return _spans(start["seq"], end["seq"], self.parts)

    def read(self, partition):
        yield from ((i,) for i in range(partition.start, partition.end))

    def commit(self, end):
        pass


class CounterSource(DataSource):
    """format("counter"): seq = start, start + 1, ...; batch: count rows, stream: demand rows for each trigger."""

    @classmethod
    def name(cls):
        return "counter"

    def schema(self):
        return "seq bigint"

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def counter(spark: SparkSession, count: int, start: int = 0) -> DataFrame:
    """The counter as a plain range, for batches."""
    return spark.range(start, start + count).withColumnRenamed("id", "seq")


def enumerable(df: DataFrame, *order_by: str) -> DataFrame:
    """A finite collection in its order, as a source with seq."""
    return add_seq(df, *order_by)
