"""A producer whose function makes events for each demand (A1, J3), as a table function over a log of demands."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: events made for a demand, and the state after it
HandleDemand = Callable[[int, Any], tuple[list, Any]]


def produce(demands: DataFrame, handle_demand: HandleDemand, state: Any, event: str, producer: str = "producer", seq: str = "seq") -> DataFrame:
    """producer, seq (of the demand), i and event, for what handle_demand(n, state) makes of each demand.

    demands: producer, seq and n, and any columns besides.  Each producer starts with `state` and sees its demands in order.  Fewer events than asked
    for leave demand open, more go beyond it: buffer.buffer_log() of demands and events tells when each is delivered.  event: its SQL
    type.  The table function asks for its own partitioning and order, and its schema follows from the demands' table.
    """

    kind = StructType.fromDDL(f"event {event}")[0].dataType

    class Produce:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            types = {f.name: f.dataType for f in table.dataType.fields}
            schema = StructType().add(producer, types[producer]).add(seq, types[seq]).add("i", IntegerType()).add("event", kind)
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(producer)], orderBy=[OrderingColumn(seq)])

        def __init__(self):
            self.state = state

        def eval(self, row):
            events, self.state = handle_demand(row["n"], self.state)
            for i, e in enumerate(events):
                yield row[producer], row[seq], i, e

    return udtf(Produce)(demands.asTable())
