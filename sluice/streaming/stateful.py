"""Functions with state for each key (C6, J2) and postponed events (C5), over a batch in order and over a stream.

A user's function sees one State, whatever keeps it: plain Python objects while a batch is gone through in order, or the value,
list and map states of transformWithState in a stream, where they outlive batches and restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class State(Protocol):
    """What a function may keep for a key: values by name, lists by name and maps by name."""

    def get(self, name: str) -> Any: ...
    def put(self, name: str, value: Any) -> None: ...
    def items(self, name: str) -> list: ...
    def append(self, name: str, value: Any) -> None: ...
    def look_up(self, name: str, key: Any) -> Any: ...
    def enter(self, name: str, key: Any, value: Any) -> None: ...
    def clear(self, name: str) -> None: ...


@dataclass(frozen=True)
class Declared:
    """Names and SQL types of a key's state: values and lists (name: type), maps (name: (type of keys, type of values))."""

    values: dict[str, str] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)


class _InMemory:
    """The state of the key that a batch is at."""

    def __init__(self):
        self.held: dict[str, Any] = {}

    def get(self, name):
        return self.held.get(name)

    def put(self, name, value):
        self.held[name] = value

    def items(self, name):
        return list(self.held.get(name, []))

    def append(self, name, value):
        self.held.setdefault(name, []).append(value)

    def look_up(self, name, key):
        return self.held.get(name, {}).get(key)

    def enter(self, name, key, value):
        self.held.setdefault(name, {})[key] = value

    def clear(self, name):
        self.held.pop(name, None)


class _InStore:
    """The same on the state store; a state is read as a tuple of one field."""

    def __init__(self, handle: StatefulProcessorHandle, declared: Declared):
        self.value = {n: handle.getValueState(n, f"x {t}") for n, t in declared.values.items()}
        self.list = {n: handle.getListState(n, f"x {t}") for n, t in declared.lists.items()}
        self.map = {n: handle.getMapState(n, f"k {k}", f"x {v}") for n, (k, v) in declared.maps.items()}

    def get(self, name):
        found = self.value[name].get()
        return None if found is None else found[0]

    def put(self, name, value):
        self.value[name].update((value,))

    def items(self, name):
        return [x[0] for x in self.list[name].get()]

    def append(self, name, value):
        self.list[name].appendValue((value,))

    def look_up(self, name, key):
        found = self.map[name].getValue((key,)) if self.map[name].containsKey((key,)) else None
        return None if found is None else found[0]

    def enter(self, name, key, value):
        self.map[name].updateValue((key,), (value,))

    def clear(self, name):
        {**self.value, **self.list, **self.map}[name].clear()


Step = Callable[[State, dict], list]


def map_state(rows: DataFrame, step: Step, output: StructType | str, key: str, *order_by: str) -> DataFrame:
    """What step(state, row) gives for all rows of a batch, those of a key in order; a key starts without state.

    Rows are dealt out by key and sorted, then gone through one by one, so that a task holds the state of one key and a batch of
    rows, however many rows a key has.  The order inside a key is its meaning, so a key is in one task.
    """
    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *order_by)
    return dealt.mapInArrow(_in_order(step, _arrow(output), key), output)


def _arrow(output: StructType | str) -> pa.Schema:
    return to_arrow_schema(output if isinstance(output, StructType) else StructType.fromDDL(output))


def _in_order(step: Step, schema: pa.Schema, key: str, ended: Callable[[Any, State], list] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, _InMemory(), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    if begun and ended:
                        out += ended(now, state)
                    now, state, begun = row[key], _InMemory(), True
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if begun and ended:
            yield pa.RecordBatch.from_pylist(ended(now, state), schema=schema)

    return run


class _Processor(StatefulProcessor):
    """Rows of a batch of the stream in order, after those of the batches before it."""

    def __init__(self, step: Step, declared: Declared, order_by: tuple[str, ...], columns: list[str]):
        self.step, self.declared, self.order_by, self.columns = step, declared, order_by, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = _InStore(handle, self.declared)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(list(self.order_by), kind="stable")
        out = [x for row in found.to_dict("records") for x in self.step(self.state, row)]
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _stored(rows: DataFrame) -> None:
    if not rows.isStreaming:
        raise ValueError("rows are no stream")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def map_state_stream(rows: DataFrame, step: Step, output: StructType | str, declared: Declared, key: str, *order_by: str) -> DataFrame:
    """The same over a stream: each micro-batch continues from the state that the ones before it left."""
    _stored(rows)
    output = output if isinstance(output, StructType) else StructType.fromDDL(output)
    processor = _Processor(step, declared, order_by, output.names)
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "Append", "None")


def _micros(t) -> int:
    return pd.Timestamp(t).value // 1000


def postpone(rows: DataFrame, seconds: int, key: str, at: str = "ts", seq: str = "seq") -> DataFrame:
    """rows (key, seq and the time) with given_at: an event is held, and a key's held events are given out together `seconds`
    after the first of them came.  Those whose time is not reached by the last event of their key are given out at its end all the same.
    """
    hold = seconds * 1_000_000

    def step(state: State, row: dict) -> list:
        out, t = [], _micros(row[at])
        due = state.get("due")
        if due is not None and t >= due:
            out, due = give(row[key], state), None
        if due is None:
            state.put("due", t + hold)
        state.append("held", (row[seq], t))
        return out

    def give(name, state: State) -> list:
        due = pd.Timestamp(state.get("due") * 1000, tz="UTC")
        out = [{key: name, seq: s, at: pd.Timestamp(t * 1000, tz="UTC"), "given_at": due} for s, t in state.items("held")]
        state.clear("held")
        state.clear("due")
        return out

    output = rows.select(key, seq, F.col(at).cast("timestamp").alias(at), F.col(at).cast("timestamp").alias("given_at")).schema
    dealt = rows.select(key, seq, F.col(at).cast("timestamp").alias(at)).repartition(F.col(key)).sortWithinPartitions(key, at, seq)
    return dealt.mapInArrow(_in_order(step, _arrow(output), key, give), output)


class _Postponer(StatefulProcessor):
    """Held events in a list, and a timer of the state store for when they are due."""

    def __init__(self, hold_ms: int, key: str, at: str, seq: str, columns: list[str]):
        self.hold, self.key, self.at, self.seq, self.columns = hold_ms, key, at, seq, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq long, at long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values([self.at, self.seq], kind="stable")
        out = []
        for s, t in zip(found[self.seq].tolist(), found[self.at].tolist()):
            ms = _micros(t) // 1000
            due = self.due.get()
            if due is not None and ms >= due[0]:  # came with or after the end of what is held, in the same batch
                self.handle.deleteTimer(due[0])
                out += self._give(key, due[0])
                due = None
            if due is None:
                self.due.update((ms + self.hold,))
                self.handle.registerTimer(ms + self.hold)
            self.held.appendValue((s, _micros(t)))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._give(key, expiredTimerInfo.getExpiryTimeInMs()), columns=self.columns)

    def _give(self, key, due: int) -> list[tuple]:
        out = [(key[0], s, pd.Timestamp(t * 1000), pd.Timestamp(due * 1_000_000)) for s, t in self.held.get()]
        self.held.clear()
        self.due.clear()
        return out

    def close(self) -> None:
        pass


def postpone_stream(rows: DataFrame, seconds: int, key: str, at: str = "ts", seq: str = "seq", late: str = "0 seconds") -> DataFrame:
    """postpone() over a stream: held events are given out when the watermark passes their time; what is not due stays in the state."""
    _stored(rows)
    known = rows.select(key, seq, at).withWatermark(at, late)
    output = known.select(key, F.col(seq).cast("long").alias(seq), at, F.col(at).alias("given_at")).schema
    plain = StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in output))  # without the watermark's mark
    return known.groupBy(key).transformWithStateInPandas(_Postponer(seconds * 1000, key, at, seq, plain.names), plain, "Append", "EventTime")
