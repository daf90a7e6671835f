"""Events pushed from outside as a stream, each push acknowledged when the batch with its events is committed."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Queue:
    """A folder of numbered pushes, which one producer fills and a stream reads.  Pushes and acknowledgements are whole files."""

    def __init__(self, path: str):
        self.system, self.root = _folder(path)
        for part in ("pushes", "acks"):
            self.system.create_dir(f"{self.root}/{part}", recursive=True)

    def _numbers(self, part: str) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{part}"))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def _put(self, part: str, number: int, content: list) -> None:
        place = f"{self.root}/{part}/{number:012d}"
        with self.system.open_output_stream(f"{place}.new") as out:
            out.write(json.dumps(content).encode())
        self.system.move(f"{place}.new", place)  # seen whole or not at all

    def size(self) -> int:
        """Pushes so far."""
        return (self._numbers("pushes") or [-1])[-1] + 1

    def push(self, events: list[str]) -> int:
        """Add events; the number by which they are acknowledged."""
        number = self.size()
        self._put("pushes", number, events)
        return number

    def read(self, number: int) -> list[str]:
        with self.system.open_input_stream(f"{self.root}/pushes/{number:012d}") as source:
            return json.loads(source.read())

    def acknowledge(self, upto: int) -> None:
        """All pushes below a number have been handled."""
        last = self.acknowledged()
        if upto > last:
            self._put("acks", upto, [last, upto])

    def acknowledged(self) -> int:
        return (self._numbers("acks") or [0])[-1]


class _Pushes(InputPartition):
    def __init__(self, first: int, past: int):
        self.first, self.past = first, past


class _Reader(DataSourceStreamReader):
    """A trigger takes `demand` pushes at most; commit(), which Spark calls once a batch is done, acknowledges them."""

    def __init__(self, options: dict):
        self.path, self.demand, self.parts = options["path"], int(options.get("demand", 1000)), int(options.get("parts", 1))
        self.planned = 0

    def initialOffset(self) -> dict:
        return {"push": 0}

    def latestOffset(self) -> dict:
        queue = Queue(self.path)
        self.planned = min(queue.size(), max(self.planned, queue.acknowledged()) + self.demand)
        return {"push": self.planned}

    def partitions(self, start: dict, end: dict):
        self.planned = max(self.planned, end["push"])
        a, b = start["push"], end["push"]
        size = max(1, -(-(b - a) // self.parts))
        return [_Pushes(i, min(b, i + size)) for i in range(a, b, size)] or [_Pushes(a, a)]

    def read(self, partition):
        queue = Queue(self.path)
        for number in range(partition.first, partition.past):
            for i, event in enumerate(queue.read(number)):
                yield number, i, event

    def commit(self, end: dict) -> None:
        Queue(self.path).acknowledge(end["push"])


class PushedSource(DataSource):
    """format("pushed") with path: push, i and event, in the order they were pushed."""

    @classmethod
    def name(cls):
        return "pushed"

    def schema(self):
        return "push long, i int, event string"

    def streamReader(self, schema):
        return _Reader(self.options)
