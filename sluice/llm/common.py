"""What the operators of this subpackage share: the shared folder, table helpers and word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir, on the file system that it names.

    Only where the session names none and runs in this process (tests, a single machine) a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = f"file://{own}"
    at, system = _path(spark, found)
    return str(system.makeQualified(at).toString())


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


_MADE: list[list[str]] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sluice/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextlib.contextmanager
def intermediates() -> Iterator[list[str]]:
    """The folders that operators take inside, so that who has stored their result can delete the rest."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at, system = _path(spark, path)
        system.delete(at, True)


#: Shuffle files of a written table's query go as soon as it is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Files of the local file system are written without a side file of checksums.  The file system that writes those starts
#: a program (chmod) for each file, and until it runs, the fork counts as a second JVM of the same size.
_NO_FORK = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialise(df: DataFrame, name: str, path: str | None = None, tasks: int = 0, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and it outlives executors.

    tasks: the most files for it, where its rows are small and their number is known.
    """
    spark, path = df.sparkSession, path or fresh_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        (df.coalesce(tasks) if tasks else df).write.options(**_NO_FORK, **options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def splits(stored: DataFrame) -> int:
    """Partitions in which a stored table is read: by its bytes, at least one for each core."""
    return stored.rdd.getNumPartitions()


#: A key is hot if it has more than such a share of all rows, so there are no more hot keys than this.
HOT_KEYS = 4096


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, salt: list[str]) -> DataFrame:
    """rows of the keys in counted (on, c, further columns), with those columns; c: how many of `total` rows a key has.

    counted is a stored table with one row for each key; the first column of `on` is a number.  Hot keys' few rows are broadcast.  The
    others are joined as usual, and meanwhile rows of hot keys are dealt out by the salt, so that no task gets a key's rows."""
    values = [c for c in counted.columns if c not in (*on, "c")]
    hot = F.col("c") > max(100, total // HOT_KEYS)
    some = counted.where(hot).select(*on, F.lit(True).alias("__hot"), *(F.col(v).alias(f"__hot_{v}") for v in values))
    rest = counted.where(~hot).select(*(F.col(k).alias(f"__{k}") for k in on), F.lit(True).alias("__rest"), *(F.col(v).alias(f"__rest_{v}") for v in values))
    dealt = rows.join(F.broadcast(some), on, "left").withColumn("__key", F.when(F.col("__hot"), F.xxhash64(*salt)).otherwise(F.col(on[0])))
    same = [F.col("__key") == F.col(f"__{on[0]}"), *(F.col(k) == F.col(f"__{k}") for k in on[1:])]
    both = dealt.join(rest, same, "left").where("__hot or __rest")
    return both.select(*rows.columns, *(F.when(F.col("__hot"), F.col(f"__hot_{v}")).otherwise(F.col(f"__rest_{v}")).alias(v) for v in values))


def part_of(stored: DataFrame, *columns: str) -> DataFrame:
    """Columns of a stored table, which is deleted with them."""
    out = stored.select(*columns)
    out._stored_at = getattr(stored, "_stored_at", None)
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete what materialise() gave, once nothing will read it again; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            drop_paths(df.sparkSession, [path])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a file in the shared folder."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: An odd multiplier, 2**64 over the golden ratio, for polynomial hashes of word sequences.
BASE = 0x9E3779B97F4A7C15


def _power(k: int) -> np.uint64:
    return np.uint64(pow(BASE, k, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the bits of a polynomial hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive items, by doubling: about 2 log2(n) vector operations."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, width, done, out = h, 1, 0, None
    left = n
    while left:
        if left & 1:
            if out is None:
                out, done = power, width
            else:
                size = len(h) - done - width + 1
                out = out[:size] * _power(width) + power[done : done + size]
                done += width
        left >>= 1
        if left:
            size = len(power) - width
            power = power[:size] * _power(width) + power[width : width + size]
            width *= 2
    return mix(out[: len(h) - n + 1])


def freed(run: Callable) -> Callable:
    """run, a Python worker's function of a table or of batches, that gives what it no longer holds back to the system.

    Workers live on between tasks, and their allocators keep the most that any task has held."""

    def whole(found):  # without annotations, from which Spark would tell another kind of function
        if not isinstance(found, pa.Table):
            return parts(found)
        out = run(found)
        _release()
        return out

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return whole


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch whose texts have about `most` bytes, a single longer row aside: bounds Python objects."""
    sizes = _sizes(batch.column(column))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
