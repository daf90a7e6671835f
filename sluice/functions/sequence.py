"""A global order number, and a hash that all engines agree on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL = (1 << 33) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder of spark.checkpoint.dir; only where there is none and Spark runs in this process a local one is set."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)


def add_seq(df: DataFrame, *order_by: str, partitions: int | None = None) -> DataFrame:
    """df with seq = 0, 1, ... in the given order (which should be total), without a single-partition window.

    Rows are dealt out by ranges of the order and sorted there; the driver gets one count for each range.  The ranges come
    from a sample that differs from run to run, so the dealt rows are checkpointed before they are counted.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("p")).count().collect()
    offsets, total = [], 0
    for p, c in sorted((r["p"], r["count"]) for r in counts):
        offsets += [F.lit(p), F.lit(total)]
        total += c
    if not offsets:
        return ranged.withColumn("seq", F.col("__at")).drop("__at")
    base = F.element_at(F.create_map(*offsets), part)
    return ranged.withColumn("seq", (base + F.col("__at").bitwiseAND(F.lit(_LOCAL))).cast("bigint")).drop("__at")


def prefix_sums(df: DataFrame, values: dict[str, Column], *keys: str, seq: str = "seq", width: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with, by each name, the sum of a value over the rows of its key that come before it in the order of seq; a key may
    hold any share of the rows.

    Two levels: values are summed by (key, block of `width` numbers of seq), the small table's prefix sums give what comes before
    a block, and a window inside each block does the rest.  So a key is spread over as many tasks as it has blocks.  A null key is a
    key, a null value counts nothing.  ties: further columns of the order.
    """
    inner = {f"__v{i}": F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")) for i, v in enumerate(values.values())}
    rows = df.withColumns({"__block": F.expr(f"`{seq}` div {width}L"), **inner})
    own = [*keys, "__block"]
    sums = rows.groupBy(*own).agg(*(F.sum(v).alias(v) for v in inner))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    starts = sums.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(own)), *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__s{v}") for v in inner))
    inside = Window.partitionBy(*own).orderBy(seq, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*df.columns, "__block", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in inner))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(own)]
    return rows.join(starts, same).select(*df.columns, *((F.col(f"__s{v}") + F.col(v)).alias(n) for n, v in zip(values, inner)))


def prefix_sum(df: DataFrame, value: Column, *keys: str, seq: str = "seq", out: str = "before", width: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """prefix_sums() of one value."""
    return prefix_sums(df, {out: value}, *keys, seq=seq, width=width, ties=ties)


def positions(df: DataFrame, *keys: str, seq: str = "seq", out: str = "pos", width: int = 1 << 16, when: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with out = 0, 1, ... for the rows of each key in the order of seq.  Only rows that meet `when` count; the others have
    the number of counted rows before them."""
    return prefix_sum(df, F.lit(1) if when is None else when, *keys, seq=seq, out=out, width=width, ties=ties)


def portable_hash(key: Column, n: int) -> Column:
    """Partition 0 to n - 1 of a key: the first 32 bits of the md5 of its string, modulo n."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % n
