"""Minimax contiguous sharding, in DataFrame functions only.

Documents with equal texts are atomic: they go to one shard.  Their groups are ordered by a hash of the text and put
into CELLS cells of consecutive hashes, so that what the driver holds has a fixed bound at any input size; at small
sizes nearly every cell has one group.  The smallest capacity for which a greedy pass over the ordered cells needs no
more than the wanted number of shards is found by binary search; of the cuts within that capacity, those with the least
sum of squared shard sizes are found by dynamic programming over the cells.

Law `bytes`: shard sizes are as near equal as contiguous cuts between cells allow.  A group of copies larger than a
shard's share stays whole, and the others are then made as even as that allows; none is empty if there are cells enough.

Defined cases: a null text has no bytes (size 1) and shares a group with the empty text; repeated rows and rows without
an id each get a slot; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
#: A cell with more than this share of the rows (and LEAST_HOT rows) is numbered in several windows, so that no group of
#: copies meets in one task.  So there are no more than twice HOT_SHARE such windows.
HOT_SHARE, LEAST_HOT = 4096, 64


def cuts(sizes: list[int], shards: int) -> list[int]:
    """First cell of each shard but the first: of the minimax contiguous partitions of the ordered sizes the most even one.

    The least capacity comes first, then the least sum of the shards' squared sizes; no shard is empty if there are cells
    enough.  Row k of the program holds the least sum of the first j cells in k shards, for the j that leave the rest a way
    to end within the capacity; the best last cuts grow with j, so each is sought between those of its neighbours.
    """
    n, total = len(sizes), sum(sizes)
    if n <= shards:
        return list(range(1, n))

    def greedy(capacity: int) -> int:
        used, held = 1, 0
        for s in sizes:
            if held and held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used

    low, high = max(max(sizes), -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if greedy(middle) <= shards:
            high = middle
        else:
            low = middle + 1
    ends = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
    least = np.searchsorted(ends, ends - low)  # the first cell a shard that ends before cell j can have
    furthest = np.searchsorted(ends, ends + low, side="right") - 1
    late, early = [0], [n]
    for k in range(1, shards + 1):
        late.append(min(int(furthest[late[-1]]), n - (shards - k)))
    for k in range(shards - 1, -1, -1):
        early.append(max(int(least[early[-1]]), k))
    early.reverse()
    scaled, cost, back = ends / total, np.zeros(n + 1), []
    for k in range(1, shards + 1):
        rows = late[k] - early[k] + 1
        best = np.full(rows + 2, late[k - 1])  # of row early[k] - 1 + i at i, between two sentinels
        best[0] = early[k - 1]
        found, step = np.zeros(n + 1), 1 << (rows.bit_length() - 1)
        while step:
            at = np.arange(step, rows + 1, 2 * step)
            j = at + early[k] - 1
            first = np.maximum(best[at - step], least[j])
            last = np.minimum(best[np.minimum(at + step, rows + 1)], j - 1)
            many = last - first + 1
            start = np.cumsum(many) - many
            i = np.arange(many.sum()) - np.repeat(start - first, many)
            sums = cost[i] + (np.repeat(scaled[j], many) - scaled[i]) ** 2
            lowest = np.minimum.reduceat(sums, start)
            hits = np.flatnonzero(sums == np.repeat(lowest, many))
            best[at], found[j] = i[hits[np.searchsorted(hits, start)]], lowest
            step //= 2
        cost = found
        back.append(best)
    out = [n]
    for k in range(shards, 1, -1):
        out.append(int(back[k - 1][out[-1] - early[k] + 1]))
    return out[:0:-1]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Columns id, size, text_crc32, law, shard, slot and grown_shard (null for this law) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - (CELLS.bit_length() - 1)).cast("int"))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)).cast("int")
    totals = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # CELLS rows at most
    totals.sort(key=lambda x: x["cell"])
    most = max(LEAST_HOT, sum(x["n"] for x in totals) // HOT_SHARE)
    hot = {x["cell"]: -(-x["n"] // most) for x in totals if x["n"] > most}
    starts = cuts([x["size"] for x in totals], shards)
    first = [totals[i]["cell"] for i in starts]
    spark = docs.sparkSession
    if hot:
        parts = F.create_map(*(F.lit(v) for k, n in hot.items() for v in (k, n)))
        rows = rows.withColumn("part", F.pmod(salt, F.coalesce(F.try_element_at(parts, F.col("cell")), F.lit(1))))
        counted = rows.where(F.col("cell").isin(list(hot))).groupBy("cell", "part").count().collect()
        split = sorted((x["cell"], x["part"], x["count"]) for x in counted)
    else:
        rows, split = rows.withColumn("part", F.lit(0)), []
    counts = sorted(split + [(x["cell"], 0, x["n"]) for x in totals if x["cell"] not in hot])
    offsets, at, following = [], 0, iter([*first, 1 << 30])
    edge = next(following)
    for cell, part, n in counts:
        while cell >= edge:
            at, edge = 0, next(following)
        offsets.append((cell, part, at))
        at += n
    offset = spark.createDataFrame(offsets, "cell int, part int, base long")  # bounded as CELLS and hot are
    order = Window.partitionBy("cell", "part").orderBy("h", F.col("doc_id").asc_nulls_last(), "text_crc32")
    number = F.row_number().over(order) - 1
    place = F.lit(0)
    for c in first:
        place = place + (F.col("cell") >= c).cast("int")
    return (
        rows.withColumn("number", number)
        .join(F.broadcast(offset), ["cell", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            place.alias("shard"),
            (F.col("base") + F.col("number")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
