"""Numbering rows inside keys in two levels."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sluice.functions.sequence import positions
from sluice.operators.batching import assign_batches
from sluice.options import SubscriptionOptions


def test_positions_of_hot_rare_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), i * 3 % 5003 - 100, rng.random() < 0.5) for i in range(5003)]
    df = spark.createDataFrame(rows, "k string, seq long, yes boolean").repartition(5)
    want, counted, at, n = {}, {}, defaultdict(int), defaultdict(int)
    for k, s, yes in sorted(rows, key=lambda r: r[1]):
        want[s], counted[s] = at[k], n[k]
        at[k] += 1
        n[k] += yes
    assert {r.seq: r.pos for r in positions(df, "k", width=64).collect()} == want
    assert {r.seq: r.pos for r in positions(df, "k", width=64, when=F.col("yes")).collect()} == counted
    assert positions(df.limit(0), "k").count() == 0
    everything = {r.seq: r.pos for r in positions(df, width=100).collect()}
    assert everything == {s: i for i, s in enumerate(sorted(s for _, s, _ in rows))}


def test_one_key_spans_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(0, 40_000).select(F.col("id").alias("seq"), F.lit("one").alias("p"))
        out = positions(df, "p", width=500)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("pos")).collect()
        assert len(tasks) > 10 and max(r.n for r in tasks) < 10_000
        got = assign_batches(df, SubscriptionOptions(max_demand=100, min_demand=80), producer="p")
        assert got.where("batch_no <> seq div 20 or ask <> 20").count() == 0 and got.count() == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", before)
