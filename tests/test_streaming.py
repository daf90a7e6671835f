"""Streams give what batches give."""

from sluice.options import SubscriptionOptions
from sluice.sources.counter import CounterSource
from sluice.streaming.pipeline import Pipeline


def test_pipeline_into_a_sink(spark, tmp_path):
    spark.range(0, 1000).withColumnRenamed("id", "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    p = Pipeline.source(stream).where("seq % 2 = 0").batch(SubscriptionOptions(max_demand=100, min_demand=80))
    p.start(lambda df, n: df.write.mode("append").parquet(out), "sink", str(tmp_path / "c")).awaitTermination(120)
    rows = spark.read.parquet(out)
    assert rows.count() == 500 and rows.where("batch_no = seq div 20").count() == 500


def test_counter_source_streams(spark, tmp_path):
    spark.dataSource.register(CounterSource)
    seen = []
    stream = spark.readStream.format("counter").option("demand", 10).load()
    query = stream.writeStream.foreachBatch(lambda df, n: seen.append([r.seq for r in df.collect()])).option("checkpointLocation", str(tmp_path)).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(300):
            if len(seen) >= 3:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert sorted(seen[0]) == list(range(10)) and sorted(seen[2]) == list(range(20, 30))


def test_take_and_iterate(spark):
    p = Pipeline.source(spark.range(100).withColumnRenamed("id", "seq")).merge(Pipeline.source(spark.range(100, 200).withColumnRenamed("id", "seq")))
    assert [r.seq for r in p.take(3)] == [0, 1, 2] and [r.seq for r in p.iterate()] == list(range(200))
