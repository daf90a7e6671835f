"""Functions with state and postponed events: a stream over several batches and a restart gives what a batch gives."""

from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.streaming.stateful import Declared, map_state, map_state_stream, postpone, postpone_stream

ROWS = "user long, seq long, kind string"
OUT = "user long, seq long, before string, kinds long, last array<long>"
DECLARED = Declared(values={"now": "string", "before": "string"}, lists={"last": "long"}, maps={"kinds": ("string", "long")})


def counted():
    """A function of its own, so that workers need not import this file."""

    def step(state, row):
        """The kind before the present one since the last reset, how often this kind came, and the seqs since the reset."""
        if row["kind"] == "reset":
            for name in ("now", "before", "last"):
                state.clear(name)
        elif row["kind"] != state.get("now"):
            state.put("before", state.get("now"))
            state.put("now", row["kind"])
        state.append("last", row["seq"])
        n = (state.look_up("kinds", row["kind"]) or 0) + 1
        state.enter("kinds", row["kind"], n)
        return [{"user": row["user"], "seq": row["seq"], "before": state.get("before"), "kinds": n, "last": state.items("last")}]

    return step


def rows(spark):
    data = [(i % 5 if i % 3 else 0, i, ["a", "b", "b", "c", "reset", "a", "a"][i * 5 % 7]) for i in range(150)]
    return spark.createDataFrame(data, ROWS).repartition(4), data


def brute(data):
    out, at = set(), {}
    for u, s, k in sorted(data, key=lambda r: r[1]):
        x = at.setdefault(u, {"now": None, "before": None, "last": [], "kinds": {}})
        if k == "reset":
            x |= {"now": None, "before": None, "last": []}
        elif k != x["now"]:
            x["before"], x["now"] = x["now"], k
        x["last"].append(s)
        x["kinds"][k] = x["kinds"].get(k, 0) + 1
        out.add((u, s, x["before"], x["kinds"][k], tuple(x["last"])))
    return out


def found(df):
    return {(r.user, r.seq, r.before, r.kinds, tuple(r.last)) for r in df.collect()}


def test_batch_in_order(spark):
    df, data = rows(spark)
    assert found(map_state(df, counted(), OUT, "user", "seq")) == brute(data)
    assert map_state(df.limit(0), counted(), OUT, "user", "seq").count() == 0


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    df, data = rows(spark)
    for low in (0, 50):
        df.where(F.col("seq").between(low, low + 49)).coalesce(1).write.parquet(str(tmp_path / f"in/{low}"))

    def run():
        stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = map_state_stream(stream, counted(), OUT, DECLARED, "user", "seq")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)

    run()
    df.where("seq >= 100").coalesce(1).write.parquet(str(tmp_path / "in/100"))
    run()  # another query on the same checkpoint
    assert found(spark.read.parquet(str(tmp_path / "out"))) == brute(data)


def held(data, seconds):
    out, due = {}, {}
    for u, s, t in sorted(data, key=lambda r: (r[2], r[1])):
        if u not in due or t >= due[u]:
            due[u] = t + pd.Timedelta(seconds=seconds)
        out[u, s] = due[u]
    return out


@pytest.fixture
def timed(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [(i % 3, i, start + timedelta(seconds=i * i % 400)) for i in range(60)]
    return spark.createDataFrame(data, "user long, seq long, ts timestamp").repartition(3), [(u, s, pd.Timestamp(t).tz_localize(None)) for u, s, t in data]


def test_postponed_events_of_a_batch(timed):
    df, data = timed
    got = {(r.user, r.seq): pd.Timestamp(r.given_at) for r in postpone(df, 60, "user").select("user", "seq", F.date_format("given_at", "yyyy-MM-dd HH:mm:ss").alias("given_at")).collect()}
    assert got == held(data, 60)


def test_timers_of_a_stream(spark, timed, tmp_path):
    df, data = timed
    for i, (low, high) in enumerate(((0, 150), (150, 300), (300, 401))):
        at = F.unix_timestamp("ts") - 1704067200
        df.where((at >= low) & (at < high)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("user long, seq long, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = postpone_stream(stream, 60, "user").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    rows = spark.read.parquet(str(tmp_path / "out")).select("user", "seq", F.date_format("given_at", "yyyy-MM-dd HH:mm:ss").alias("given_at")).collect()
    got = {(r.user, r.seq): pd.Timestamp(r.given_at) for r in rows}
    want = held(data, 60)
    assert len(rows) == len(got) and all(want[k] == v for k, v in got.items())
    last = max(t for *_, t in data)
    assert {k for k, v in want.items() if v <= last} == set(got)  # the others' timers are pending
    assert 0 < len(got) < len(want)
