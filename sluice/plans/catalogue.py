"""The registered queries and, where SQL can express them, their DuckDB equivalents.

On `events`, event_id is dense and serves as seq.  Computed columns are cast, so that types agree between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.sequence import add_seq, portable_hash
from sluice.operators import batching, buffer, dispatch, policy, queue, supervise
from sluice.options import PartitionOptions, SubscriptionOptions, SupervisorOptions
from sluice.sources import callback
from sluice.sources.counter import CounterSource, counter, enumerable
from sluice.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function under a name, with its oracle."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("seq", F.col("event_id"))


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


P4 = "('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 4"


# --- sources (2.A)


@query("source_counter", "SELECT range AS seq FROM range((SELECT count(*) FROM events))")
def source_counter(spark, sf_dir):
    return counter(spark, events(spark, sf_dir).count())


@query("source_counter_demand", "SELECT range AS seq FROM range(100, 100 + (SELECT count(*) FROM events))")
def source_counter_demand(spark, sf_dir):
    spark.dataSource.register(CounterSource)
    return spark.read.format("counter").option("start", 100).option("count", events(spark, sf_dir).count()).load()


@query("source_enumerable", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events")
def source_enumerable(spark, sf_dir):
    return enumerable(events(spark, sf_dir).select("event_id", "ts"), "ts", "event_id").select("event_id", "seq")


def _numbers(n: int, state: int) -> tuple[list[int], int]:
    """The next numbers: one fewer than asked after a multiple of 5, two more after one of 7."""
    more = n + 2 * (state % 7 == 0) - (state % 5 == 0)
    return list(range(state, state + max(more, 0))), state + max(more, 0) + (more <= 0)


@query(
    "source_callback",
    """WITH RECURSIVE e AS (SELECT user_id % 20 AS producer, event_id AS seq, event_id % 3 + 1 AS n, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k
      FROM events WHERE event_type IN ('click', 'view')),
    s AS (SELECT DISTINCT producer, 0::BIGINT AS k, -1::BIGINT AS seq, 1::BIGINT AS state, []::BIGINT[] AS made FROM e
      UNION ALL SELECT producer, k, seq, state + greatest(more, 0) + (more <= 0)::INT, range(state, state + greatest(more, 0)) FROM (
        SELECT e.producer, e.k, e.seq, s.state, n + 2 * (s.state % 7 = 0)::INT - (s.state % 5 = 0)::INT AS more FROM s JOIN e ON e.producer = s.producer AND e.k = s.k + 1))
  SELECT producer, seq, (unnest(range(len(made))))::INT AS i, unnest(made) AS event FROM s WHERE k > 0""",
)
def source_callback(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_type in ('click', 'view')")
    return callback.produce(rows.select((F.col("user_id") % 20).alias("producer"), "seq", (F.col("seq") % 3 + 1).alias("n")), _numbers, 1, "long")


# --- transformations (2.C)


@query("pc_map", "SELECT event_id AS seq, event_id * 2 AS event FROM events")
def pc_map(spark, sf_dir):
    return events(spark, sf_dir).select("seq", (F.col("event_id") * 2).alias("event"))


@query("pc_flat_map", "SELECT event_id AS seq, unnest(range(event_id, event_id + 3)) AS event FROM events")
def pc_flat_map(spark, sf_dir):
    return events(spark, sf_dir).select("seq", F.explode(F.sequence("seq", F.col("seq") + 2)).alias("event"))


@query("pc_duplicate", "SELECT event_id AS seq, event_id AS event FROM events UNION ALL SELECT event_id, event_id FROM events")
def pc_duplicate(spark, sf_dir):
    return events(spark, sf_dir).select("seq", F.explode(F.array("seq", "seq")).alias("event"))


@query("pc_filter", "SELECT event_id AS seq, value FROM events WHERE value > 50")
def pc_filter(spark, sf_dir):
    return events(spark, sf_dir).where("value > 50").select("seq", "value")


@query(
    "pc_stateful_map",
    "SELECT user_id, event_id AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events",
)
def pc_stateful_map(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("user_id", "seq", F.round(F.sum("value").over(w), 4).alias("total"))


def _last_other(state, row):
    """The last type of event before the present one that is another, forgotten at each error."""
    if row["event_type"] == "error":
        state.clear("now")
        state.clear("other")
    elif row["event_type"] != state.get("now"):
        state.put("other", state.get("now"))
        state.put("now", row["event_type"])
    return [{"user_id": row["user_id"], "seq": row["seq"], "other": state.get("other")}]


@query(
    "map_state",
    """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, -1::BIGINT AS seq, NULL::VARCHAR AS now, NULL::VARCHAR AS other FROM e
        UNION ALL SELECT e.user_id, e.k, e.seq, CASE WHEN t <> 'error' THEN t END,
          CASE WHEN t = 'error' THEN NULL WHEN t IS DISTINCT FROM now THEN now ELSE other END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
      SELECT user_id, seq, other FROM s WHERE k > 0""",
)
def map_state(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "seq", "event_type")
    return stateful.map_state(rows, _last_other, "user_id long, seq long, other string", "user_id", "seq")


# what is held is given out an hour after the first of it came; the next event begins anew
@query(
    "pc_postpone",
    """WITH RECURSIVE e AS (SELECT user_id % 20 AS producer, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events),
      s AS (SELECT DISTINCT producer, 0::BIGINT AS k, -1::BIGINT AS seq, -1::BIGINT AS due FROM e
        UNION ALL SELECT e.producer, e.k, e.seq, CASE WHEN t >= due THEN t + 3600000000 ELSE due END FROM s JOIN e ON e.producer = s.producer AND e.k = s.k + 1)
      SELECT producer, seq, due AS given_us FROM s WHERE k > 0""",
)
def pc_postpone(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("user_id") % 20).alias("producer"), "seq", "ts")
    return stateful.postpone(rows, 3600, "producer").select("producer", "seq", F.unix_micros("given_at").alias("given_us"))


# --- demand and batching (2.D)


def _batches(name: str, most: int, least: int, batch: str, ask: str):
    @query(name, f"SELECT event_id AS seq, ({batch})::BIGINT AS batch_no, ({ask})::BIGINT AS ask FROM events")
    def run(spark, sf_dir):
        return batching.assign_batches(events(spark, sf_dir).select("seq"), SubscriptionOptions(max_demand=most, min_demand=least))


_batches("batch_default", 1000, 500, "event_id // 500", "500")
_batches("batch_max100_min80", 100, 80, "event_id // 20", "20")
_batches(
    "batch_max100_min20", 100, 20,
    "event_id // 180 * 3 + CASE WHEN event_id % 180 < 80 THEN 0 WHEN event_id % 180 < 100 THEN 1 ELSE 2 END",
    "CASE WHEN event_id % 180 < 80 THEN 80 WHEN event_id % 180 < 100 THEN 0 ELSE 100 END",
)
_batches("batch_max1_min0", 1, 0, "event_id", "1")


@query(
    "batch_asks",
    """SELECT batch_no, min(seq) AS first_seq, count(*) AS n, CASE batch_no % 3 WHEN 0 THEN 80 WHEN 1 THEN 0 ELSE 100 END::BIGINT AS ask FROM (
         SELECT event_id AS seq, event_id // 180 * 3 + CASE WHEN event_id % 180 < 80 THEN 0 WHEN event_id % 180 < 100 THEN 1 ELSE 2 END AS batch_no
         FROM events) GROUP BY batch_no""",
)
def batch_asks(spark, sf_dir):
    rows = batching.assign_batches(events(spark, sf_dir).select("seq"), SubscriptionOptions(max_demand=100, min_demand=20))
    return rows.groupBy("batch_no").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.max("ask").alias("ask"))


@query(
    "batch_multi_producer",
    """SELECT event_id AS seq, user_id % 3 AS producer,
         (row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1) // 20 AS batch_no FROM events""",
)
def batch_multi_producer(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", (F.col("user_id") % 3).alias("producer"))
    return batching.assign_batches(rows, SubscriptionOptions(max_demand=100, min_demand=80), producer="producer").drop("ask")


@query(
    "batch_messages",
    """SELECT event_id AS seq, event_id // 300 AS msg,
         (row_number() OVER (PARTITION BY event_id // 300 ORDER BY event_id) - 1) // 250 AS batch_no FROM events""",
)
def batch_messages(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", big(F.floor(F.col("seq") / 300)).alias("msg"))
    return batching.assign_batches(rows, SubscriptionOptions(max_demand=1000, min_demand=750), message="msg").drop("ask")


@query("rate_limit", "SELECT event_id AS seq, event_id // 10 AS tick FROM events")
def rate_limit(spark, sf_dir):
    return batching.rate_limit(events(spark, sf_dir).select("seq"), 10)


@query(
    "rate_limit_arrivals",
    """SELECT event_id AS seq, (max(event_id // 25 * 10 - event_id) OVER (ORDER BY event_id) + event_id) // 10 AS tick FROM events""",
)
def rate_limit_arrivals(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", big(F.floor(F.col("seq") / 25)).alias("arrived"))
    return batching.rate_limit(rows, 10, arrival="arrived").select("seq", "tick")


# --- dispatchers (2.E)

DEMANDS = [("a", 0, 30), ("b", 1, 50), ("c", 2, 50), ("d", 3, 0), ("e", 4, 10)]
DEMANDS_SQL = "(VALUES ('a', 0, 30), ('b', 1, 50), ('c', 2, 50), ('d', 3, 0), ('e', 4, 10)) t(consumer, pos, demand)"


@query(
    "demand_dispatch",
    f"""SELECT e.event_id AS seq, c.consumer FROM events e LEFT JOIN (
          SELECT consumer, sum(demand) OVER w - demand AS low, sum(demand) OVER w AS high FROM {DEMANDS_SQL} WHERE demand > 0
          WINDOW w AS (ORDER BY demand DESC, pos)) c ON e.event_id >= c.low AND e.event_id < c.high""",
)
def demand_dispatch(spark, sf_dir):
    consumers = values(spark, DEMANDS, "consumer string, pos int, demand long")
    return dispatch.demand_dispatch(events(spark, sf_dir).select("seq"), consumers).select("seq", "consumer")


@query("demand_round_robin", "SELECT event_id AS seq, event_id // 100 % 4 AS consumer FROM events")
def demand_round_robin(spark, sf_dir):
    return dispatch.round_robin(events(spark, sf_dir).select("seq"), 4, 100)


@query(
    "broadcast_all",
    "SELECT event_id AS seq, consumer FROM events, (VALUES ('a'), ('b'), ('c')) t(consumer) WHERE event_id < 400",
)
def broadcast_all(spark, sf_dir):
    subs = values(spark, [("a", 1000), ("b", 400), ("c", 700)], "consumer string, demand long")
    return dispatch.broadcast_dispatch(events(spark, sf_dir).select("seq"), subs).select("seq", "consumer")


SELECTORS = {"buys": "event_type = 'purchase'", "seen": "event_type IN ('view', 'click')", "high": "value > 90", "all": "true"}


@query("broadcast_selector", " UNION ALL ".join(f"SELECT event_id AS seq, '{k}' AS consumer FROM events WHERE {v}" for k, v in SELECTORS.items()))
def broadcast_selector(spark, sf_dir):
    return dispatch.select_dispatch(events(spark, sf_dir), SELECTORS).select("seq", "consumer")


@query("broadcast_reask", " UNION ALL ".join(f"SELECT '{k}' AS consumer, count(*) FILTER (NOT ({v})) AS n FROM events" for k, v in SELECTORS.items()))
def broadcast_reask(spark, sf_dir):
    return dispatch.reasked(events(spark, sf_dir), SELECTORS)


@query(
    "broadcast_late",
    "SELECT event_id AS seq, consumer FROM events, (VALUES ('a', 0), ('b', 150), ('c', 600)) t(consumer, joined) WHERE event_id < 900 AND event_id >= joined",
)
def broadcast_late(spark, sf_dir):
    subs = values(spark, [("a", 900, 0), ("b", 900, 150), ("c", 900, 600)], "consumer string, demand long, joined long")
    return dispatch.broadcast_dispatch(events(spark, sf_dir).select("seq"), subs).select("seq", "consumer")


@query("gen_event_fanout", "SELECT event_id AS seq, handler, handler || ':' || event_type AS note FROM events, (VALUES ('h1'), ('h2'), ('h3'), ('h4')) t(handler)")
def gen_event_fanout(spark, sf_dir):
    handlers = F.explode(F.array(*map(F.lit, ("h1", "h2", "h3", "h4")))).alias("handler")
    rows = events(spark, sf_dir).select("seq", "event_type", handlers)
    return rows.select("seq", "handler", F.concat("handler", F.lit(":"), "event_type").alias("note"))


@query("partition_hash", f"SELECT event_id AS seq, CAST({P4} AS VARCHAR) AS p FROM events")
def partition_hash(spark, sf_dir):
    return dispatch.partition_by(events(spark, sf_dir), PartitionOptions(4), F.col("user_id")).select("seq", "p")


@query("partition_named", "SELECT event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS p FROM events")
def partition_named(spark, sf_dir):
    options = PartitionOptions(("odd", "even"), "CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END")
    return dispatch.partition_by(events(spark, sf_dir), options).select("seq", "p")


@query("partition_none", "SELECT event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS p FROM events WHERE event_id % 3 <> 0")
def partition_none(spark, sf_dir):
    options = PartitionOptions(("odd", "even"), "CASE WHEN event_id % 3 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END")
    return dispatch.partition_by(events(spark, sf_dir), options).select("seq", "p")


@query("partition_rewrite", f"SELECT event_id AS seq, floor(value)::BIGINT AS event, CAST({P4} AS VARCHAR) AS p FROM events")
def partition_rewrite(spark, sf_dir):
    rows = dispatch.partition_by(events(spark, sf_dir), PartitionOptions(4), F.col("user_id"))
    return rows.select("seq", big(F.floor("value")).alias("event"), "p")


GATE = f"""SELECT seq, CASE WHEN prior >= 600 THEN 'leftover' WHEN p IS NULL THEN 'discarded' WHEN rn <= demand THEN 'accepted' ELSE 'queued' END AS status, p
  FROM (SELECT *, row_number() OVER (PARTITION BY p, prior < 600 ORDER BY seq) AS rn FROM (
    SELECT seq, p, coalesce(sum((p IS NOT NULL)::INT) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM (
      SELECT event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN CAST({P4} AS VARCHAR) END AS p FROM events)))
  LEFT JOIN (VALUES ('0', 100), ('1', 200), ('2', 300), ('3', 0)) t(q, demand) ON p = q"""


def _gate(spark, sf_dir) -> DataFrame:
    p = F.when(F.col("event_id") % 5 != 0, portable_hash(F.col("user_id"), 4).cast("string"))
    demands = values(spark, [("0", 100), ("1", 200), ("2", 300), ("3", 0)], "p string, demand long")
    return dispatch.partition_gate(events(spark, sf_dir).select("seq", p.alias("p")), demands)


@query("partition_gate", GATE)
def partition_gate(spark, sf_dir):
    return _gate(spark, sf_dir).select("seq", "status", "p")


@query("partition_backlog", f"SELECT p, count(*) FILTER (status = 'queued') AS queued FROM ({GATE}) WHERE status IN ('accepted', 'queued') GROUP BY p")
def partition_backlog(spark, sf_dir):
    return dispatch.backlog(_gate(spark, sf_dir).where("status IN ('accepted', 'queued')"))


@query(
    "partition_batches",
    f"""SELECT p, batch_no, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (
         SELECT p, seq, (row_number() OVER (PARTITION BY p ORDER BY seq) - 1) // 20 AS batch_no FROM (
           SELECT event_id AS seq, CAST({P4} AS VARCHAR) AS p FROM events))
       GROUP BY p, batch_no""",
)
def partition_batches(spark, sf_dir):
    rows = dispatch.partition_by(events(spark, sf_dir), PartitionOptions(4), F.col("user_id")).select("p", "seq")
    rows = batching.assign_batches(rows, SubscriptionOptions(max_demand=100, min_demand=80), producer="p")
    return rows.groupBy("p", "batch_no").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# --- buffers and infos (2.F)


@query("buffer_first", "SELECT event_id AS seq FROM events ORDER BY event_id LIMIT 300")
def buffer_first(spark, sf_dir):
    return buffer.keep(events(spark, sf_dir).select("seq"), 300, "first")


@query("buffer_last", "SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 300")
def buffer_last(spark, sf_dir):
    return buffer.keep(events(spark, sf_dir).select("seq"), 300, "last")


@query("buffer_unbounded", "SELECT event_id AS seq FROM events")
def buffer_unbounded(spark, sf_dir):
    return buffer.keep(events(spark, sf_dir).select("seq"), None)


@query("buffer_discards", "SELECT count(*) AS stored, least(count(*), 300) AS buffered, greatest(count(*) - 300, 0) AS discarded FROM events")
def buffer_discards(spark, sf_dir):
    return buffer.discarded(events(spark, sf_dir), 300)


@query("buffered_count", "SELECT least(count(*), 10000) AS buffered FROM events WHERE value > 50")
def buffered_count(spark, sf_dir):
    return buffer.discarded(events(spark, sf_dir).where("value > 50"), 10_000).select("buffered")


def _traffic(spark, sf_dir) -> DataFrame:
    """A log of 20 producers: clicks and views ask for 0 to 2 events, the others are dispatched."""
    ask = F.col("event_type").isin("click", "view")
    rows = events(spark, sf_dir).select((F.col("user_id") % 20).alias("producer"), "seq", F.when(ask, F.col("seq") % 3).alias("asked"), F.when(~ask, F.array("seq")).alias("events"))
    return rows


# the buffer as a list that is filled and emptied row by row
BUFFER_LOG = """WITH RECURSIVE e AS (SELECT user_id % 20 AS producer, event_id AS seq, event_type IN ('click', 'view') AS is_ask, event_id % 3 AS n,
      row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events),
    s AS (SELECT DISTINCT producer, 0::BIGINT AS k, -1::BIGINT AS seq, 0::BIGINT AS waiting, []::BIGINT[] AS held, []::BIGINT[] AS sent, []::BIGINT[] AS lost FROM e
      UNION ALL SELECT e.producer, e.k, e.seq,
        CASE WHEN is_ask THEN s.waiting + greatest(n - len(held), 0) ELSE greatest(s.waiting - 1, 0) END,
        CASE WHEN is_ask THEN held[n + 1:] WHEN s.waiting > 0 THEN held {keep} END,
        CASE WHEN is_ask THEN held[1:n] WHEN s.waiting > 0 THEN [e.seq] ELSE [] END,
        CASE WHEN NOT is_ask AND s.waiting = 0 AND len(held) = 5 THEN {lost} ELSE [] END
      FROM s JOIN e ON e.producer = s.producer AND e.k = s.k + 1)
  SELECT producer, event, event AS stored_at, 'delivered' AS status, seq AS left_at FROM (SELECT producer, seq, unnest(sent) AS event FROM s)
  UNION ALL SELECT producer, event, event, 'discarded', seq FROM (SELECT producer, seq, unnest(lost) AS event FROM s)
  UNION ALL SELECT producer, event, event, 'buffered', NULL FROM (SELECT producer, unnest(arg_max(held, k)) AS event FROM s GROUP BY producer)"""


@query("buffer_log_last", BUFFER_LOG.format(keep="ELSE list_append(held, e.seq)[-5:]", lost="held[1:1]"))
def buffer_log_last(spark, sf_dir):
    return buffer.buffer_log(_traffic(spark, sf_dir), 5, "last")


@query("buffer_log_first", BUFFER_LOG.format(keep="WHEN len(held) = 5 THEN held ELSE list_append(held, e.seq)", lost="[e.seq]"))
def buffer_log_first(spark, sf_dir):
    return buffer.buffer_log(_traffic(spark, sf_dir), 5, "first")


@query(
    "buffer_fill",
    f"SELECT producer, seq, (CASE WHEN waiting > 0 THEN -waiting ELSE len(held) END)::BIGINT AS fill, len(sent)::BIGINT AS delivered, len(lost)::BIGINT AS discarded FROM ({BUFFER_LOG[: BUFFER_LOG.index('  SELECT producer, event')].format(keep='ELSE list_append(held, e.seq)[-5:]', lost='held[1:1]')} SELECT * FROM s WHERE k > 0)",
)
def buffer_fill(spark, sf_dir):
    return buffer.fills(_traffic(spark, sf_dir), 5).select("producer", "seq", "fill", "delivered", "discarded")


INFOS = [("early", 0), ("i1", 7), ("i2", 7), ("i3", 333), ("i4", 900)]


@query(
    "info_barrier",
    """SELECT info, stored_at, anchor_seq, min(take) AS after_take FROM (
         SELECT info, stored_at::BIGINT AS stored_at, max(event_id) AS anchor_seq
         FROM (VALUES ('early', 0), ('i1', 7), ('i2', 7), ('i3', 333), ('i4', 900)) t(info, stored_at)
         LEFT JOIN (SELECT event_id FROM events WHERE event_id % 4 = 1) ON event_id < stored_at GROUP BY ALL)
       LEFT JOIN (VALUES (1, 100), (2, 500), (3, 1000)) k(take, upto) ON upto > anchor_seq GROUP BY ALL""",
)
def info_barrier(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_id % 4 = 1").select("seq")
    takes = values(spark, [(1, 100), (2, 500), (3, 1000)], "take int, upto long")
    return buffer.info_anchors(rows, values(spark, INFOS, "info string, stored_at long"), takes)


# --- sinks (2.B)


@query("stream_take", "SELECT event_id AS seq, event_type FROM events ORDER BY event_id LIMIT 300")
def stream_take(spark, sf_dir):
    return events(spark, sf_dir).orderBy("seq").limit(300).select("seq", "event_type")


@query("stream_merge", "SELECT 'events' AS producer, event_id AS seq FROM events UNION ALL SELECT 'orders', o_orderkey FROM orders")
def stream_merge(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("orders").alias("producer"), F.col("o_orderkey").alias("seq"))
    return events(spark, sf_dir).select(F.lit("events").alias("producer"), "seq").unionByName(orders)


# --- control plane (2.G)


@query(
    "accumulate_replay",
    """SELECT event_id AS seq, pos FROM events JOIN (
         SELECT pos, sum(n) OVER (ORDER BY pos) - n AS low, sum(n) OVER (ORDER BY pos) AS high FROM (VALUES (0, 10), (1, 250), (2, 40)) t(pos, n))
       ON event_id >= low AND event_id < high""",
)
def accumulate_replay(spark, sf_dir):
    asks = values(spark, [(0, 10), (1, 250), (2, 40)], "pos int, n long")
    ranges = asks.select("pos", (F.sum("n").over(Window.orderBy("pos")) - F.col("n")).alias("low"), F.sum("n").over(Window.orderBy("pos")).alias("high"))
    rows = events(spark, sf_dir).select("seq")
    return rows.join(F.broadcast(ranges), (F.col("seq") >= F.col("low")) & (F.col("seq") < F.col("high"))).select("seq", "pos")


REASONS = ["normal", "shutdown", "shutdown:x", "killed", "noproc", "already_subscribed"]
MODES = ["permanent", "transient", "temporary"]
_ENDS = "SELECT event_id AS seq, (['normal', 'shutdown', 'shutdown:x', 'killed', 'noproc', 'already_subscribed'])[event_id % 6 + 1] AS reason, (['permanent', 'transient', 'temporary'])[user_id % 3 + 1] AS mode FROM events"


def _ends(spark, sf_dir, mode: str) -> DataFrame:
    """Each event ends something, for a reason by its number and in a mode by its user."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return events(spark, sf_dir).select("seq", pick(REASONS, F.col("seq") % 6).alias("reason"), pick(MODES, F.col("user_id") % 3).alias(mode))


@query(
    "cancel_policy",
    f"""SELECT seq, mode, reason, CASE WHEN reason = 'already_subscribed' THEN 'keep' WHEN mode = 'permanent' THEN 'stop'
          WHEN mode = 'transient' AND reason NOT IN ('normal', 'shutdown', 'shutdown:x') THEN 'stop' ELSE 'keep' END AS action FROM ({_ENDS})""",
)
def cancel_policy(spark, sf_dir):
    return _ends(spark, sf_dir, "mode").withColumn("action", policy.cancel_action(F.col("mode"), F.col("reason")))


# --- supervised work (2.H)


@query(
    "restart_policy",
    f"""SELECT seq, mode AS restart, reason, CASE WHEN mode = 'permanent' THEN 'rejected'
         WHEN mode = 'transient' AND reason NOT IN ('normal', 'shutdown', 'shutdown:x') THEN 'restarted' ELSE 'removed' END AS action FROM ({_ENDS})""",
)
def restart_policy(spark, sf_dir):
    return _ends(spark, sf_dir, "restart").withColumn("action", policy.restart_action(F.col("restart"), F.col("reason")))


RESTARTS = "SELECT event_id AS seq, floor(epoch(ts))::BIGINT // 600 AS sec FROM events WHERE event_type = 'error'"


@query(
    "restart_intensity",
    f"""SELECT seq, sec, (SELECT count(*) FROM ({RESTARTS}) b WHERE b.sec BETWEEN a.sec - 5 AND a.sec AND b.seq <= a.seq) AS recent,
          (SELECT count(*) FROM ({RESTARTS}) b WHERE b.sec BETWEEN a.sec - 5 AND a.sec AND b.seq <= a.seq) > 3 AS breach FROM ({RESTARTS}) a""",
)
def restart_intensity(spark, sf_dir):
    sec = big(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600))
    rows = events(spark, sf_dir).where("event_type = 'error'").select("seq", sec.alias("sec"))
    return policy.restart_intensity(rows)


@query("supervisor_asks", "SELECT event_id AS seq, CASE WHEN (event_id + 1) % 8 = 0 THEN 8 ELSE 0 END::BIGINT AS ask FROM events")
def supervisor_asks(spark, sf_dir):
    return policy.supervisor_asks(events(spark, sf_dir).select("seq"), 8)


def _child(event: dict):
    """ok, ignore, an error or an exception, by the type of the event and the attempt."""
    kind, attempt = event["event_type"], event["attempt"]
    if kind == "error" and attempt <= event["seq"] % 3 + 1:
        raise RuntimeError(kind)
    return {"signup": "ignore", "click": ("error", "refused") if attempt == 1 else "ok"}.get(kind, "ok")


# each event fails so often, restarts are counted pair by pair, and what comes after the first breach is not there
CHILDREN = """WITH e AS (SELECT user_id % 20 AS supervisor, event_id AS seq, floor(epoch(ts))::BIGINT // 3600 AS sec, event_type,
      CASE event_type WHEN 'error' THEN event_id % 3 + 1 WHEN 'click' THEN 1 ELSE 0 END AS fails FROM events),
    r AS (SELECT supervisor, sec, seq, unnest(range(1, fails + 1)) AS k FROM e),
    i AS (SELECT a.supervisor, a.sec, a.seq, a.k, count(*) AS recent FROM r a JOIN r b ON a.supervisor = b.supervisor AND b.sec BETWEEN a.sec - 5 AND a.sec
      AND (b.sec < a.sec OR b.seq < a.seq OR b.seq = a.seq AND b.k <= a.k) GROUP BY ALL),
    b AS (SELECT supervisor, min([sec, seq, k]) AS stop FROM i WHERE recent > {most} GROUP BY supervisor),
    a AS (SELECT *, unnest(range(1, fails + 2)) AS attempt FROM e)
  SELECT supervisor, seq, event_type, attempt::INT AS attempt,
    CASE WHEN attempt <= fails THEN 'down' WHEN event_type = 'signup' THEN 'ignored' ELSE 'running' END AS status,
    CASE WHEN attempt > fails THEN 'normal' WHEN event_type = 'error' THEN 'error:RuntimeError' ELSE 'error:refused' END AS reason,
    CASE WHEN attempt > fails THEN 'removed' WHEN [sec, seq, attempt] = stop THEN 'shutdown' ELSE 'restarted' END AS action
  FROM a LEFT JOIN b USING (supervisor) WHERE stop IS NULL OR [sec, seq, attempt - 1] < stop"""


def _attempts(spark, sf_dir, most: int) -> DataFrame:
    sec = big(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600))
    rows = events(spark, sf_dir).select((F.col("user_id") % 20).alias("supervisor"), "seq", sec.alias("sec"), "event_type")
    return supervise.supervise(rows, _child, SupervisorOptions(restart="transient", max_restarts=most), supervisor="supervisor").drop("sec")


@query("child_outcomes", CHILDREN.format(most=30))
def child_outcomes(spark, sf_dir):
    return _attempts(spark, sf_dir, 30)


@query("child_outcomes_stricter", CHILDREN.format(most=15))
def child_outcomes_stricter(spark, sf_dir):
    return _attempts(spark, sf_dir, 15)


@query(
    "child_counts",
    """SELECT 1::BIGINT AS specs, count(*) FILTER (event_type IN ('view', 'purchase')) AS active, 0::BIGINT AS supervisors,
         count(*) FILTER (event_type IN ('view', 'purchase')) AS workers FROM events""",
)
def child_counts(spark, sf_dir):
    return supervise.child_counts(supervise.supervise(events(spark, sf_dir).select("seq", "event_type"), _child))


# --- demand that waits: a log for each of 20 producers, from their users' events

FOLD_TOTALS = """WITH a AS (SELECT (user_id % 20)::VARCHAR AS producer, sum(event_id % 3) FILTER (event_type IN ('click', 'view')) AS asked,
    count(*) FILTER (event_type NOT IN ('click', 'view')) AS sent FROM events GROUP BY 1)
  SELECT producer, least(asked, sent)::BIGINT AS delivered, asked::BIGINT AS demanded FROM a"""


@query("fold_unbounded_totals", FOLD_TOTALS)
def fold_unbounded_totals(spark, sf_dir):
    rows = buffer.fills(_traffic(spark, sf_dir), None)
    return rows.groupBy(F.col("producer").cast("string").alias("producer")).agg(F.sum("delivered").alias("delivered"), big(F.sum("asked")).alias("demanded"))


# the j-th event goes out when it is there and the sum of all asks has come to j
FOLD_TIMES = """WITH e AS (SELECT (user_id % 20)::VARCHAR AS producer, event_id AS seq, event_type IN ('click', 'view') AS is_ask, event_id % 3 AS n FROM events),
    asks AS (SELECT producer, seq, sum(n) OVER w - n AS low, sum(n) OVER w AS high FROM e WHERE is_ask WINDOW w AS (PARTITION BY producer ORDER BY seq)),
    got AS (SELECT producer, seq, unnest(range({copies})) AS copy, row_number() OVER (PARTITION BY producer ORDER BY seq) AS k FROM e WHERE NOT is_ask)
  SELECT g.producer, greatest(g.seq, a.seq) AS log_seq, g.seq::VARCHAR AS event FROM got g JOIN asks a
  ON g.producer = a.producer AND (k - 1) * {copies} + copy >= low AND (k - 1) * {copies} + copy < high"""


def _delivered(log: DataFrame) -> DataFrame:
    out = buffer.buffer_log(log, None).where("status = 'delivered'")
    return out.select(F.col("producer").cast("string").alias("producer"), F.col("left_at").alias("log_seq"), F.col("event").cast("string").alias("event"))


@query("fold_delivery_times", FOLD_TIMES.format(copies=1))
def fold_delivery_times(spark, sf_dir):
    return _delivered(_traffic(spark, sf_dir))


@query("fold_gate", FOLD_TIMES.format(copies=2))
def fold_gate(spark, sf_dir):
    """A stage in the middle that makes two events of each, behind a buffer without a bound."""
    twice = F.when(F.col("events").isNotNull(), F.flatten(F.array("events", "events")))
    return _delivered(_traffic(spark, sf_dir).withColumn("events", twice))


# --- pushed events and their acknowledgement (A5, A6, B5), messages through partitions

# queues as lists, row by row
QUEUE = """WITH RECURSIVE e AS (SELECT user_id % 20 AS producer, event_id AS seq, event_type IN ('click', 'view') AS is_ask, event_id % 3 AS n,
      event_type = 'click' AS first, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events),
    d AS (SELECT *, CASE WHEN is_ask AND (first OR {one}) THEN n ELSE 0 END AS n1, CASE WHEN is_ask AND (NOT first OR {one}) THEN n ELSE 0 END AS n2 FROM e),
    s AS (SELECT DISTINCT producer, 0::BIGINT AS k, -1::BIGINT AS seq, 0::BIGINT AS w1, 0::BIGINT AS w2, []::BIGINT[] AS held, []::BIGINT[] AS sent FROM e
      UNION ALL SELECT producer, k, seq, w1 - len(out), w2 - len(out), everything[len(out) + 1:], out FROM (
        SELECT *, everything[1:least(w1, w2)] AS out FROM (
          SELECT d.producer, d.k, d.seq, w1 + n1 AS w1, w2 + n2 AS w2, CASE WHEN is_ask THEN held ELSE list_append(held, d.seq) END AS everything
          FROM s JOIN d ON d.producer = s.producer AND d.k = s.k + 1)))
  SELECT producer, event AS seq, seq AS given_at FROM (SELECT producer, seq, unnest(sent) AS event FROM s)
  UNION ALL SELECT producer, event, NULL FROM (SELECT producer, unnest(arg_max(held, k)) AS event FROM s GROUP BY producer)"""


def _pushes_and_asks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir).select((F.col("user_id") % 20).alias("producer"), "seq", "event_type", (F.col("seq") % 3).alias("n"))
    ask = F.col("event_type").isin("click", "view")
    return rows.where(~ask).select("producer", "seq"), rows.where(ask)


@query("queue_pairing", QUEUE.format(one="true"))
def queue_pairing(spark, sf_dir):
    pushes, asks = _pushes_and_asks(spark, sf_dir)
    return queue.pair(pushes, asks, "producer").select("producer", "seq", "given_at")


@query("queue_broadcast", QUEUE.format(one="false"))
def queue_broadcast(spark, sf_dir):
    """Each pushed event goes to two consumers and is acknowledged when both have asked for it."""
    pushes, asks = _pushes_and_asks(spark, sf_dir)
    demand = queue.common_demand(asks, ["click", "view"], "producer", consumer="event_type")
    return queue.pair(pushes, demand, "producer").select("producer", "seq", "given_at")


@query(
    "info_partitions",
    f"""WITH e AS (SELECT event_id AS seq, {P4} AS p, event_type, event_id % 3 AS n FROM events),
      a AS (SELECT p, seq, sum(n) OVER (PARTITION BY p ORDER BY seq) AS asked FROM e WHERE event_type IN ('click', 'view')),
      i AS (SELECT seq AS name FROM e WHERE event_type = 'signup' AND seq % 19 = 0),
      b AS (SELECT name, p, count(*) AS before FROM i JOIN e ON e.seq < name AND event_type IN ('error', 'purchase') GROUP BY ALL),
      c AS (SELECT name, b.p, min(seq) AS crossed FROM b LEFT JOIN a ON a.p = b.p AND asked > before GROUP BY ALL)
    SELECT name, CASE WHEN count(*) FILTER (p IS NOT NULL AND crossed IS NULL) > 0 THEN NULL ELSE greatest(name, coalesce(max(crossed), name)) END AS given_at
    FROM i LEFT JOIN c USING (name) GROUP BY name""",
)
def info_partitions(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", portable_hash(F.col("user_id"), 4).alias("p"), "event_type", (F.col("seq") % 3).alias("n"))
    infos = rows.where("event_type = 'signup' and seq % 19 = 0").select(F.col("seq").alias("name"), "seq")
    return queue.info_partitions(rows.where("event_type in ('error', 'purchase')"), rows.where("event_type in ('click', 'view')"), infos).select("name", "given_at")


@query("global_seq", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders")
def global_seq(spark, sf_dir):
    return add_seq(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "seq")
