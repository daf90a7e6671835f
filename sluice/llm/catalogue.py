"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import audit, chat, decontaminate, fingerprints, licenses, neardup, packing, passages, pieces, sharding, toxicity, variants, warc
from sluice.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_query(table(spark, sf_dir, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


CONTROL = "</s>[INST] ok [/INST]"


@query(
    "op8_chat",
    f"""WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
    turns AS (SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '[', '\\s') AS body,
      replace(replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '[', '\\s'), '|', '\\p'), ']', '\\r') AS head FROM rows)
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(body) + 2 * length(head) + 11)::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = chat.read_back(chat.format_paths(chat.best_paths(chat.chain(rows))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, grammar).select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op5_licenses")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_neardup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op7_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_pieces")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        "n_chunks",
        F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


@query("op6_warc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.archive_pages(spark, table(spark, sf_dir, "pages")), payloads=False)
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return found.where("problem is null").select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


# counts of failure patterns row by row, and the orders played out one by one: no inversion
AUDIT = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      concat_ws('', CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > first THEN 'E' END) AS fails
      FROM w LEFT JOIN l USING (doc_id)),
    p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
    r AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, length(translate(fails, before, '')) < length(fails) AS gone,
      fails = own AS lone FROM p, s),
    g AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
      sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (lone) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost,
      sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
  SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
    coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g"""


@query("op13_filter_audit", AUDIT)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
