"""A corpus pipeline of five stages over `documents`; each stage's result is written and read again by the next.

1. toxicity: documents that score 0.5 or more go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the one with the least
   doc_id stays.
3. substring_dedup: words covered by a window of 20 words that starts earlier in the corpus go from the texts.
4. decontamination: documents that hold a benchmark item's passage (similarity 0.8 or more) go.
5. sentencepiece: the texts' pieces, and whether they decode to the text.

A stage gives about as many partitions, and so files, as its input has splits.
Each row is decided by itself: where several have one id, or none, they are told apart by where they are stored, and in a group of
near-duplicates they come after those with an id of their own.
All tables that the stages write on their way are deleted when run() is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, neardup, passages, pieces, toxicity
from sluice.llm.common import drop_paths, drop_table, fresh_dir, intermediates, materialise, splits, table
from sluice.operators.dispatch import BROADCAST_ROWS

ORACLE_SQL = None  # no stage can be expressed in SQL


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).where("toxic_score < 0.5").drop("toxic_score")


def _by_row(docs: DataFrame) -> DataFrame:
    """docs with __key, a number that no two rows share: the doc_id where one row alone has it, else above all of those.

    docs is a stored table, so a row has the same number each time it is read."""
    row = F.lit(1 << 62) + F.monotonically_increasing_id()
    numbered = docs.withColumn("__row", row)
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("__several"))
    n = several.limit(BROADCAST_ROWS + 1).count()
    if n:
        numbered = numbered.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "doc_id", "left")
    shared = F.col("doc_id").isNull() | (F.col("__several").isNotNull() if n else F.lit(False))
    return numbered.withColumn("__key", F.when(shared, F.col("__row")).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, "__key")


def _without(docs: DataFrame, rows: DataFrame, out: DataFrame) -> DataFrame:
    return rows.join(out.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(docs.columns).coalesce(splits(docs))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _by_row(docs)
    return _without(docs, rows, neardup.near_duplicates(rows, id_col="__key").where("not kept"))


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = passages.strip_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns).coalesce(splits(docs))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _by_row(docs)
    return _without(docs, rows, decontaminate.search(rows, table(spark, sf_dir, "benchmark"), id_col="__key"))


def _sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode(docs, decoded=True)
    return found.select(
        *docs.columns,
        "pieces",
        F.size("pieces").cast("long").alias("n_pieces"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("substring_dedup", _substring_dedup),
    ("decontamination", _decontamination),
    ("sentencepiece", _sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with intermediates() as made:
            path = fresh_dir(spark, f"stage-{name}")
            before, docs = docs, materialise(stage(spark, docs, sf_dir), name, path)
        drop_table(before)  # the input's own files are none of materialise()'s
        drop_paths(spark, [p for p in made if p != path])
    return docs
