"""The pipeline against a brute-force version, and the registered queries on the smallest tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import links, split, words

import corpus_pipeline
from sluice.llm import catalogue, pieces, toxicity
from sluice.llm.common import shared_dir, splits


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, at = random.Random(8), tmp_path_factory.mktemp("sf")
    passage, items = words(rng, 70, 9999), [" ".join(words(rng, 35, 9999)) for _ in range(3)]
    rows, labels = [], []
    for i in range(150):
        w = words(rng, 60, 9999)
        if i % 5 == 0:
            w[9:9] = ["you", "moron", "idiot"]
        if i % 7 == 0:
            w[20:20] = passage
        if i % 11 == 0:
            w += items[i % 3].split()
        rows.append((i, " ".join(w) + ".", "en", "s", None))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s", 5) for i in range(0, 150, 9)] + [(5000, None, None, None, None), (5001, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect() if grammar.score(r.text) < 0.5}
    assert len(left) < docs.count()
    roots, _ = links(left, 5, 80)
    left = {i: t for i, t in left.items() if roots[i] == i}
    seen, kept = set(), {}
    for i in sorted(left):
        w = split(left[i])
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        kept[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else left[i]
    clean = {}
    for i, t in kept.items():
        w = split((t or "").lower())
        grams = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
        hit = any(
            sum((grams(w[j : j + len(b)]) & grams(b)).values()) >= 0.8 * sum((grams(w[j : j + len(b)]) | grams(b)).values())
            for b in bench
            for j in range(len(w) - len(b) + 1)
        )
        if not hit:
            clean[i] = t
    assert 0 < len(clean) < len(kept)
    sp = pieces.Codec(open(pieces.default_model(), "rb").read()).sp
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: r.text for i, r in out.items()} == clean
    assert all(r.exact and r.pieces == sp.encode(r.text or "") for r in out.values())


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("h1", F.lit(1)).withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_rows_without_an_id_of_their_own(spark, sf_dir):
    """Stages that remove rows decide each by itself, whatever its id; those without an id of their own come after the others."""
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    rng = random.Random(3)
    clean = [" ".join(words(rng, 60, 9999)) for _ in range(6)]
    rows = [(None, f"{clean[0]} {items[0]}"), (None, clean[1]), (7, clean[2]), (7, f"{items[1]} {clean[3]}"), (8, clean[4]), (None, clean[4] + " tail"), (9, clean[4]), (None, None), (7, clean[5]), (None, clean[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(path := f"{sf_dir}/rows-without-ids")
    stages, stored = dict(corpus_pipeline.STAGES), spark.read.parquet(path)
    left = Counter((r.doc_id, r.text) for r in stages["decontamination"](spark, stored, sf_dir).collect())
    assert left == Counter(x for x in rows if x not in (rows[0], rows[3]))
    left = Counter((r.doc_id, r.text) for r in stages["near_dedup"](spark, stored, sf_dir).collect())
    assert (8, clean[4]) in left and (9, clean[4]) not in left and (None, clean[4] + " tail") not in left
    assert left[7, clean[5]] + left[None, clean[5]] == 1 and sum(left.values()) == len(rows) - 3


def test_intermediate_tables_are_deleted(spark, sf_dir):
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file:")) / "sluice"
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, sf_dir)
    new = set(folder.iterdir()) - before
    assert [p.name.rsplit("-", 1)[0] for p in new] == ["stage-sentencepiece"] and out.count() > 0


def test_stages_give_few_partitions(spark, sf_dir):
    """Each file that a local file system writes with checksums forks the JVM, so a stage must not give one for each shuffle partition."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).rdd.getNumPartitions() <= 2 * splits(docs), name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sentencepiece_takes_one_python_worker_a_task(spark, sf_dir):
    """A short text's pieces are decoded where they were made, giants in a branch of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = [0] * 200  # Python nodes above a node of some depth, since the last shuffle
    for line in plan:
        depth = len(line) - len(line.lstrip(" :+-"))
        cut = any(x in line for x in ("Join", "Aggregate"))
        at = 0 if cut else max((above[d] for d in range(depth - 1, max(-1, depth - 4), -1) if above[d]), default=0)
        above[depth:] = [0] * (200 - depth)
        above[depth] = at + ("MapInArrow" in line)
        assert above[depth] < 2, line


@pytest.mark.parametrize("name", ["op3_toxicity", "op5_licenses", "op9_decontamination"])
def test_queries_return_integer_ids(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes)["doc_id"] == "bigint" and df.count() > 0
