"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct shingles.  Equal sets are one class.  Classes get signatures of SYMBOLS minhashes of
16 bits.  By pigeonhole, two signatures that differ in at most 2 CHUNKS - 1 symbols agree, in one of CHUNKS chunks, but
for one symbol at most; each chunk is therefore indexed CHUNK times, each time without one of its symbols.  All pairs
under that distance share an index key, and of pairs at a similarity of 0.8 all but some 1e-5 do.

Buckets (classes with a key in common) are joined without emitting all their pairs:

1. Each bucket has a leader, the class with the most partners over all its buckets; all classes of a bucket are compared
   with it.  Confirmed links are contracted to components, and only pairs across components matter from here on.
2. Buckets of up to SMALL classes give their pairs.
3. In larger buckets a class is told by its edits, the symmetric difference of its set and the leader's; two classes
   differ by the symmetric difference of their edits.  Let slack be the edits of a class beyond what a link to the leader
   allows.  Classes x and y without slack are both linked to the leader.  Where x has slack, a link of x and y needs
   at least half of (slack of x + edits of y - what the sizes allow) edits in common, so with all edits in one order
   (rare ones first) some common edit is among the first of both.  Classes are listed by those first edits, and only
   classes that meet in a list are compared.  This loses no link, and random edits of one text rarely meet.

So a link is only ever skipped between documents that confirmed links connect already: components are those of all links
between candidates.  Every link is confirmed on the full sets: intersection and union sizes of sorted 64-bit shingle hashes.

Defined cases: null, empty and blank texts have empty sets and are linked with nothing; a shorter text is one shingle;
very long texts are compared whole, one pair at a time; rows with the same id are one document whose texts' links are
joined; null ids come back as rows of their own, unlinked; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_table, freed, grams, hashes, materialise, part_of, mix, slices

CHUNKS, CHUNK = 8, 5
SYMBOLS = CHUNKS * CHUNK
#: Most classes of a bucket that gives all its pairs.
SMALL = 8
#: Share of all rows from which on a class of equal sets is dealt out by a broadcast: there are at most so many such classes.
HOT_CLASSES = 4096
#: Rows of ids that a task takes.
TASK_ROWS = 25_000
_SEEDS = [np.uint64(s) for s in np.random.default_rng(1).integers(1, 1 << 63, 2 * SYMBOLS, dtype=np.int64)]


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; of the whole sequence where it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    return np.unique(grams(h, min(n, len(words))) if len(words) >= n else mix(grams(h, len(words)) + np.uint64(len(words))))


def signature(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16-bit minhashes (rows: SYMBOLS) of consecutive sets, none empty."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SYMBOLS, len(starts)), np.uint16)
    for k in range(SYMBOLS):
        a, b = np.uint32(int(_SEEDS[2 * k]) & 0xFFFFFFFF | 1), np.uint32(int(_SEEDS[2 * k + 1]) & 0xFFFFFFFF)
        x = low * a + b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(x, starts).astype(np.uint64)
        out[k] = (mix(least + np.uint64(k)) >> np.uint64(48)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """Index keys (rows: documents) of signatures: each chunk without each one of its symbols."""
    wide = sig.astype(np.uint64)
    out = np.empty((wide.shape[1], CHUNKS * CHUNK), np.uint64)
    for c in range(CHUNKS):
        for skip in range(CHUNK):
            key = np.full(wide.shape[1], c * CHUNK + skip + 1, np.uint64)
            for j in range(CHUNK):
                if j != skip:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[c * CHUNK + j])
            out[:, c * CHUNK + skip] = key
    return out


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                sets = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys, h1, h2 = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                sigs: list = [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    sig = signature(flat, starts)
                    found = index_keys(sig).view(np.int64)
                    one, two = np.add.reduceat(mix(flat), starts).view(np.int64), np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                    for at, i in enumerate(full):
                        keys[i], h1[i], h2[i], sigs[i] = found[at], int(one[at]), int(two[at]), sig[:, at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "h1", "h2", "sig", "keys"],
                )

    return run


def _distance_at_most(most: int):
    """Filter of pairs by the distance of their signatures, sig_a and sig_b; these columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
                near = pa.array((a != b).sum(1) <= most)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(near)

    return run


_PAIR = ["a", "b", "ok", "size_a", "size_b", "edits"]
_PAIR_SCHEMA = "a long, b long, ok boolean, size_a long, size_b long, edits array<long>"


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        last, kept = None, None
        for batch in batches:
            for part in slices(batch, "text_b"):
                out = []
                for a, b, big, at, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "big")), part.column("text_a"), part.column("text_b").to_pylist()):
                    if last is None or a != last or (ta := at.as_py()) != kept[0]:
                        ta = at.as_py()
                        last, kept = a, (ta, shingle_hashes(ta, words))
                    x, y = kept[1], shingle_hashes(tb, words)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * both >= percent * (len(x) + len(y) - both)
                    edits = None
                    if big:  # told apart by leader, so that they can be counted and met by themselves
                        edits = mix(np.setxor1d(x, y, assume_unique=True) ^ mix(np.array([a], np.int64).view(np.uint64))).view(np.int64)
                    out.append((a, b, ok, len(x), len(y), edits))
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=_PAIR)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches.  Least labels and pointer jumps, in
    rounds that each end in a table of the shared folder."""
    tasks = 1 + edges.count() // TASK_ROWS
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges", tasks=tasks)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels", tasks=tasks)
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("root").alias("theirs"))
        heard = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        lower = labels.join(heard, "node").select("node", F.least("root", "theirs").alias("next"), "root")
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = materialise(
            lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")), "labels", tasks=tasks
        )
        changed = not new.where("root != old").isEmpty()
        drop_table(labels)
        labels = part_of(new, "node", "root")
        if not changed:
            drop_table(both)
            return labels


def _with_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows with their class's root; classes that hold more than a HOT_CLASSES-th of all rows are broadcast."""
    hot = F.col("c") > max(100, total // HOT_CLASSES)
    some = F.broadcast(classes.where(hot).select("h1", "h2", F.col("root").alias("hot_root")))
    rows = rows.join(some, ["h1", "h2"], "left")
    rest = classes.where(~hot).select("h1", "h2", F.col("root").alias("own_root"))
    # rows of hot classes find no partner in `rest`; a key of their own deals them out
    key = [F.when(F.col("hot_root").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id")).alias("h1"), F.when(F.col("hot_root").isNull(), F.col("h2")).alias("h2")]
    dealt = rows.select("doc_id", "n", "hot_root", *key)
    return dealt.join(rest, ["h1", "h2"], "left").select("doc_id", "n", F.coalesce("hot_root", "own_root").alias("root"))


def edit_lists(compared: DataFrame, ratio: float) -> DataFrame:
    """doc_id, size, edits, left, side and key: the lists each class b of a large bucket is in, by its edits to leader a.

    A class's edits are ordered from rare to frequent; left is how many there are from one of them on.  Lists of side 0
    are of classes with slack; a class with slack is on side 1 of lists whose side 2 has classes without.  The latter are by
    level of slack, since a common edit at a late place only serves partners of little slack.
    """
    each = compared.where("edits is not null").select("a", "b", "ok", "size_a", "size_b", F.explode("edits").alias("z"))
    often = each.groupBy("z").agg(F.count("*").alias("c"))
    ordered = each.join(often, "z").groupBy("a", "b", "ok", "size_a", "size_b").agg(F.array_sort(F.collect_list(F.struct("c", "z"))).alias("z"))
    slack, left = F.col("edits") - ratio * (F.col("size_a") + F.col("size_b")), F.col("edits") - F.col("place")
    placed = ordered.select("*", F.size("z").alias("edits")).select("*", F.posexplode("z").alias("place", "at")).where("at.c > 1")
    placed = placed.select(F.col("b").alias("doc_id"), F.col("size_b").alias("size"), "edits", "ok", left.alias("left"), F.col("at.z").alias("z"), slack.alias("slack"), "size_a")
    level = lambda x: F.floor(F.log2(F.greatest(x, F.lit(0.5))) / 2 + 1).cast("int")  # noqa: E731  0 below 1, then by powers of 4
    most = 2 * F.col("left") - F.col("edits") + ratio * (F.col("size") - F.col("size_a"))
    far, half = ~F.col("ok"), F.col("slack") / 2 - 1e-6
    own = F.when(far & (F.col("left") >= half + ratio * F.col("size_a")), F.struct(F.lit(0).alias("side"), F.lit(-1).alias("level")))
    other = F.when(far & (F.col("left") >= half), F.struct(F.lit(1).alias("side"), level(F.col("slack")).alias("level")))
    served = F.when(F.col("ok") & (most > 0), F.transform(F.sequence(F.lit(0), level(most)), lambda k: F.struct(F.lit(2).alias("side"), k.alias("level"))))
    lists = F.concat(F.array_compact(F.array(own, other)), F.coalesce(served, F.array().cast("array<struct<side:int,level:int>>")))
    return placed.select("doc_id", "size", "edits", "left", "z", F.explode(lists).alias("x")).select(
        "doc_id", "size", "edits", "left", "x.side", F.xxhash64("z", "x.level").alias("key")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links: percent * union <= 100 * intersection."""
    ratio = (100 - percent) / (100 + percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(
        rows.mapInArrow(freed(_sign(words)), "doc_id long, n long, h1 long, h2 long, sig binary, keys array<long>"),
        "signed",
        compression="zstd",
    )
    total = signed.count()
    tasks, text_tasks = 1 + total // TASK_ROWS, 4 + 4 * total // TASK_ROWS
    known = signed.where("n > 0 and doc_id is not null")
    classes = materialise(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes", tasks=tasks)
    # rows with the same id are one document, whatever their texts
    several = known.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low != high").select("doc_id")
    texts_of = known.join(several, "doc_id").join(classes, ["h1", "h2"]).select("doc_id", "rep")
    least = texts_of.groupBy("doc_id").agg(F.min("rep").alias("low"))
    same = materialise(texts_of.join(least, "doc_id").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "same", tasks=tasks)

    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    entries = materialise(entries.join(shared, "key"), "entries", tasks=tasks, compression="zstd")
    partners = entries.groupBy("doc_id").agg(F.sum("c").alias("partners"))
    sigs = materialise(reps.join(partners, "doc_id").select("doc_id", "sig", "partners"), "sigs", tasks=tasks)
    texts = materialise(rows.join(sigs.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts", tasks=text_tasks, compression="zstd")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """Those pairs (a, b, big) whose signatures are near, and the big ones, compared on their full sets."""
        of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
        full = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "big", "text_a", "text_b")
        return materialise(full.mapInArrow(freed(_confirm(words, percent)), _PAIR_SCHEMA), name, tasks=text_tasks, compression="zstd")

    def near(pairs: DataFrame) -> DataFrame:
        by = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"))
        found = pairs.join(by("a"), "a").join(by("b"), "b").select("a", "b", "sig_a", "sig_b")
        return found.mapInArrow(freed(_distance_at_most(SYMBOLS * 3 // 5)), "a long, b long").distinct().withColumn("big", F.lit(False))

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    order = F.struct("partners", F.xxhash64("doc_id").alias("o"), "doc_id", "n")
    weighed = entries.join(sigs.select("doc_id", "partners").distinct(), "doc_id")
    leader = weighed.groupBy("key").agg(F.max(order).alias("lead"))
    led = entries.join(leader, "key").where("doc_id != lead.doc_id")
    led = led.select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b"), (F.col("c") > SMALL).alias("big"), fits(F.col("n"), F.col("lead.n")).alias("fits"))
    led = materialise(led.groupBy("a", "b").agg(F.max("big").alias("big"), F.max("fits").alias("fits")), "led", tasks=tasks)
    first = compared(led.where("big").select("a", "b", "big").unionByName(near(led.where("fits and not big"))), "first")
    links = first.where("ok").select("a", "b").union(same)
    roots = components(links)

    # pairs across components: of small buckets, and of classes with a common early edit
    rooted = lambda df: df.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "key"))
    few = rooted(entries.where(F.col("c") <= SMALL))
    mixed = few.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    few = few.join(mixed, "key", "left_semi").drop("c")
    pairs = side(few, "a").join(side(few, "b"), "key").where("doc_id_a < doc_id_b and root_a != root_b").where(fits(F.col("n_a"), F.col("n_b")))
    listed = rooted(edit_lists(first, ratio))
    one, two = side(listed.where("side < 2"), "a"), side(listed.where("side != 1"), "b")
    needed = (F.col("edits_a") + F.col("edits_b") - ratio * (F.col("size_a") + F.col("size_b"))) / 2 - 1e-6
    met = one.join(two, "key").where("root_a != root_b and (side_a = 1 or doc_id_a < doc_id_b)").where(F.least("left_a", "left_b") >= needed)
    ends = [F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")]
    pairs = pairs.select(*ends).union(met.where(fits(F.col("size_a"), F.col("size_b"))).select(*ends)).distinct()
    tested = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = compared(near(pairs.join(tested, ["a", "b"], "left_anti")), "second")
    drop_table(texts)
    found = components(first.where("ok").select("a", "b").union(second.where("ok").select("a", "b")).union(same))
    rest = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "c", F.coalesce("root", "rep").alias("root"))
    dealt = _with_class(signed.select("doc_id", "n", "h1", "h2"), rest, total)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = dealt.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out = materialise(out, "components", tasks=tasks)
    drop_table(signed, classes, same, entries, sigs, led, first, second, roots, found)
    return out
