"""Substring dedup: repeated-phrase automata over recurring passages of at least `window` words.

1. The documents are copied to the shared folder and read in units of a file's rows, UNIT_ROWS or UNIT_BYTES at most.
2. Of each window's GRAM-word grams the one with the least hash is its anchor; equal windows have equal anchors.  Anchors
   that occur in more than one document recur; only windows at recurring anchors can recur.
3. Those windows' hashes are counted.  Of a hash that occurs in two documents, the document with the least id is the source:
   it gives the words of the passages, runs of up to PASSAGE such windows.
4. Passages go to the units with a document that may hold one, and are compiled there into Aho-Corasick automata of at most
   SHARD_WORDS words each.  A passage is in an automaton by its aligned blocks of window // 2 words; each window has a whole block.
   All documents of the unit stream through all its automata.  Each occurrence of a block is extended, word by word, to the
   longest stretch that document and passage have in common, which covers the windows that start earlier in the source.
Words are compared themselves: the hashes only tell which passages to look for.  Were two windows' hashes ever equal, one
could go unfound, but no other word would be removed.  No text is shuffled but the passages.

A document whose whole text was met under a smaller id is a copy: each of its windows starts earlier there, so it is
resolved without the steps above and does not weigh on them.  Windows that occur earlier in their own document are found there.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; very long texts are streamed
whole; rows with the same id do not count as earlier for each other; rows without an id count as later than all others; an
empty table gives no rows; further columns are kept, and what the operator adds replaces columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import drop_table, file_system, freed, grams, hashes, join_counted, materialise, slices

GRAM = 6
#: Rows and bytes of text that a task takes at a time from a file of the copy, and bytes of the file's row groups.
UNIT_ROWS, UNIT_BYTES, GROUP_BYTES = 2000, 16 << 20, 4 << 20
#: Units that a task takes one after the other: each task writes one file of each table.
TASK_UNITS = 4
#: Most windows of a passage, and words of the passages that share an automaton.
PASSAGE, SHARD_WORDS = 200, 500_000
#: Letters by which an automaton knows a word.
LETTERS = 2
_NO_ID = np.iinfo(np.int64).max


def window_hashes(text: str | None, window: int) -> np.ndarray:
    return grams(hashes((text or "").encode().split()), window)


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of the word hashes, its anchor: the least hash of its GRAM-word grams, by doubling."""
    g = grams(h, min(GRAM, window))
    width, least = 1, g
    span = window - min(GRAM, window) + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(g) - span + 1], least[span - width :][: len(g) - span + 1]) if len(g) >= span else g[:0]


def _read(path: str, first: int, past: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a unit of a file, in batches of bounded size."""
    system, at = file_system(path)
    start = 0
    with system.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        for group in range(file.num_row_groups):
            rows = file.metadata.row_group(group).num_rows
            if start < past and start + rows > first:
                row = start
                for batch in file.iter_batches(256, row_groups=[group], columns=columns):
                    low, high = max(first - row, 0), min(past - row, batch.num_rows)
                    row += batch.num_rows
                    if low < high:
                        yield from slices(batch.slice(low, high - low), "text", 1 << 20)
            start += rows


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("__id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _head(table: pa.Table) -> tuple[str, int, int, int]:
    """File, first row, row after the last and id of a unit, from the row of its group that has them."""
    return (*(table.column(c).drop_null()[0].as_py() for c in ("file", "low", "past")), table.column("uid")[0].as_py())


def _by_row(table: pa.Table, column: str) -> dict[int, np.ndarray]:
    """The values of a column by row number, without the row of the unit itself."""
    some = table.select(["row", column]).drop_null()
    rows, values = (some.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("row", column))
    order = np.argsort(rows, kind="stable")
    starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    return dict(zip(rows[order][starts].tolist(), np.split(values[order], starts[1:])))


def _flat(found: list[tuple[int, int, np.ndarray]], uid: int, name: str, doc: bool) -> pa.Table:
    """One table of (row, id, hashes)."""
    sizes = [len(x) for _, _, x in found]
    out = {name: pa.array(np.concatenate([x for *_, x in found]).view(np.int64) if found else [], pa.int64())}
    out["uid"] = pa.array(np.full(sum(sizes), uid, np.int64))
    out["row"] = pa.array(np.repeat(np.array([r for r, _, _ in found], np.int32), sizes))
    if doc:
        out["doc"] = pa.array(np.repeat(np.array([d for _, d, _ in found], np.int64), sizes))
    return pa.table(out)


def _anchors_of(window: int):
    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        path, low, past, uid = _head(table)
        copies, found, again, row = set(table.column("row").drop_null().to_pylist()), [], [], low
        for part in _read(path, low, past, ["text"]):
            for text in part.column("text").to_pylist():
                if text and row not in copies:
                    h = hashes(text.encode().split())
                    if len(h) >= window:
                        found.append((row, 0, np.unique(anchors(h, window))))
                        w = np.sort(grams(h, window))
                        if (w[1:] == w[:-1]).any():
                            again.append(row)
                row += 1
        marks = {"a": pa.nulls(len(again), pa.int64()), "uid": pa.array([uid] * len(again), pa.int64()), "row": pa.array(again, pa.int32())}
        return pa.concat_tables([_flat(found, uid, "a", False), pa.table(marks)])

    return run


def _windows_of(window: int):
    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        path, low, past, uid = _head(table)
        wanted, found, row = _by_row(table, "a"), [], low
        for part in _read(path, low, past, ["__id", "text"]) if wanted else ():
            for doc, text in zip(_ids(part).tolist(), part.column("text").to_pylist()):
                if (mine := wanted.get(row)) is not None:
                    h = hashes(text.encode().split())
                    found.append((row, doc, np.unique(grams(h, window)[np.isin(anchors(h, window).view(np.int64), mine)])))
                row += 1
        return _flat(found, uid, "w", True)

    return run


def _passages_of(window: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        path, low, past, uid = _head(table)
        wanted, out, row = _by_row(table, "w"), [], low
        for part in _read(path, low, past, ["__id", "text"]) if wanted else ():
            for doc, text in zip(_ids(part).tolist(), part.column("text").to_pylist()):
                if (mine := wanted.get(row)) is not None:
                    words = text.encode().split()
                    w = grams(hashes(words), window).view(np.int64)
                    known = np.concatenate([[False], np.isin(w, mine), [False]])
                    for a, b in np.flatnonzero(np.diff(known)).reshape(-1, 2).tolist():
                        for at in range(a, b, most):
                            end = min(b, at + most)
                            out.append((uid, row, at, doc, b" ".join(words[at : end + window - 1]).decode(), w[at:end]))
                row += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["uid", "row", "at", "doc", "phrase", "ws"])

    return run


class Shard:
    """An automaton of passages over words, and what it covers of documents.

    The automaton library searches a node's edges one by one, and the words that blocks begin with are thousands.  So a
    word's number is spelled as LETTERS digits, each place with an alphabet of its own: a node has few edges, and blocks
    are met at whole words only.
    """

    def __init__(self, window: int):
        self.window, self.block = window, window // 2
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, np.ndarray]] = []
        self.words = 0

    def add(self, doc: int, phrase: bytes) -> None:
        """A passage that starts in a document."""
        number = self.numbers
        self.passages.append((doc, np.array([number.setdefault(w, len(number) + 1) for w in phrase.split()], np.int64)))
        self.words += len(self.passages[-1][1])

    def spell(self, ids: np.ndarray) -> str:
        return self.letters[ids].tobytes().decode("utf-32-le")

    def build(self) -> ahocorasick.Automaton:
        number, base = np.arange(len(self.numbers) + 1), 1  # 0 for words that no passage has
        while base**LETTERS < len(number):
            base += 1
        self.letters = np.stack([number // base**j % base + j * base + 1 for j in range(LETTERS)], 1).astype("<u4")
        places: dict[str, list[tuple[int, int, int]]] = {}
        for i, (doc, ids) in enumerate(self.passages):
            spelled = self.spell(ids)
            for at in range(0, len(ids) - self.block + 1, self.block):
                places.setdefault(spelled[at * LETTERS : (at + self.block) * LETTERS], []).append((doc, i, at))
        out = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for block, found in places.items():
            out.add_word(block, sorted(found))
        out.make_automaton()
        return out

    def cover(self, docs: list[tuple[int, list[bytes]]], earlier: list[np.ndarray]) -> None:
        """Mark, for each document (id, words), the windows that passages of smaller ids have."""
        phrases, n = self.build(), self.window
        get = self.numbers.get
        for (doc, words), marks in zip(docs, earlier):
            if len(words) < n:
                continue
            ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            reach = {}
            for last, found in phrases.iter(self.spell(ids)):
                end = last // LETTERS
                at = end + 1 - self.block
                around = marks[max(0, end + 1 - n) : min(at, len(words) - n) + 1]  # the windows with this block
                if found[0][0] >= doc or around.all():
                    continue
                for source, i, offset in found:
                    if source >= doc:
                        break  # passages come by their sources
                    if reach.get((i, at - offset), 0) > end:
                        continue  # in the stretch found before
                    begin, past = _stretch(ids, self.passages[i][1], at, at - offset, self.block)
                    reach[i, at - offset] = past
                    if past - begin >= n:
                        marks[begin : past - n + 1] = True
                        if around.all():
                            break


def _stretch(doc: np.ndarray, phrase: np.ndarray, at: int, shift: int, block: int) -> tuple[int, int]:
    """The longest common stretch around a common block, in places of the document; shift: where the passage would start."""
    low, high = max(0, shift), min(len(doc), shift + len(phrase))
    same = doc[low:high] == phrase[low - shift : high - shift]
    left, right = same[: at - low][::-1], same[at - low + block :]
    before = int(left.argmin()) if not left.all() else len(left)
    after = int(right.argmin()) if not right.all() else len(right)
    return at - before, at + block + after


def spread(windows: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words covered by the marked windows."""
    begins = np.flatnonzero(np.diff(np.concatenate([[False], windows, [False]]))).reshape(-1, 2)
    out = np.zeros(words, bool)
    for a, b in begins.tolist():
        out[a : b + n - 1] = True
    return out


def _strip_of(window: int, most: int, names: list[str], digest: bool):
    import hashlib

    def finish(part: pa.RecordBatch, texts: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
        kept = [b" ".join(compress(ws, (~x).tolist()) if x.any() else ws) for ws, x in zip(texts, gone)]
        own = {
            "n_words": pa.array([len(w) for w in texts], pa.int64()),
            "n_removed": pa.array([int(x.sum()) for x in gone], pa.int64()),
        }
        if digest:
            own["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        else:
            own["kept"] = pa.array([k.decode() for k in kept], pa.string())
        return pa.RecordBatch.from_arrays([own[c] if c in own else part.column(c) for c in names], names=names)

    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        path, low, past, _ = _head(table)
        told = table.select(["row", "again"]).drop_null().to_pylist()
        copies, again = ({r["row"] for r in told if r["again"] == x} for x in (False, True))
        shards = [Shard(window)]
        for doc, phrase in zip(table.column("doc"), table.column("phrase")):
            if phrase.is_valid:
                if shards[-1].words >= most:
                    shards.append(Shard(window))
                shards[-1].add(doc.as_py(), phrase.as_py().encode())
        parts, row = [], low
        docs, earlier = [], []
        for part in _read(path, low, past):
            parts.append(part)
            for doc, text in zip(_ids(part).tolist(), part.column("text").to_pylist()):
                words = (text or "").encode().split()
                docs.append((doc, words))
                earlier.append(np.zeros(0 if row in copies else max(0, len(words) - window + 1), bool))
                row += 1
        streamed = [(doc, words if len(marks) else []) for (doc, words), marks in zip(docs, earlier)]
        for shard in shards:
            if shard.passages:
                shard.cover(streamed, earlier)
        out, at = [], 0
        for part in parts:
            texts, gone = [words for _, words in docs[at : at + part.num_rows]], []
            for row, (words, marks) in enumerate(zip(texts, earlier[at : at + part.num_rows]), low + at):
                n = len(words)
                if len(marks):
                    if row in again:
                        h = hashes(words)
                        marks |= repeated(grams(h, window), h, window)
                    gone.append(spread(marks, window, n) if marks.any() else np.zeros(n, bool))
                else:  # a copy or short
                    gone.append(np.full(n, n >= window))
            at += part.num_rows
            out.append(finish(part, texts, gone))
        return pa.Table.from_batches(out)

    return run


def repeated(w: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Which windows occur earlier in the same document, by their hashes and then by their words'."""
    _, first, which = np.unique(w, return_index=True, return_inverse=True)
    mark = first[which] != np.arange(len(w))
    at = np.flatnonzero(mark)
    for k in range(n if len(at) else 0):
        mark[at] &= h[at + k] == h[first[which[at]] + k]
    return mark


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, digest: bool = False) -> DataFrame:
    """docs with further columns n_words, n_removed and kept, the text without its repeated passages (or kept_sha256)."""
    spark, last = docs.sparkSession, "kept_sha256" if digest else "kept"
    own = ["n_words", "n_removed", last]
    rows = docs.drop(*own, "__id", *(["text"] if text_col != "text" else [])).withColumn("__id", F.col(id_col).cast("long"))
    stored = materialise(rows.withColumnRenamed(text_col, "text"), "documents", **{"parquet.block.size": GROUP_BYTES, "compression": "zstd"})
    place = F.col("_metadata.row_index").cast("int")
    text_hash = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    base = stored.select("__id", F.col("_metadata.file_path").alias("file"), place.alias("row"), size, *text_hash)
    # a unit ends after so many rows or bytes, one text at least; the window has a file's rows, without texts
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unit = F.floor(F.col("row") / UNIT_ROWS) * (1 << 32) + F.floor(before / UNIT_BYTES)
    base = materialise(base.withColumn("unit", unit), "rows", compression="zstd")
    units = base.groupBy("file", "unit").agg(F.min("row").alias("low"), (F.max("row") + 1).alias("past"))
    units = materialise(units.withColumn("uid", F.monotonically_increasing_id()), "units")
    count = max(1, units.count())
    # what the tasks shuffle is small beside the files they read, so the number of tasks is told, not left to sizes
    tasks = max(min(count, spark.sparkContext.defaultParallelism), -(-count // TASK_UNITS))
    by_unit = lambda df: df.unionByName(units.drop("unit"), allowMissingColumns=True).repartition(tasks, "uid").groupBy("uid")

    # copies of whole texts: all but the least id
    ids = base.where("size > 0").select("file", "unit", "row", F.coalesce("__id", F.lit(_NO_ID)).alias("doc"), "h1", "h2")
    first = materialise(ids.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1"), "texts")
    copies = join_counted(ids, first, ["h1", "h2"], stored.count(), ["file", "row"]).where("doc > first").join(units, ["file", "unit"])
    copies = materialise(copies.select("uid", "row"), "copies")
    drop_table(first, base)

    found = by_unit(copies).applyInArrow(freed(_anchors_of(window)), "a long, uid long, row int")
    found = materialise(found, "anchors", tasks=tasks, compression="zstd")
    many = materialise(found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1 and a is not null"), "recurring", tasks=tasks, compression="zstd")
    again = join_counted(found, many, ["a"], found.count(), ["uid", "row", "a"])
    kind = "w long, uid long, row int, doc long"
    windows = materialise(by_unit(again).applyInArrow(freed(_windows_of(window)), kind), "windows", tasks=tasks, compression="zstd")
    least = materialise(windows.groupBy("w").agg(F.min("doc").alias("least"), F.count("*").alias("c")).where("c > 1"), "least", tasks=tasks, compression="zstd")
    known = materialise(join_counted(windows, least, ["w"], windows.count(), ["uid", "row", "w"]).select("w", "uid", "row", (F.col("doc") == F.col("least")).alias("own")), "known", tasks=tasks, compression="zstd")
    drop_table(windows, least, many)
    kind = "uid long, row int, at long, doc long, phrase string, ws array<long>"
    phrases = by_unit(known.where("own").drop("own")).applyInArrow(freed(_passages_of(window, PASSAGE)), kind)
    phrases = materialise(phrases.select(F.xxhash64("uid", "row", "at").alias("p"), "doc", "phrase", "ws"), "phrases", tasks=tasks, compression="zstd")
    held = phrases.select("p", F.explode("ws").alias("w"))
    wanted = known.where("not own").select("uid", "w").distinct().join(held, "w").select("uid", "p").distinct()
    wanted = wanted.join(phrases.select("p", "doc", "phrase"), "p").select("uid", "doc", "phrase")
    rows = copies.withColumn("again", F.lit(False)).unionByName(found.where("a is null").select("uid", "row", F.lit(True).alias("again")))
    told = materialise(wanted.unionByName(rows, allowMissingColumns=True), "told", tasks=tasks, compression="zstd")
    drop_table(found, known, phrases, copies)
    names = [c for c in stored.columns if c != "__id"] + own
    kinds = stored.drop("__id").select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias(last)).schema
    out = by_unit(told).applyInArrow(freed(_strip_of(window, SHARD_WORDS, names, digest)), kinds)
    return out.withColumnRenamed("text", text_col)
