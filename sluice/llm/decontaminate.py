"""Benchmark decontamination by SimHash windows, a multi-index Hamming search and exact weighted shingles.

For each benchmark item, windows as long as the item slide over the documents.  Windows and items have 64-bit SimHashes of
their word shingles, weighted by their counts.  A fingerprint is cut into BLOCKS blocks of 8 bits.  For each length of
items and each block there is a table from the block's value to the items whose block is within RADIUS // BLOCKS bits of it,
filled by enumerating these bit errors.  A window's candidates are what its blocks find in the tables: by pigeonhole every
item within RADIUS is among them.  Candidates within RADIUS are verified by the exact weighted Jaccard similarity of their
shingles, sum of least counts over sum of largest counts.

At a similarity of 0.8, about one bit in 6.6 differs, so that the radius misses about one window in 100,000; of an occurrence
many windows are tried.  At lower similarities it misses more: raise RADIUS with a lower `similarity`.

A window with a similarity of s to an item of k shingles holds at least s k shingles of items.  Only windows that do are
fingerprinted; this loses nothing.  Of overlapping verified windows of a document and an item, the best and then first one is
reported.

The items are split into parts of at most ITEMS distinct rows; each part is broadcast (so many rows of at most ITEM_WORDS
words are its bound, longer items are cut into windows of that length, each an item of its own), and the documents stream
past each.  Usual benchmarks make one part.

Defined cases: null and empty texts of documents and items match nothing; items shorter than a shingle are one shingle;
very long texts are searched whole; equal items with different ids are all reported, repeated rows of an item once; rows with
the same id are searched each, rows without an id too; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import freed, grams, hashes, mix, slices

BITS, BLOCKS, RADIUS = 64, 8, 23
ITEMS, ITEM_WORDS = 20_000, 2_000
SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Shingle hashes, with repetitions; the whole sequence where it is shorter."""
    if len(h) >= n:
        return grams(h, n)
    return mix(grams(h, len(h)) + np.uint64(len(h))) if len(h) else h


def _bits(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return (np.unpackbits(mix(s).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) << 1) - 1


def simhash(s: np.ndarray) -> np.ndarray:
    return np.packbits(_bits(s).sum(0) > 0)


class Length:
    """The items of one length and their block tables."""

    def __init__(self, length: int, size: int, items: list[tuple[int, Counter, np.ndarray]]):
        self.length, self.size = length, size
        self.ids, self.counts = [x[0] for x in items], [x[1] for x in items]
        self.prints = np.array([x[2] for x in items], np.uint8)
        errors = np.array([e for e in range(256) if e.bit_count() <= RADIUS // BLOCKS], np.uint8)
        self.tables = np.zeros((BLOCKS, 256, len(items)), bool)
        for b in range(BLOCKS):
            self.tables[b, self.prints[:, b][:, None] ^ errors[None, :], np.arange(len(items))[:, None]] = True

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within RADIUS, found by the tables."""
        step = max(1, (1 << 20) // len(self.ids))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            listed = self.tables[0][some[:, 0]]
            for b in range(1, BLOCKS):
                listed = listed | self.tables[b][some[:, b]]
            w, i = np.nonzero(listed)
            apart = POPCOUNT8[some[w] ^ self.prints[i]].sum(1)
            near = apart <= RADIUS
            yield from zip((w[near] + at).tolist(), i[near].tolist(), apart[near].tolist())


class Index:
    """Searches documents for the windows that are like an item."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, least: float):
        self.n, self.least, groups, known = n, least, {}, {}
        for item, text in items:
            words = words_of(text)
            for at in range(0, max(1, len(words)), ITEM_WORDS):
                h = hashes(words[at : at + ITEM_WORDS] if at + ITEM_WORDS <= len(words) or not at else words[-ITEM_WORDS:])
                if len(h):
                    s = shingles(h, n)
                    groups.setdefault(len(h), []).append((item, Counter(s.tolist()), simhash(s)))
                    known.setdefault(min(len(h), n), []).append(s)
        self.lengths = [Length(k, max(1, k - n + 1), x) for k, x in sorted(groups.items())]
        #: By words of a shingle: the items' shingles, and a bit map of their upper bits.
        self.known = {k: (np.unique(np.concatenate(x)), np.zeros(1 << 20, bool)) for k, x in known.items()}
        for s, bits in self.known.values():
            bits[(s >> np.uint64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray, words: int) -> np.ndarray:
        """Where the shingles of so many words that items have start."""
        g = grams(h, words) if words == self.n else mix(grams(h, words) + np.uint64(words))
        known, bits = self.known[words]
        at = np.flatnonzero(bits[(g >> np.uint64(44)).astype(np.int64)])
        return at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, words, distance, similarity) of texts."""
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in split])
        h = hashes([w for words in split for w in words])
        for words in self.known:
            at = self.places(h, words)
            rows = np.searchsorted(ends, at, side="right")
            inside = at + words <= ends[rows] if len(at) else np.zeros(0, bool)
            at, rows = at[inside], rows[inside]
            for row in np.unique(rows).tolist():
                begin, end = int(ends[row]) - len(split[row]), int(ends[row])
                yield from ((row, *x) for x in self.document(h[begin:end], at[rows == row] - begin, words))

    def document(self, h: np.ndarray, at: np.ndarray, words: int) -> Iterator[tuple[int, int, int, int, float]]:
        """Matches of a document with items whose shingles have so many words, from the places of known shingles."""
        for group in self.lengths:
            need = max(1, int(np.ceil(self.least * group.size - 1e-9)))
            if min(group.length, self.n) != words or group.length > len(h) or len(at) < need:
                continue
            low, high = at[: len(at) - need + 1], at[need - 1 :]
            full = high - low < group.size  # so many known shingles fit into a window
            begin = np.maximum(high[full] - group.size + 1, 0)
            last = np.minimum(low[full], len(h) - group.length)
            found: dict[int, list[tuple[float, int, int]]] = {}
            for first, past in _stretches(begin, last):
                part = h[first : past + group.length]
                s = grams(part, self.n) if words == self.n else mix(grams(part, words) + np.uint64(words))
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(s), axis=0, dtype=np.int32)])
                prints = np.packbits(sums[group.size :] - sums[: -group.size] > 0, axis=1)
                for w, i, apart in group.within(prints):
                    theirs = Counter(s[w : w + group.size].tolist())
                    both = sum((theirs & group.counts[i]).values())
                    like = both / (2 * group.size - both)
                    if like >= self.least:
                        found.setdefault(i, []).append((like, -(first + w), apart))
            for i, windows in found.items():
                while windows:
                    best = max(windows)
                    yield group.ids[i], -best[1], group.length, best[2], best[0]
                    windows = [x for x in windows if abs(x[1] - best[1]) >= group.length]


def _stretches(begin: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
    """Unions of ranges of starts, in order, both ends included."""
    for a, b in _merged(begin.tolist(), last.tolist()):
        for at in range(a, b + 1, 1 << 16):  # a bounded number of windows at a time
            yield at, min(b, at + (1 << 16) - 1)


def _merged(begin: list[int], last: list[int]) -> Iterator[tuple[int, int]]:
    now: list[int] = []
    for a, b in zip(begin, last):
        if a > b:
            continue
        if now and a <= now[1] + 1:
            now[1] = max(now[1], b)
        else:
            if now:
                yield now[0], now[1]
            now = [a, b]
    if now:
        yield now[0], now[1]


POPCOUNT8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def search(docs: DataFrame, items: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance and similarity of the contaminated windows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    parts = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-items.count() // (ITEMS // 2))))))
    out = None
    for p in sorted(r["part"] for r in parts.select("part").distinct().collect()) or [None]:
        held = [] if p is None else [(r["item_id"], r["text"]) for r in parts.where(F.col("part") == p).collect()]
        if len(held) > ITEMS:
            raise ValueError("a part of the benchmark is larger than its bound")
        sent = spark.sparkContext.broadcast(held)
        found = rows.mapInArrow(freed(_run(sent, words, similarity)), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _run(sent, words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        index = Index(sent.value, words, similarity)
        for batch in batches:
            out = []
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                out += [(ids[row], *x) for row, *x in index.search(part.column("text").to_pylist())]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

    return run
