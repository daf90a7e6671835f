"""Spelling variants: words one edit apart, and the common form that each rare one stands for.

A word's mask has the parity of its letters' counts, in three bands of bits.  One inserted or deleted letter flips one bit, a replaced one two
at most, so near words agree in a band.  Words meet in buckets of (band, its value, length), in which a word counts once by its own length and
once by its length less one, as a longer one.  All words of a small bucket are compared.  A larger bucket is split further, without
losing a pair: near words also have a string in common that is left after deleting one letter (of the longer word alone, if one is
longer).  Words of such a bucket meet by the hash of that string, and only in the bands that the deleted letter
is not in: of the three bands, two near words' letters lie in two at most, so one band is left where both are met.  At most some
hundred words have such a string in common, whatever the corpus.  Candidates are verified by edit distance.  Words of one length thus meet in
the bucket of their length less one, and others in the bucket of the shorter one's length.

A word's form is the near word with the most occurrences, if it has ten times as many; forms are followed to the last by pointer
doubling, which ends after a few rounds, since occurrences grow tenfold with each step.

Defined cases: a null or empty text has no words; a null doc_id is the empty string in the hash; rows with one doc_id count
each; words of any length are handled in time that grows with their length; ties go to the word that is first in code-point order;
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BASE, freed, lower_ascii, materialise, mix

LEAST = 7
#: Words of a bucket up to which all are compared.
SMALL = 48
#: Letters from the most to the least frequent, dealt to the bands in turn; accented letters share a further bit of each.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
_WIDTH = 10
#: Lengths from here on share counts of buckets (not buckets), so that there are at most 3 * 2**10 * 64 counts.
_LONG = 63


def occurrences(docs: DataFrame, least: int = LEAST, one_in: int = 31, text_col: str = "text") -> DataFrame:
    """word and n: maximal runs of letters, lower-cased, some with a letter deleted by a hash of the document and the run."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), 0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    edited = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, edited).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point up to U+00FF: its band, and its bit inside the band."""
    band, bit = np.zeros(256, np.int64), np.full(256, _WIDTH - 1, np.int64)
    for i, c in enumerate(_LETTERS):
        band[ord(c)], bit[ord(c)] = i % 3, i // 3
    band[0xC0:] = np.arange(0x40) % 3
    return band, bit


_BAND, _BIT = _tables()


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their code points as a matrix) for the words of each length; a matrix has about a million cells at most."""
    codes = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words.to_pylist()]
    lengths = np.array([len(c) for c in codes], np.int64)
    for n in np.unique(lengths):
        rows = (lengths == n).nonzero()[0]
        step = max(1, (1 << 20) // int(n))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield some, np.stack([codes[r] for r in some]).astype(np.int64)


def masks(codes: np.ndarray) -> np.ndarray:
    """Three parities of 10 bits each for the words of a matrix."""
    out = np.zeros((3, len(codes)), np.int64)
    band, bit = _BAND[codes], np.left_shift(1, _BIT[codes])
    for j in range(3):
        out[j] = np.bitwise_xor.reduce(np.where(band == j, bit, 0), axis=1)
    return out


def shortened(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a matrix, and of what each deletion of one letter leaves."""
    n = codes.shape[1]
    powers = np.array([pow(BASE, k, 1 << 64) for k in range(n + 1)], np.uint64) if n < 4096 else np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
    terms = mix(codes.astype(np.uint64) + np.uint64(1)) * powers[n - 1 :: -1]
    total = np.cumsum(terms, axis=1)  # sums wrap, as they should
    whole = total[:, -1]
    left = total - terms  # what stands before a letter, with its weight one power too high
    after = whole[:, None] - total
    return mix(whole), mix(left * np.uint64(pow(BASE, -1, 1 << 64)) + after)


def _cell(j: int, values: np.ndarray, length: int) -> np.ndarray:
    """The number of a bucket's count."""
    return (j << (_WIDTH + 6)) + (values << 6) + min(length, _LONG)


def near_pairs(words: DataFrame, small: int = SMALL) -> DataFrame:
    """word, n, near, near_n: all pairs of different words one edit apart, in both directions.  words: word, n (each word once)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, codes in by_length(batch.column("word")):
                for j, values in enumerate(masks(codes)):
                    found += [_cell(j, values, codes.shape[1]), _cell(j, values, codes.shape[1] - 1)]
            cell, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n, pa.int64())], names=["cell", "n"])

    counts = words.select("word").mapInArrow(freed(cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    large = np.zeros(3 << (_WIDTH + 6), bool)
    large[[r["cell"] for r in counts.where(F.col("n") > small).select("cell").collect()]] = True  # at most 3 * 2**16 numbers
    sent = words.sparkSession.sparkContext.broadcast(large)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each string by which a word is met.  longer: one letter is deleted there, if the bucket is split."""
        large = sent.value
        for batch in batches:
            for rows, codes in by_length(batch.column("word")):
                n, bands = codes.shape[1], masks(codes)
                whole, left = shortened(codes)
                away = _BAND[codes]
                for j in range(3):
                    for longer in (False, True):
                        own = n - longer
                        bucket = mix(((bands[j].astype(np.uint64) << np.uint64(40)) + np.uint64(own << 2) + np.uint64(j)) * np.uint64(BASE))
                        split = large[_cell(j, bands[j], own)]
                        at, some = (~split).nonzero()[0], split.nonzero()[0]
                        key = bucket[at]
                        if longer:
                            some, i = (split[:, None] & (away != j)).nonzero()
                            at, key = _once(np.concatenate([at, some]), np.concatenate([key, mix(bucket[some] ^ left[some, i])]))
                        else:
                            at, key = np.concatenate([at, some]), np.concatenate([key, mix(bucket[some] ^ whole[some])])
                        take = pa.array(rows[at])
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("word").take(take), batch.column("n").take(take), pa.array(np.full(len(at), longer))], names=["key", "word", "n", "longer"])

    rows = words.select("word", "n").mapInArrow(freed(keys), "key long, word string, n long, longer boolean")
    # equal keys stand together: pairs are made of runs, without a list for each of the keys, most of which have one row
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(freed(_meetings), "a string, a_n long, b string, b_n long")
    pairs = pairs.where(F.levenshtein("a", "b", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")
    return pairs.select(both).select("p.*").repartition("word").dropDuplicates(["word", "near"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows with one key, of which one is a longer word; rows come in the order of keys."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # its run may go on
        yield from _pairs(table.slice(0, last))
        held = table.slice(last)
    if held is not None:
        yield from _pairs(held)


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    key, longer = table.column("key").to_numpy(), table.column("longer").to_numpy()
    at, step = np.arange(len(key)), 0
    while len(at):  # as often as the longest run is long
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        found = at[longer[at] | longer[at + step]]
        for i in range(0, len(found), 1 << 16):
            some = found[i : i + (1 << 16)]
            a, b = table.take(pa.array(some)), table.take(pa.array(some + step))
            columns = [a.column("word"), a.column("n"), b.column("word"), b.column("n")]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names=["a", "a_n", "b", "b_n"])


def _once(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, key) once: a word with a doubled letter leaves one string in two ways."""
    order = np.lexsort((key, at))
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
    return at[new], key[new]


def variants(docs: DataFrame, least: int = LEAST, twice: int = 2, ratio: int = 10, small: int = SMALL) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words with at least `least` letters and `twice` occurrences."""
    words = materialise(occurrences(docs, least).where(F.col("n") >= twice), "words", compression="zstd")
    near = near_pairs(words, small).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    taken = F.col("form_n") >= ratio * F.col("n")
    found = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    found = materialise(found, "forms", compression="zstd")
    roots = last(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last(forms: DataFrame) -> DataFrame:
    """word and root: the end of each chain.  Each round doubles the steps that a pointer spans."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        now = materialise(now.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")
