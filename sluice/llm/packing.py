"""Packing tokenized documents into as few sequences of at most `size` tokens as can be, by linear grouping.

Documents are tokenized once and end with an end id.  Only those longer than a sequence are cut, into pieces of `size` tokens of which the
first may be shorter.  How many pieces there are of each length, at most `size` numbers, is all that the driver gets.  From these it plans:

1. Lengths over a third of the size are dealt, the longest first, into groups of equal cardinality; each counts as its group's longest.
2. With so few sizes, the best use of configurations (multisets that fit into a sequence) is a linear programme, solved by
   column generation: a knapsack over the sequence prices the next configuration.  Whole uses are kept.
3. Actual pieces take the places of a configuration: the longest left that the rounded size allows, and in the last place
   the longest left that fits, which takes up what rounding gave away.  A run is a number of like sequences; there is a
   new one only where a length runs out.
4. Everything else, small pieces and what the rounding left, goes by best fit, the longest first, into the run with the least room
   for it.  All pieces of one length go in one step: a sequence of room r takes r // length of them before the next is
   touched, as best fit one by one would do.

The plan has some thousand runs at any number of documents.  A piece finds its place by its number among those of its length.  That
number comes in two levels (length and block of rows), since one length may have a third of all rows.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; rows with null or equal ids keep apart, since
nothing is looked up by id; control strings inside a text are ordinary text; giant texts are tokenized in parts, between a letter and a space, where
the tokenizer's own pattern always parts; an empty table gives no rows; further columns of the documents are dropped.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.functions.sequence import positions
from sluice.llm.common import freed, materialise, slices

SIZE, END = 1024, 2
#: Groups of the large lengths, and the share of a sequence above which a length is large.
GROUPS, LARGE = 64, 1 / 3
#: Fixed value: the public pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a part of a giant text.
PART = 1 << 19
#: Rows of a block in which pieces of one length are numbered.
BLOCK = 1 << 33


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def parts_of(text: str, part: int = PART) -> list[str]:
    """The text cut between a letter and a space that a letter follows, at the first such place after each `part` characters."""
    border, out, start = regex.compile(r"(?<=\p{L}) (?=\p{L})"), [], 0
    while len(text) - start > part and (found := border.search(text, start + part)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def coder(file: bytes, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text by a tokenizer's file, control strings as ordinary text.

    In a byte-level vocabulary whose merges stand in the order of their ids, the best merge is the one with the least id.  Such a file's
    entries are then ranks for the faster of the two libraries, which gives the same ids.  Other files go to their own library."""
    model = json.loads(file)["model"]
    vocabulary = model.get("vocab", {})
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    merged = [vocabulary.get("".join(m), -1) for m in merges]
    if model["type"] == "BPE" and merged and merged == sorted(set(merged)) and set(byte_of) <= set(vocabulary) and merged[0] > max(vocabulary[c] for c in byte_of):
        parts = {vocabulary[c] for c in byte_of} | set(merged)
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocabulary.items() if i in parts}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    codec = Tokenizer.from_str(file.decode())
    codec.encode_special_tokens = True
    return lambda text: codec.encode(text, add_special_tokens=False).ids


def cut(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers).

    pattern: that by which the tokenizer's file parts a text into words before merging."""
    with open(tokenizer or default_tokenizer(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = coder(sent.value, pattern), np.array([end], "<u4")

        for batch in batches:
            for some in slices(batch, "text"):
                out: dict[str, list] = defaultdict(list)
                for key, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    ids = np.concatenate([*(np.array(encode(p), "<u4") for p in parts_of(text or "")), last])
                    first = len(ids) % size or size
                    starts = [0, *range(first, len(ids), size)]
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        for c, v in (("doc_id", key), ("piece", i), ("start", a), ("length", b - a), ("ids", ids[a:b].tobytes())):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, piece int, start long, length long, ids binary")


def knapsack(weights: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset within the size, and how often it has each item."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(weights, kind="stable")
    w, v = weights[order], values[order]
    ends = np.searchsorted(w, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if n := ends[c]:
            tried = best[c - w[:n]] + v[:n]
            i = int(tried.argmax())
            if tried[i] > best[c] + 1e-12:
                best[c], pick[c] = tried[i], i
    counts, c = np.zeros(len(w), np.int64), size
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= w[pick[c]]
    return float(best[size]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int, gap: float = 2e-4) -> list[tuple[np.ndarray, int]]:
    """(configuration, whole uses) of a linear programme's solution that is within `gap` of the best.

    Revised simplex; the columns come from the knapsack.  The bound is the value of the duals over the best column's."""
    k = len(sizes)
    fit = size // sizes
    columns = np.diag(fit).astype(float)
    inverse, use = np.diag(1.0 / fit), demand / fit
    for _ in range(40 * k):
        dual = inverse.sum(0)
        value, found = knapsack(sizes, dual, size)
        if value <= 1 + gap:
            break
        way = inverse @ found
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use = np.maximum(use - step * way, 0)
        use[out] = step
        inverse[out] /= way[out]
        for i in (np.abs(way) > 1e-12).nonzero()[0]:
            if i != out:
                inverse[i] -= way[i] * inverse[out]
        columns[:, out] = found
    return [(columns[:, i].astype(np.int64), int(use[i] + 1e-6)) for i in range(k) if use[i] + 1e-6 >= 1]


class Plan:
    """Runs of like sequences, and where the pieces of each length go in them."""

    def __init__(self, size: int):
        self.size, self.sequences = size, 0
        self.taken: dict[int, int] = defaultdict(int)
        #: length: (first number, first sequence, pieces in a sequence, offset of the first) in order of numbers
        self.places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, sequences)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, pieces: int, first: int, each: int, room: int) -> None:
        """The next pieces of a length into sequences from `first` on, `each` to a sequence."""
        if pieces:
            self.places[length].append((self.taken[length], first, each, self.size - room))
            self.taken[length] += pieces

    def fill(self, length: int, pieces: int, first: int, sequences: int, room: int) -> int:
        """As many pieces as fit into a run; its parts are kept by the room that is left.  Gives the pieces that are left."""
        each = room // length
        whole, rest = min(sequences, pieces // each), pieces % each if pieces < sequences * each else 0
        self.put(length, whole * each, first, each, room)
        for n, inside in ((whole, each), (1 if rest else 0, rest), (sequences - whole - (1 if rest else 0), 0)):
            if n:
                if inside == rest and rest:
                    self.put(length, rest, first, each, room)
                if left := room - inside * length:
                    self.room[left].append((first, n))
                first += n
        return pieces - whole * each - rest


def plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS, large: float = LARGE) -> Plan:
    """Places for so many pieces of each length."""
    out, left = Plan(size), {n: int(c) for n, c in counts.items() if c}
    if c := left.pop(size, 0):
        out.put(size, c, out.open(c), 1, size)
    lengths = sorted((n for n in left if n > size * large), reverse=True)
    per = -(-sum(left[n] for n in lengths) // groups)
    demand: dict[int, float] = defaultdict(float)  # pieces by their group's longest; groups with the same one are one size
    longest, have = 0, 0
    for n in lengths:
        rest = left[n]
        while rest:
            longest = longest if have else n
            some = min(rest, per - have)
            demand[longest] += some
            rest, have = rest - some, (have + some) % per
    stock = np.zeros(size + 1, np.int64)
    for n, c in left.items():
        stock[n] = c
    sizes = np.array(list(demand), np.int64)
    for config, uses in configurations(sizes, np.array(list(demand.values())), size) if demand else []:
        places = np.repeat(sizes, config)  # in descending order
        while uses:
            used: dict[int, int] = defaultdict(int)
            room = size
            for i, most in enumerate(places):
                for n in used:
                    stock[n] -= used[n]
                fits = stock[: (room if i == len(places) - 1 else most) + 1].nonzero()[0]
                for n in used:
                    stock[n] += used[n]
                if not len(fits):
                    break
                used[int(fits[-1])] += 1
                room -= int(fits[-1])
            else:
                same = min(uses, *(int(stock[n]) // c for n, c in used.items()))
                first, at = out.open(same), size
                for n, c in used.items():
                    out.put(n, same * c, first, c, at)
                    at -= n * c
                    stock[n] -= same * c
                if room:
                    out.room[room].append((first, same))
                uses -= same
                continue
            break
    left = {int(n): int(stock[n]) for n in stock.nonzero()[0]}
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in range(length, size + 1):
            while n and out.room.get(room):
                first, sequences = out.room[room].pop()
                n = out.fill(length, n, first, sequences, room)
        if n:
            opened = -(-n // (size // length))
            out.fill(length, n, out.open(opened), opened, size)
    return out


def pack(pieces: DataFrame, size: int = SIZE, groups: int = GROUPS) -> DataFrame:
    """pieces (any columns, length among them) with sequence_id and offset."""
    stored = materialise(pieces.withColumn("__at", F.monotonically_increasing_id()), "pieces", compression="zstd")
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}  # at most `size` lengths
    made = plan(counts, size, groups)
    places = pieces.sparkSession.sparkContext.broadcast(dict(made.places))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: (np.array([p[0] for p in x]), np.array(x)) for n, x in places.value.items()}
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                here = length == n
                starts, rows = found[int(n)]
                at = rows[np.searchsorted(starts, number[here], "right") - 1]
                inside = number[here] - at[:, 0]
                sequence[here] = at[:, 1] + inside // at[:, 2]
                offset[here] = at[:, 3] + inside % at[:, 2] * n
            kept = [c for c in batch.schema.names if not c.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    numbered = positions(stored, "length", seq="__at", out="__number", width=BLOCK)
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return numbered.drop("__at").mapInArrow(freed(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, its pieces one after another; no group has more than a sequence's tokens."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("__p"))
    ids = F.aggregate(F.transform("__p", lambda p: p["ids"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", F.aggregate("__p", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"), ids.alias("ids"))
