"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks of giant documents.

The vocabulary file holds BPE pieces whose order is their merge priority.  A sequence of pieces is the BPE encoding of a
text exactly if each piece encodes to itself and each two neighbours encode to themselves as a pair: a first merge across
a border would be seen in the pair alone, since until then both sides went through the same merges.  So encoding is a
best-path problem in the max-plus semiring with weights 0 (neighbours allowed) and minus infinity, and its best path is
unique.  States are (piece, start) of the piece that reaches over a chunk's border.

Texts longer than `chunk` characters are split into chunks.  Each chunk gives the transfer matrix between the states at
its two borders.  Matrices are multiplied, `fan` neighbours at a time, up a tree until one product a document is left; down the
same tree, the states at the borders of each product give those inside it.  No task sees more than `fan` matrices of a document.
Each chunk is then traced back from its border states alone.  A word start (the mark that stands for a space) is a border no piece crosses, where the only state is "nothing
reaches over"; chunks that hold one have matrices of rank one, and inside them words are encoded and remembered singly.

Decoding joins pieces, and bytes of byte pieces, to the text.  The file's normalisation is the identity with a space
put in front, so that decoding gives each text exactly.

Defined cases: a null or empty text has no pieces; characters that no piece holds become byte pieces; repeated rows are
encoded each; an empty table gives no rows; further columns are kept, and those that the operator adds replace columns
of the same names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import freed, materialise, slices, splits

#: Characters of a chunk, and matrices that are multiplied at a time.
CHUNK, FAN = 1 << 15, 64
MARK = "▁"
#: Words remembered by each task.
MEMORY = 200_000


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Codec:
    """Encodes words with the library and longer strings by the lattice."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.sp.get_piece_size()
        normal = [i for i in range(size) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in normal}
        self.score = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {self.sp.id_to_piece(i): i for i in range(size) if self.sp.is_byte(i)}
        self.byte_of = {i: int(p[3:5], 16) for p, i in self.bytes.items()}
        self.piece_of = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word start inside")
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Reference BPE of a short string: merge the best neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best = max(((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(float("-inf"), 0))
            if best[0] == float("-inf"):
                return parts
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

    def allowed(self, a: str, b: str) -> bool:
        key = (a, b)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(a + b) == [a, b]
        return ok

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[f"<0x{b:02X}>"] for b in piece.encode()]

    def candidates(self, text: str, start: int) -> list[str]:
        """Pieces that may stand at a place: those of the vocabulary that encode to themselves, and the character."""
        out = [text[start]]
        for end in range(start + 2, min(len(text), start + self.longest) + 1):
            p = text[start:end]
            if p in self.ids and self.own(p):
                out.append(p)
        return out

    def own(self, piece: str) -> bool:
        key = (piece, "")
        if (ok := self.pairs.get(key)) is None:
            ok = self.pairs[key] = self.merge(piece) == [piece]
        return ok

    def plain(self, text: str) -> list[int]:
        """Ids of a text without marks of its own, by the library."""
        return self.sp.encode(text) if text else []

    def marked(self, ids: list[int], stand_in: str) -> list[int]:
        """ids with the byte pieces of a stand-in turned into those of the mark."""
        old, new = (self.ids_of_bytes(c) for c in (stand_in, MARK))
        out, n = list(ids), len(old)
        for i in range(len(out) - n + 1):
            if out[i : i + n] == old:
                out[i : i + n] = new
        return out

    def ids_of_bytes(self, text: str) -> list[int]:
        return [self.bytes[f"<0x{b:02X}>"] for b in text.encode()]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def stand_in(text: str) -> str:
    """A character that no piece holds, as long in UTF-8 as the mark, and that the text does not have."""
    return next(c for i in count(0xFDD0) if (c := chr(i)) not in text)


# A state is the last piece that starts before a border and how many of its characters lie before the border; None is
# the start of the text.  A matrix maps the state at a chunk's left border to those at its right one with weight 0;
# absent entries are minus infinity.
State = tuple[str, int] | None


def forward(codec: Codec, text: str, left: State, before: str, size: int) -> dict[State, list[State]]:
    """Chains of pieces through a chunk, from a left state: right state -> all pieces that start in the chunk.

    text: the chunk and what follows it, at least as long as a piece; size: of the chunk alone."""
    begin = 0 if left is None else len(left[0]) - left[1]
    if begin >= size:
        return {(left[0], left[1] + size): []} if left else {}
    ends: dict[int, dict[str | None, tuple]] = {begin: {left[0] if left else None: None}}
    out: dict[State, tuple] = {}
    for at in range(begin, size):
        last = ends.pop(at, None)
        if not last:
            continue
        for p in codec.candidates(text, at):
            for prev, path in last.items():
                if prev is None or codec.allowed(prev, p):
                    link = (p, path)
                    if at + len(p) >= size:
                        out[(p, size - at)] = link
                    else:
                        ends.setdefault(at + len(p), {})[p] = link
                    break
    return {s: _unlink(link) for s, link in out.items()}


def _unlink(link) -> list[str]:
    out = []
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def left_states(codec: Codec, before: str, text: str) -> list[State]:
    """All states that may stand at the border between two strings."""
    joined, n = before[-codec.longest :] + text[: codec.longest], min(len(before), codec.longest)
    out: list[State] = []
    for start in range(n):
        for p in codec.candidates(joined, start):
            if start + len(p) >= n:
                out.append((p, n - start))
    return out


_START = re.compile(f"(?<=[^{MARK}]){MARK}")


def borders(chunk: str, first: bool) -> tuple[int, int] | None:
    """The first and the last word start in a chunk: places that no piece reaches over."""
    found = _START.search(chunk)
    begin = 0 if first else found.start() if found else None
    if begin is None:
        return None
    end = len(chunk)
    while (end := chunk.rfind(MARK, begin + 1, end)) > 0 and chunk[end - 1] == MARK:
        pass
    return begin, max(begin, end)


def transfer(codec: Codec, before: str, chunk: str, after: str, first: bool) -> dict[State, frozenset]:
    text = chunk + after[: codec.longest]
    states = [None] if first else left_states(codec, before, text)
    at = borders(chunk, first)
    if at is None:
        return {s: frozenset(forward(codec, text, s, before, len(chunk))) for s in states}
    right = frozenset(forward(codec, text[at[1] :], None, "", len(chunk) - at[1]))  # rank one: all left states meet in it
    return {s: right for s in states if first or complete(codec, text, s, at[0]) is not None}


def complete(codec: Codec, text: str, left: State, size: int) -> list[str] | None:
    """The pieces from a left state to a word start, where the last one has to end."""
    if left is not None and len(left[0]) - left[1] == size:
        return []
    return next((p for s, p in forward(codec, text[:size], left, "", size).items() if s and s[1] == len(s[0])), None)


def trace(codec: Codec, chunk: str, after: str, left: State, right: State, first: bool) -> list[int]:
    """Ids of the pieces that start in a chunk, from the states at its borders alone."""
    text = chunk + after[: codec.longest]
    at = borders(chunk, first)
    if at is None:
        return [i for p in forward(codec, text, left, "", len(chunk))[right] for i in codec.ids_of(p)]
    head = [] if first else complete(codec, text, left, at[0])
    tail = forward(codec, text[at[1] :], None, "", len(chunk) - at[1])[right]
    middle = codec.plain(text[at[0] + 1 : at[1]].replace(MARK, " ")) if at[1] > at[0] + 1 else codec.ids_of(MARK) * (at[1] - at[0])
    return [i for p in head for i in codec.ids_of(p)] + middle + [i for p in tail for i in codec.ids_of(p)]


def compose(a: dict[State, frozenset], b: dict[State, frozenset]) -> dict[State, frozenset]:
    """Max-plus product of two transfer matrices with weights 0 and minus infinity."""
    return {s: frozenset().union(*(b.get(m, frozenset()) for m in mids)) for s, mids in a.items()}


def product(mats: list[dict[State, frozenset]]) -> dict[State, frozenset]:
    out = mats[0]
    for m in mats[1:]:
        out = compose(out, m)
    return out


def chosen_states(mats: list[dict[State, frozenset]], left: State = None, right: State = None) -> list[State]:
    """The state at each border of the path between two states: what is reached up to each border, then back from the right
    state, which at the end of a text (None) is any piece that ends with it."""
    reach, states = [], frozenset([left])
    for m in mats:
        reach.append(states)
        states = compose({None: states}, m)[None]
    chosen = [right or next(s for s in states if s and s[1] == len(s[0]))]
    for m, before in zip(reversed(mats), reversed(reach)):
        chosen.append(next(s for s in before if chosen[-1] in m.get(s, frozenset())))
    return chosen[::-1]


def chunks_of(text: str, chunk: int, margin: int) -> list[tuple[str, str, str]]:
    """(before, chunk, after) of each chunk."""
    return [(text[max(0, i - margin) : i], text[i : i + chunk], text[i + chunk : i + chunk + margin]) for i in range(0, len(text), chunk)]


def lattice_encode(codec: Codec, text: str, chunk: int) -> list[int]:
    """Ids of a string of marks and characters by the chunked scan, in one process."""
    parts = chunks_of(text, chunk, codec.longest)
    states = chosen_states([transfer(codec, b, c, a, i == 0) for i, (b, c, a) in enumerate(parts)])
    return [x for i, (_, c, a) in enumerate(parts) for x in trace(codec, c, a, states[i], states[i + 1], i == 0)]


def _state(x) -> State:
    return tuple(x) if x else None


def _read(matrix: str) -> dict[State, frozenset]:
    return {_state(s): frozenset(map(_state, to)) for s, to in json.loads(matrix)}


def _matrix(m: dict[State, frozenset]) -> str:
    return json.dumps([[s, sorted(to)] for s, to in m.items()])


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", chunk: int = CHUNK, fan: int = FAN, decoded: bool = False) -> DataFrame:
    """docs with further columns pieces (array of ids) and n_chunks.  The model's bytes go to the tasks by broadcast (a
    vocabulary file's size is its bound).

    decoded: with the column of decode() too; the pieces of short texts are decoded by the Python worker that encoded them,
    so that a task needs one worker, not two."""
    spark = docs.sparkSession
    with open(model or default_model(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    docs = docs.drop("pieces", "n_chunks", "__key", "__ids", *["decoded"] * decoded)
    schema = docs.select("*", F.array().cast("array<int>").alias("pieces"), F.lit(1).cast("long").alias("n_chunks"), *[F.lit("").alias("decoded")] * decoded).schema
    long = F.coalesce(F.char_length(text_col), F.lit(0)) > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids = codec.sp.encode([t if MARK not in t else t.replace(MARK, stand_in(t)) for t in texts], num_threads=1)
                ids = [x if MARK not in t else codec.marked(x, stand_in(t)) for t, x in zip(texts, ids)]
                own = {"pieces": pa.array(ids, pa.list_(pa.int32())), "n_chunks": pa.array([1] * len(ids), pa.int64())}
                if decoded:
                    own["decoded"] = pa.array([codec.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *own.values()], names=[*part.schema.names, *own])

    short = docs.where(~long).mapInArrow(freed(whole), schema)
    giants = materialise(docs.where(long).withColumn("__key", F.monotonically_increasing_id()), "giants", compression="zstd")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = Codec(sent.value).longest
        for batch in batches:
            for key, text in zip(batch.column("__key").to_pylist(), batch.column("text").to_pylist()):
                own = stand_in(text)
                rows = chunks_of(MARK + text.replace(MARK, own).replace(" ", MARK), chunk, longest)
                for at in range(0, len(rows), 16):
                    some = rows[at : at + 16]
                    yield pa.RecordBatch.from_pydict({"__key": [key] * len(some), "i": list(range(at, at + len(some))), "before": [x[0] for x in some], "chunk": [x[1] for x in some], "after": [x[2] for x in some], "own": [own] * len(some)})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in split(batches):
            rows = batch.to_pylist()
            found = [_matrix(transfer(codec, r["before"], r["chunk"], r["after"], r["i"] == 0)) for r in rows]
            yield pa.RecordBatch.from_pydict({"__key": [r["__key"] for r in rows], "i": [r["i"] for r in rows], "matrix": found})

    def multiply(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        return pa.table({"__key": [rows[0]["__key"]], "i": [rows[0]["i"] // fan], "matrix": [_matrix(product([_read(r["matrix"]) for r in rows]))]})

    def inside(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        ends = [_state(json.loads(rows[0][c])) for c in ("left", "right")]
        states = [json.dumps(s) for s in chosen_states([_read(r["matrix"]) for r in rows], *ends)]
        return pa.table({"__key": [r["__key"] for r in rows], "i": [r["i"] for r in rows], "left": states[:-1], "right": states[1:]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            rows, ids = batch.to_pylist(), []
            for r in rows:
                x = trace(codec, r["chunk"], r["after"], _state(json.loads(r["left"])), _state(json.loads(r["right"])), r["i"] == 0)
                ids.append(codec.marked(x, r["own"]) if r["own"] in r["chunk"] else x)
            yield pa.RecordBatch.from_arrays([pa.array([r["__key"] for r in rows], pa.int64()), pa.array([r["i"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["__key", "i", "ids"])

    texts = giants.select("__key", F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(freed(split), "__key long, i long, before string, chunk string, after string, own string")
    up = [materialise(texts.mapInArrow(freed(matrices), "__key long, i long, matrix string"), "matrices")]
    longest = giants.agg(F.max(F.char_length(text_col)).alias("n")).first()["n"] or 0
    over = F.floor(F.col("i") / fan).cast("long")
    while (longest + 1) / chunk / fan ** (len(up) - 1) > 1:  # until one product a document is left
        up.append(materialise(up[-1].groupBy("__key", over).applyInArrow(multiply, "__key long, i long, matrix string"), "matrices"))
    states = up[-1].select("__key", "i", F.lit("null").alias("left"), F.lit("null").alias("right"))
    for mats in reversed(up[:-1]):
        ends = states.withColumnRenamed("i", "over")
        states = mats.withColumn("over", over).join(ends, ["__key", "over"]).groupBy("__key", "over").applyInArrow(inside, "__key long, i long, left string, right string")
    if len(up) == 1:  # single chunks
        states = up[0].withColumn("over", F.col("i")).join(states.drop("i"), "__key").groupBy("__key").applyInArrow(inside, "__key long, i long, left string, right string")
    ids = pieces.drop("before").join(states, ["__key", "i"]).mapInArrow(freed(traced), "__key long, i long, ids array<int>")
    ids = ids.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("__ids"))
    pieces_of = F.flatten(F.transform("__ids", lambda x: x["ids"])).alias("pieces")
    done = giants.join(ids, "__key").select(*docs.columns, pieces_of, F.size("__ids").cast("long").alias("n_chunks"))
    done = done.coalesce(splits(giants))
    return short.unionByName(decode(done, model) if decoded else done)


def _lists(column: pa.ListArray) -> list[list[int]]:
    """Lists of a column, null ones as empty; by way of one flat array, since single values of Arrow are slow to reach."""
    if column.null_count or column.values.null_count:
        return [x or [] for x in column.to_pylist()]
    ends, flat = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def decode(rows: DataFrame, model: str | None = None, pieces_col: str = "pieces") -> DataFrame:
    """rows with a further column decoded, the text of the pieces."""
    with open(model or default_model(), "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [codec.decode(x) for x in _lists(part.column(pieces_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(freed(run), rows.select("*", F.lit("").alias("decoded")).schema)
