"""License scans: fuzzy search for short notices.

A notice of n characters with at most k edits, cut into k + 1 pieces, has at least one piece unharmed (pigeonhole), so
every occurrence contains an exact piece.  One Aho-Corasick automaton finds the pieces of all notices in the normalised
text; around each find, the regex library verifies the notice with its bounded-error matching and gives its span.

Normalised text: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` joined by one space, so that spans are in
words.  Base phrases are matched exactly, as consecutive words.

Defined cases: a null text is empty, has no words and no labels; repeated rows are scanned each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluice.llm.common import slices

#: The base phrases and their labels.
BASE = {
    b"gnu general public license": "gpl",
    b"apache license": "apache",
    b"cc by": "cc-by",
    b"mit license": "mit",
}
#: Notices searched with errors, their labels and the most edits.  Own labels carry no base label's name.
NOTICES = [
    ("this work is licensed under the gnu general public license", "gpl-notice", 4),
    ("licensed under the apache license version", "apache-notice", 3),
    ("released under the mit license", "mit-notice", 2),
    ("licensed under cc by", "cc-by-notice", 1),
    ("permission is hereby granted free of charge to any person", "mit-text", 4),
    ("redistribution and use in source and binary forms", "bsd-text", 4),
    ("mozilla public license", "mpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("creative commons attribution", "cc-text", 2),
    ("all rights reserved", "reserved", 1),
]
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str | None) -> tuple[bytes, int]:
    words = (text or "").encode().translate(_TABLE).split()
    return b" ".join(words), len(words)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length and their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        for i, (notice, _, edits) in enumerate(notices):
            for at, piece in pieces(notice, edits):
                found = self.seeds.get(piece, [])
                self.seeds.add_word(piece, [*found, (i, at, len(piece))])
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?:{regex.escape(n)}){{e<={k}}}", regex.BESTMATCH) for n, _, k in notices]

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of the verified places in a normalised text, the best of overlapping ones.

        Each seed's window, a notice and its edits long, is searched by itself.  The best places win, the first of equal ones; a window
        whose place overlaps a better one is searched again in what that leaves of it.  No place can leave a window more
        than a few times, so the work grows with the number of seeds.
        """
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, hits in self.seeds.iter(text):
            for i, at, size in hits:
                notice, _, edits = self.notices[i]
                start = end + 1 - size - at - edits
                windows.setdefault(i, set()).add((max(0, start), min(start + len(notice) + 2 * edits, len(text))))
        return sorted((a, b, i, e) for i, spans in windows.items() for a, b, e in self._best(text, i, spans))

    def _best(self, text: str, i: int, spans: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the places of one notice in its windows."""
        heap: list[tuple[int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            if m := self.patterns[i].search(text, a, b):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in spans:
            search(a, b)
        starts: list[int] = []  # of the chosen places, in order
        chosen: dict[int, tuple[int, int]] = {}
        while heap:
            edits, start, end, a, b = heapq.heappop(heap)
            near = starts[max(0, bisect_right(starts, a) - 1) : bisect_left(starts, b)]
            taken = [(x, chosen[x][0]) for x in near if chosen[x][0] > a]
            if not any(x < end and start < y for x, y in taken):
                insort(starts, start)
                chosen[start] = (max(end, start + 1), edits)
                continue
            for x, y in [*taken, (b, b)]:
                if x > a:
                    search(a, x)
                a = max(a, y)
        return [(x, y, e) for x, (y, e) in chosen.items()]


def base_places(norm: bytes) -> list[tuple[int, str]]:
    """(word number, label) of all places of the base phrases."""
    if not any(p in norm for p in BASE):
        return []
    padded, out = b" " + norm + b" ", []
    for phrase, label in BASE.items():
        at = padded.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(b" " + phrase + b" ", at + 1)
    number = counted(padded, b" ", [at for at, _ in out])
    return sorted((number[at], label) for at, label in out)


def counted(text, mark, places: list[int]) -> dict[int, int]:
    """How many marks stand before each place, in one pass over the text."""
    out, last, n = {}, 0, 0
    for at in sorted(set(places)):
        n += text.count(mark, last, at)
        out[at] = n
        last = at
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels of each document, and its fuzzy spans as `label:first word-last word:edits`, separated by spaces.

    score: 1 for a base phrase or an exact notice, less by the share of edits for the best fuzzy notice, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    norm, n = normalise(text)
                    places = base_places(norm)
                    body = norm.decode()
                    spans = scanner.fuzzy(body)
                    base = sorted({label for _, label in places})
                    labels = sorted({*base, *(scanner.notices[i][1] for _, _, i, _ in spans)})
                    score = max([1.0 if places else 0.0, *(1 - e / (scanner.notices[i][2] + 1) / 2 for _, _, i, e in spans)])
                    number = counted(body, " ", [x for a, b, _, _ in spans for x in (a, b)])
                    shown = " ".join(f"{scanner.notices[i][1]}:{number[a]}-{number[b]}:{e}" for a, b, i, e in spans)
                    words = [w for w, _ in places]
                    out.append((doc, n, len(words), min(words, default=None), max(words, default=None), ",".join(base), ",".join(labels), score, shown))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()])],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
