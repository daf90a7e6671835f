"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words belong to classes: insult, threat, target, negation, reported speech, breaks, others.  Three small transducers over
these classes are composed into one automaton: the first marks what a negation governs (the words that follow it, up to a
break), the second what follows a reporting verb, the third accepts clause patterns: an insult or a threat alone, or with a
target next to it, before or after.  Each pattern and mark has a weight, relative to that of its insult or threat word.  A
clause (text between sentence marks and line ends) scores its best accepting path; marks cannot be bypassed by a path.  A
document scores by its clauses' sum, mapped to [0, 1] by a logistic curve.

The seed lexicon is general; the insult class is extended, and its words and stems (initial letters, for inflecting forms)
and the threats weighted, by their document frequencies in labelled training rows, of which at most `train_rows`, the first
by a hash of their ids, are used.  Words of the other classes have no weight of their own.  The weights of patterns and marks
are fitted together with the curve on the same rows, from PRIOR on, which patterns without cases keep.  Scores depend on the
text alone.

Defined cases: a null or empty text scores as one without any match; rows with a null or repeated id are scored each;
without any labelled rows of both classes the seed lexicon and a fixed curve are used; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import freed, slices

#: The seed lexicon, by class.
INSULTS = "idiot moron loser clown scum trash stupid pathetic worthless disgusting fool imbecile dumb garbage vermin".split()
THREATS = "kill hurt destroy beat punch shoot stab attack".split()
TARGETS = "you your they them he she him her this these those".split()
NEGATIONS = "not no never nobody nothing isn't aren't don't wasn't".split()
REPORTED = "said says say called wrote claimed quoted".split()
BREAKS = "but however yet".split()
#: Patterns, and the marks of what they are made of: n for negated, r for reported.
PATTERNS, MARKS = ["insult", "target+insult", "threat", "target+threat"], ["", "n", "r", "nr"]
#: Weights of patterns and marks before any fit, relative to the words' own weight, and the precision of their logarithms.
PRIOR, PRECISION = {"insult": 1.0, "target+insult": 1.2, "threat": 0.25, "target+threat": 1.2, "n": 0.2, "r": 0.5}, 4.0
#: Words a negation governs, and most words between a target and the insult or threat after and before it.
SCOPE, BEFORE, AFTER = 4, 3, 2
TRAIN_ROWS = 20_000
STEM = 4
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[,:()]")
#: Classes: insult, threat, target, negation, reporting verb, break (punctuation), contrast (ends reports too), other.
_CLASSES = "ihtnrbco"


class Transducer:
    """Arcs by state and input symbol: lists of (output symbol, next state)."""

    def __init__(self, start, finals: set, arcs: dict):
        self.start, self.finals, self.arcs = start, finals, arcs

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that gives this one's output to the other."""
        start, arcs = (self.start, other.start), {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            a, b = state
            arcs[state] = {
                x: [(z, (a2, b2)) for y, a2 in outs for z, b2 in other.arcs[b].get(y, [])] for x, outs in self.arcs[a].items()
            }
            todo += [n for outs in arcs[state].values() for _, n in outs]
        return Transducer(start, {(a, b) for a, b in arcs if a in self.finals and b in other.finals}, arcs)

    def numbered(self) -> Transducer:
        number = {s: i for i, s in enumerate([self.start, *(s for s in self.arcs if s != self.start)])}
        arcs = {number[s]: {x: [(y, number[n]) for y, n in outs] for x, outs in by.items()} for s, by in self.arcs.items()}
        return Transducer(0, {number[s] for s in self.finals}, arcs)


def negation() -> Transducer:
    """Marks the SCOPE words after a negation, up to a break."""
    arcs = {
        s: {x: [(x, SCOPE)] if x == "n" else [(x, 0)] if x in "bc" else [(x + "n" * (s > 0), max(s - 1, 0))] for x in _CLASSES}
        for s in range(SCOPE + 1)
    }
    return Transducer(0, set(arcs), arcs)


def reporting() -> Transducer:
    """Marks what follows a reporting verb, up to a contrast."""
    symbols = [*_CLASSES, *(x + "n" for x in _CLASSES)]
    arcs = {s: {x: [(x, 1)] if x[0] == "r" else [(x, 0)] if x == "c" else [(x + "r" * s, s)] for x in symbols} for s in (0, 1)}
    return Transducer(0, {0, 1}, arcs)


def patterns() -> Transducer:
    """Accepts clauses with any number of patterns; outputs the pattern and mark of a word that has a part in one."""
    arcs: dict[str, dict[str, list]] = {}

    def put(state: str, classes: str, pattern: str | None, to: str) -> None:
        for c in classes:
            for m, mark in enumerate(MARKS):
                out = None if pattern is None else len(MARKS) * PATTERNS.index(pattern) + m
                arcs.setdefault(state, {}).setdefault(c + mark, []).append((out, to))

    before, after = [f"before{i}" for i in range(BEFORE + 1)], [f"after{i}" for i in range(AFTER + 1)]
    finals = ["free", "met", *before]
    for state in finals:
        put(state, _CLASSES, None, "free")
        put(state, "t", None, before[0])
        put(state, "i", "insult", "free")
        put(state, "h", "threat", "free")
    for state in ["met", *before]:
        put(state, "i", "target+insult", "met")
        put(state, "h", "target+threat", "met")
    for state in [*finals, *after]:
        put(state, "i", "target+insult", after[0])
        put(state, "h", "target+threat", after[0])
    for state, to in [*zip(before, before[1:]), *zip(after, after[1:])]:
        put(state, "nrbo", None, to)
    for state in after:
        put(state, "t", None, before[0])
    return Transducer("free", set(finals), arcs)


CLAUSES = negation().compose(reporting()).compose(patterns()).numbered()


class Grammar:
    """The composed automaton with the weights of words, stems, patterns and marks, and the curve."""

    def __init__(self, weights: dict[str, float], stems: dict[str, float], curve: tuple[float, float]):
        self.kind = {w: k for k, ws in (("t", TARGETS), ("n", NEGATIONS), ("r", REPORTED), ("c", BREAKS), ("h", THREATS)) for w in ws}
        self.kind.update(dict.fromkeys(",:()", "b"))
        self.weights = {w: v for w, v in weights.items() if self.kind.get(w, "h") == "h"}
        self.stems, self.curve = stems, curve
        self.pattern = _products(PRIOR)
        tokens = "|".join(sorted(map(re.escape, self.weights), key=len, reverse=True))
        begin = "|".join(sorted(map(re.escape, stems), key=len, reverse=True))
        self.any = re.compile(rf"(?<![^\W\d_])(?:(?:{tokens or '(?!)'})(?![^\W\d_])|(?:{begin or '(?!)'}))")

    def word(self, w: str) -> float:
        return self.weights.get(w) or self.stems.get(w[:STEM], 0.0)

    def clause(self, clause: str) -> tuple[float, tuple | None]:
        """Score and matches (output, word's weight, the matches before) of the best accepting path."""
        paths: dict[int, tuple[float, tuple | None]] = {CLAUSES.start: (0.0, None)}
        for w in _TOKEN.findall(clause):
            kind = self.kind.get(w)
            own = self.word(w) if kind in (None, "h") else 0.0
            kind = kind or ("i" if own else "o")
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (total, matches) in paths.items():
                for out, to in CLAUSES.arcs[state][kind]:
                    gain = total if out is None else total + own * self.pattern[out]
                    if to not in after or gain > after[to][0]:
                        after[to] = (gain, matches if out is None else (out, own, matches))
            paths = after
        return max((paths[s] for s in paths if s in CLAUSES.finals), key=lambda x: x[0])

    def clauses(self, text: str | None) -> Iterator[tuple[float, tuple | None]]:
        low, seen = (text or "").lower(), -1
        for m in self.any.finditer(low):  # only clauses that hold a weighted word are parsed
            if m.start() < seen:
                continue
            start = max(low.rfind(c, 0, m.start()) for c in ".!?;\n") + 1
            end = _CLAUSE.search(low, m.start())
            seen = end.start() if end else len(low)
            yield self.clause(low[start:seen])

    def raw(self, text: str | None) -> float:
        return sum((score for score, _ in self.clauses(text)), 0.0)

    def found(self, text: str | None) -> list[float]:
        """Sum of the words' own weights by output of the best paths."""
        sums = [0.0] * len(self.pattern)
        for _, matches in self.clauses(text):
            while matches:
                out, own, matches = matches
                sums[out] += own
        return sums

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(self.raw(text))))))


def _products(weights: dict[str, float]) -> list[float]:
    """Weight of each output: of its pattern, times those of its marks."""
    return [weights[p] * math.prod(weights[m] for m in mark) for p in PATTERNS for mark in MARKS]


def _features(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems from document frequencies by class: log odds, where they are sure and strong."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    rows = train.select("toxic", words.alias("w"))
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return dict.fromkeys(INSULTS + THREATS, 3.0), {}

    def weigh(feature) -> dict[str, float]:
        counted = rows.select("toxic", F.explode(feature).alias("f")).groupBy("f").agg(
            F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")
        )
        odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
        sure = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
        top = counted.select("f", odds.alias("o"), sure.alias("s"), "p").where("p >= 3 and o > 2.5 and s > 4")
        return {r["f"]: float(r["o"]) for r in top.collect()}  # each is in three of the TRAIN_ROWS rows at least

    own = weigh(F.col("w"))
    long = F.filter("w", lambda x: F.char_length(x) >= STEM)
    stems = weigh(F.array_distinct(F.transform(long, lambda x: F.substring(x, 1, STEM))))
    known = {w[:STEM] for w in own if w in INSULTS + THREATS}
    stems = {k: v for k, v in stems.items() if k not in known and len(k) == STEM}
    return {**dict.fromkeys(INSULTS + THREATS, 2.0), **{w: v for w, v in own.items() if w[:STEM] not in stems}}, stems


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], dict[str, float]]:
    """Logistic curve over log(1 + raw) and the weights of patterns and marks, by a damped Gauss-Newton method.

    x: a row of Grammar.found for each document.  The curve has a little ridge, the logarithms of the weights have PRIOR as
    their mean.  An insult alone has its word's weight; a target does not lessen a weight and a mark does not raise it.
    """
    free = [k for k in PRIOR if k != "insult"]
    part = np.array([[k == p or k in mark for p in PATTERNS for mark in MARKS] for k in free], dtype=float)
    base = np.array(_products(PRIOR))
    limits = np.full((2, len(free)), [[-1.5], [1.5]])
    for i, k in enumerate(free):
        if k == "target+insult":
            limits[0, i] = -math.log(PRIOR[k])
        elif k in MARKS:
            limits[1, i] = min(1.5, -math.log(PRIOR[k]))
    ridge = np.array([0.1, 0.1] + [PRECISION] * len(free))

    def at(beta: np.ndarray):
        values = x * (base * np.exp(beta[2:] @ part))
        raw = values.sum(axis=1)
        eta = np.clip(beta[0] + beta[1] * np.log1p(raw), -30, 30)
        loss = (np.logaddexp(0, eta) - y * eta).sum() + (ridge * beta**2).sum() / 2
        return loss, eta, np.column_stack([np.ones(len(x)), np.log1p(raw), beta[1] * (values @ part.T) / (1 + raw)[:, None]])

    beta = np.zeros(2 + len(free))
    loss, eta, slope = at(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-eta))
        grad = slope.T @ (y - p) - ridge * beta
        step = np.clip(np.linalg.solve((slope * (p * (1 - p))[:, None]).T @ slope + np.diag(ridge), grad), -2, 2)
        for _ in range(20):
            tried = beta + step
            tried[2:] = np.clip(tried[2:], *limits)
            found = at(tried)
            if found[0] <= loss:
                break
            step = step / 2
        else:
            break
        moved = abs(tried - beta).max()
        beta, (loss, eta, slope) = tried, found
        if moved < 1e-6:
            break
    weights = {k: PRIOR[k] * math.exp(d) for k, d in zip(free, beta[2:])}
    weights["target+threat"] = max(weights["target+threat"], weights["threat"])
    return (float(beta[0]), float(beta[1])), {"insult": 1.0, **weights}


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Grammar:
    """Grammar fitted on labelled rows whose crc32(doc_id) mod 5 is not 0, at most train_rows of them."""
    keep = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    keep = keep.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    keep = keep.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(keep, "doc_id").select("text", "toxic").persist()
    try:
        weights, stems = _features(rows)
        grammar = Grammar(weights, stems, (-4.0, 2.5))
        found = rows.mapInArrow(freed(_found_of(grammar)), "found array<double>, toxic int").toPandas()  # train_rows rows at most
    finally:
        rows.unpersist()
    if found["toxic"].nunique() == 2:
        grammar.curve, weights = _fit(np.array(found["found"].tolist()), found["toxic"].to_numpy())
        grammar.pattern = _products(weights)
    return grammar


def _found_of(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [grammar.found(t) for part in slices(batch, "text") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), batch.column("toxic")], names=["found", "toxic"])

    return run


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs with a further column toxic_score (a column of that name is replaced)."""
    rows = docs.drop("toxic_score")
    schema = rows.select("*", F.lit(0.0).alias("toxic_score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                scores = [grammar.score(t) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "toxic_score"])

    return rows.mapInArrow(freed(run), schema)
