"""Packing, spelling variants and the filter audit against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import audit, catalogue, packing, variants

SCHEMA = "doc_id long, text string, lang string, length long, n long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "x" * 3000, 5: "<|endoftext|> a  b c", 6: "ÀÉ straße 漢字 🙂" * 9}
    for i in range(7, 120):
        out[i] = " ".join(words(rng, rng.choice([3, 40, 90, 200, 400, 700])))
    for i in range(120, 150):  # a third of one length
        out[i] = out[20]
    out[150] = " ".join(words(rng, 9000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, [None, "en", "fr"][i % 3], 1, 1) for i, t in texts.items()], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(packing.default_tokenizer())
    codec.encode_special_tokens = True
    pieces = packing.cut(docs)
    packed = packing.pack(pieces)
    rows = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    ids = {i: [*codec.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert set(by_doc) == set(ids)
    for i, found in by_doc.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found))) and found[0].start == 0
        assert all(r.length == 1024 for r in found[1:]) and all(a.start + a.length == b.start for a, b in zip(found, found[1:]))
        assert b"".join(bytes(r.ids) for r in found) == np.array(ids[i], "<u4").tobytes()
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert found[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(found, found[1:]))
        assert sum(r.length for r in found) <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(by_sequence) <= least + 2
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for k, found in by_sequence.items():
        assert bytes(whole[k].ids) == b"".join(bytes(r.ids) for r in found) and whole[k].n_tokens == sum(r.length for r in found)
    assert packing.pack(packing.cut(empty)).count() == 0 and packing.cut(empty).columns == ["doc_id", "piece", "start", "length", "ids"]


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 1024])
    lengths = [rng.randrange(1, size + 1) for _ in range(rng.choice([1, 30, 400]))] + [max(1, size // 3)] * rng.choice([0, 200])
    groups, large = rng.choice([(1, 0.1), (5, 0.9), (64, 1 / 3), (64, 1 / 3)])
    made = packing.plan(Counter(lengths), size, groups, large)
    held = defaultdict(list)
    for n, c in Counter(lengths).items():
        starts = [p[0] for p in made.places[n]]
        assert starts == sorted(starts) and starts[0] == 0
        for number in range(c):
            first, sequence, each, offset = made.places[n][np.searchsorted(starts, number, "right") - 1]
            held[sequence + (number - first) // each].append((offset + (number - first) % each * n, n))
    for found in held.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= size
    assert len(held) == made.sequences
    if groups == packing.GROUPS:
        assert made.sequences <= best_fit_decreasing(lengths, size) * 1.02 + 1


def test_giant_texts_are_tokenized_in_parts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta-1", "it's", "  two", "ö"]) for _ in range(150_000)) + "y" * 20_000
    assert len(packing.parts_of(text, 5000)) > 50 and "".join(packing.parts_of(text, 5000)) == text
    rows = packing.cut(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()
    want = [*Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids, 2]
    assert b"".join(bytes(r.ids) for r in rows) == np.array(want, "<u4").tobytes()


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(texts):
    count = Counter()
    for i, t in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    form, n_near = {}, {}
    for w, n in count.items():
        some = [x for x in count if abs(len(x) - len(w)) < 2 and near(w, x)]
        n_near[w] = len(some)
        best = min(some, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * n else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], count.get(form[w])))
    return out


@pytest.mark.parametrize("small", [0, 3, 48])
def test_variants(spark, empty, small):
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeéXÿ") for _ in range(rng.randrange(6, 11))) for _ in range(25)] + ["zz" * 50, "y" * 5000]
    texts = [(0, None), (1, ""), (None, "abcdefgh abcdefgh"), (3, "y" * 4999 + " " + "y" * 4999)]
    for i in range(4, 260):
        some = []
        for _ in range(30):
            w = list(stems[min(int(rng.expovariate(0.2)), len(stems) - 1)])
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "q", "ab", "É"])
            some.append("".join(w))
        texts.append((i % 200, " ".join(some)))
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, word int").repartition(3)
    got = [tuple(r) for r in variants.variants(df, small=small).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(texts)
    assert any(form for _, form, *_ in got)
    assert variants.variants(empty).count() == 0


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.word: r.root for r in variants.last(forms).collect()} == {f"w{i}": "w21" for i in range(21)}


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i)
        parts[lang or ""].append(({f for f, bad in zip("ABCDE", tests) if bad}, *labels.get(i, (0, 0))))
    out = set()
    for part, found in parts.items():
        orders, shapley = {}, Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = found
            for k, f in enumerate(order):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                shapley[f] += len(gone)
                orders[order, k] = (len(alive), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone))
        out |= {(part, o, k + 1, *v, shapley[o[k]]) for (o, k), v in orders.items()}
    return out


def test_audit(spark, empty):
    rng = random.Random(4)
    base = [None, "", "one", "A B C", "x # y", " ".join(words(rng, 150, 20)), " ".join(words(rng, 150, 9000)), " ".join(words(rng, 120, 9000)).upper(), " ".join(words(rng, 120, 9000)) + " 5%", " " + "a\x0bb " * 80]
    rows = [(rng.choice([i, i, i, i // 2, None]), rng.choice(base), rng.choice(["en", "fr", None, ""])) for i in range(300)]
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 3)}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, words int").repartition(4)
    known = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in audit.audit(df, known).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, labels)
    assert audit.audit(empty, known).count() == 0


def test_queries_are_registered():
    assert {"op11_packing", "op12_spelling_variants", "op13_filter_audit"} <= set(catalogue.QUERIES)
