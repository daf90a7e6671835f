"""The operators against brute force, on small tables with nulls, ties, repeated rows, copies and long texts."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.llm import catalogue, chat, common, decontaminate, fingerprints, licenses, neardup, passages, pieces, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, h1 long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "One two", 5: "x" * 40_000, 6: "a  b\x0bc d"}
    passage = words(rng, 60)
    for i in range(7, 60):
        w = words(rng, rng.randrange(1, 200))
        if i % 4 == 0:
            w[3:3] = passage
        out[i] = " ".join(w)
    for i in range(60, 80):  # near copies, copies and chains of near copies
        w = out[i - 20].split()
        if i % 3 and w:
            w[rng.randrange(len(w))] = "edit"
        out[i] = " ".join(w)
    base = words(rng, 120, 5000)
    for i in range(80, 95):
        base = base[:]
        base[rng.randrange(len(base))] = f"new{i}"
        out[i] = " ".join(base)
    out[95] = " ".join(words(rng, 3000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, 1) for i, t in texts.items()], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / (sum((a | b).values()) or 1)


def test_fingerprints(docs, texts, empty, spark):
    got = {r.doc_id: r for r in fingerprints.fingerprint_query(docs, 128).collect()}
    ids, off = sorted(texts, reverse=True), []
    for at, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(split(t) or [""], split(edited) or [""]), r.near_next - jaccard(split(t) or [""], split(nxt) or [""])]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.25
    by_text = defaultdict(set)
    for i, r in got.items():
        by_text[texts[i] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.fingerprint_query(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "c"), (4, "d"), (4, "d"), (9, "e")], "doc_id long, text string")
    assert fingerprints.fingerprint_query(odd).count() == 5


def test_fingerprints_of_many_buckets(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    near = fingerprints.neighbours(df, "doc_id", "text").where("own").collect()
    assert len(near) == 3000
    for r in near:
        assert r.next_text == f"t{r.doc_id // 7 - 1 if r.doc_id else 2999}"


def test_minimax_cuts():
    rng = random.Random(1)

    def feasible(sizes, capacity, shards):
        n, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if held + s > capacity:
                n, held = n + 1, 0
            held += s
        return n <= shards

    for _ in range(200):
        sizes, shards = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))], rng.randrange(1, 6)
        at = [0, *sharding.cuts(sizes, shards), len(sizes)]
        most = max(sum(sizes[a:b]) for a, b in zip(at, at[1:]))
        assert len(at) - 1 <= shards and most == next(c for c in range(1, 1000) if feasible(sizes, c, shards))


def test_cuts_are_even_beside_a_hot_group():
    rng = random.Random(5)
    for part in (1 / 3, 0.1):
        sizes = [rng.randrange(50, 150) for _ in range(6000)]
        sizes[2000] = int(sum(sizes) * part / (1 - part))
        at = [0, *sharding.cuts(sizes, 16), len(sizes)]
        held = sorted(sum(sizes[a:b]) for a, b in zip(at, at[1:]))
        assert len(held) == 16 and held[-1] == sizes[2000] and held[0] > 0.85 * sum(held[:-1]) / 15 and held[-2] < 1.15 * sum(held[:-1]) / 15

    def squares(sizes, at):
        return sum(sum(sizes[a:b]) ** 2 for a, b in zip(at, at[1:]))

    for _ in range(100):
        sizes, shards = [rng.choice([1, 2, 3, 9, 40]) for _ in range(rng.randrange(1, 11))], rng.randrange(1, 5)
        ways = [[0, *c, len(sizes)] for c in combinations(range(1, len(sizes)), min(shards, len(sizes)) - 1)]
        most = {tuple(w): max(sum(sizes[a:b]) for a, b in zip(w, w[1:])) for w in ways}
        least = min(squares(sizes, w) for w in ways if most[tuple(w)] == min(most.values()))
        got = [0, *sharding.cuts(sizes, shards), len(sizes)]
        assert most[tuple(got)] == min(most.values()) and squares(sizes, got) == least


def test_sharding(spark, docs, texts, empty):
    copies = spark.range(1000, 4000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    rows = sharding.shard(docs.select("doc_id", "text").unionByName(copies)).collect()
    assert len(rows) == len(texts) + 3000
    slots, group = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts.get(r.doc_id, "copy") or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        group[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in group.values())
    assert set(slots) <= set(range(16)) and sharding.shard(empty).count() == 0


def test_chat_trees(spark):
    tree = spark.createDataFrame(
        [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 5.0, "assistant", "good</s>"), (1, 4, 3, 0.0, "user", "\\l[x"), (2, 1, None, None, "user", "")],
        "conv_id long, node long, parent long, score double, role string, text string",
    )
    got = {(r.conv_id, r.branch): r for r in chat.read_back(chat.format_paths(chat.best_paths(tree, 2))).collect()}
    assert [tuple(t) for t in got[1, 0].turns] == [("user", "q"), ("assistant", "good</s>"), ("user", "\\l[x")]
    assert [tuple(t) for t in got[1, 1].turns] == [("user", "q"), ("assistant", "bad")]
    assert got[1, 0].loss == "good</s>" and got[1, 1].loss == "bad" and got[2, 0].loss == "" and len(got) == 3
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.best_paths(chat.chain(empty)).count() == 0


def test_chat_long_and_odd(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"<s>[USER|user] {i}\\b</s>") for i in range(70)] + [(2, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_paths(chat.best_paths(chat.chain(df)))).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:70]]
    assert got[1].loss == "".join(r[3] for r in rows[:70] if r[2] == "assistant") and len(got[2].turns) == 2


def test_chat_null_conversation(spark):
    rows = [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (None, 3, "user", "r"), (0, 1, "assistant", "zero"), (5, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_paths(chat.best_paths(chat.chain(df)))).collect()}
    assert {k: [t.text for t in r.turns] for k, r in got.items()} == {None: ["q", "a", "r"], 0: ["zero"], 5: ["x"]}
    assert got[None].loss == "a"


def test_licenses(spark, empty):
    rows = {
        1: "Released under the MIT  License.\nmit license mit license",
        2: "Licensd under teh Apache License, Version 2.0",
        3: "CC-BY and cc by: GNU General Public License",
        4: None,
        5: "summit license",
        6: "Permision is hereby granted, free of charge to any persn",
    }
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 3, 7, "mit") and "mit-notice" in got[1].labels
    assert got[2].base_labels == "apache" and "apache-notice" in got[2].labels
    assert (got[3].n_base, got[3].base_labels) == (3, "cc-by,gpl")
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert got[5].n_base == 0 and "mit-text" in got[6].labels and 0 < got[6].score < 1
    assert licenses.scan(empty).count() == 0


def test_fuzzy_search_finds_all_within_the_edits():
    rng, scanner = random.Random(2), licenses.Scanner()
    for i, (notice, _, edits) in enumerate(licenses.NOTICES):
        for _ in range(20):
            t = list(notice)
            for _ in range(edits):
                t[rng.randrange(1, len(t) - 1)] = "x"
            assert any(n == i for _, _, n, _ in scanner.fuzzy("aa bb " + "".join(t) + " cc"))


def test_fuzzy_search_keeps_places_before_the_best():
    scanner = licenses.Scanner()
    assert [(a, b, e) for a, b, _, e in scanner.fuzzy("mozila public license mozilla public license x")] == [(0, 21, 1), (22, 44, 0)]
    found = scanner.fuzzy("all rights reservd all rights reserved all rigts reserved all rights reserved")
    assert [(a, b, e) for a, b, _, e in found] == [(0, 18, 1), (19, 38, 0), (39, 57, 1), (58, 77, 0)]


def test_toxicity(spark, empty):
    rng, rows, labels = random.Random(3), [], []
    for i in range(300):
        w = words(rng, 30)
        if i % 3 == 0:
            w[5:5] = ["you", "idiot"] if i % 2 else ["gruntle", "clown"]
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(None, None), (900, ""), (900, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    g = toxicity.train(docs, labels)
    got = toxicity.score(docs, g).collect()
    assert len(got) == 303 and all(0 <= r.toxic_score <= 1 for r in got)
    assert all((r.toxic_score >= 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert g.raw("you are an idiot.") > g.raw("an idiot.") > g.raw("he said: an idiot") * 0.5 and g.raw("he said not an idiot") < g.raw("an idiot")
    none = toxicity.train(docs, labels.where("false"))
    assert none.score("you idiot, you moron, stupid trash") > 0.5 > none.score("fine day")
    assert toxicity.score(empty, none).count() == 0


def test_toxicity_patterns_are_ordered(spark):
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS + toxicity.THREATS, 3.0), {}, (-4.0, 2.5))
    alone, of_you = g.raw("an idiot"), g.raw("you are such an idiot")
    assert g.raw("an idiot like you") == of_you > alone == g.raw("you walk along the old road past an idiot")
    assert g.raw("you are not an idiot") < 0.5 * alone and g.raw("you idiot do not care") == of_you == g.raw("you never listen, you idiot")
    assert g.raw("he said: you are an idiot") < of_you == g.raw("you idiot, he said") and g.raw("he said no but you are an idiot") == of_you
    assert g.raw("I will kill you") > 2 * g.raw("I will kill time") > 0 and g.raw("I will never kill you") < 0.5 * g.raw("I will kill you")
    rows, labels = [], []
    for i in range(300):
        w = words(random.Random(i), 20)
        w[5:5] = ["kill", "you"] if i % 3 == 0 else ["kill", "the", "time", "they"] if i % 3 == 1 else ["not", "idiot"] if i % 2 else []
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    g = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    prior = dict(zip([(p, m) for p in toxicity.PATTERNS for m in toxicity.MARKS], toxicity._products(toxicity.PRIOR)))
    fitted = dict(zip(prior, g.pattern))
    assert fitted["target+threat", ""] > prior["target+threat", ""] and fitted["insult", "n"] < prior["insult", "n"]
    assert g.score("we will kill you") > g.score("we will kill much time")


def test_warc_round_trip(spark):
    rows = [(1, "http://a b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "v", "WARC/1.1\r\n\r\n"), (6, "w", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.record_id: r for r in warc.read_archives(warc.archive_pages(spark, df)).collect()}
    assert len(got) == 6 and all(r.problem is None for r in got.values())
    for i, _, html in rows:
        r, data = got[f"urn:page:{i}"], (html or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.type, r.refers_to) == {1: ("revisit", "urn:page:2"), 3: ("revisit", "urn:page:4")}.get(i, ("response", None))
        assert r.type == "revisit" or bytes(r.payload) == data
    assert warc.read_archives(warc.archive_pages(spark, df.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    data = [f"payload {i} ".encode() * 300 for i in range(8)]
    recs = [warc.record("response", f"urn:page:{i}", "u", d) for i, d in enumerate(data)]
    parts = [warc.member(r) if packed else r for r in recs]
    parts[2] = parts[2][:20] + b"\x00\xff" * 40 + parts[2][100:]
    parts[5] = parts[5][: len(parts[5]) // 2]
    raw = b"".join(parts) + b"tail junk"
    found = list(warc.read_archive(io.BytesIO(raw), len(raw)))
    good = [f for f in found if f["problem"] is None]
    assert {f["record_id"] for f in good} >= {f"urn:page:{i}" for i in (0, 1, 3, 4, 6)} and all(f["payload"] == data[int(f["record_id"][9:])] for f in good)
    spans = sorted((f["at"], f["at"] + f["size"]) for f in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(f["problem"] is not None for f in found) >= 2


def test_passages(docs, texts, empty, spark):
    got = {r.doc_id: r for r in passages.strip_repeats(docs).collect()}
    seen, removed = set(), 0
    for i in sorted(texts):
        w = split(texts[i])
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        removed += sum(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert removed > 1000 and len(got) == len(texts) and passages.strip_repeats(empty).count() == 0
    long = " ".join(f"v{i}" for i in range(40))
    odd = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + " " + long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in passages.strip_repeats(odd).collect()) == [(0, 40), (1, 0), (1, 0), (2, 80)]


def links(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = [x for x in split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(texts):
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, texts, empty, n):
    roots, sizes = links(texts, n, 80)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, words=n).collect()}
    assert {i: r.component_id for i, r in got.items()} == roots and {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in got.items()) and max(Counter(roots.values()).values()) > 10


def test_near_duplicates_of_one_text(spark, monkeypatch):
    """Many unlinked edits of one text: no pairs of them all, and still every link, links by shared edits included."""
    rng = random.Random(11)
    base = words(rng, 120, 5000)
    texts = {0: " ".join(base)}
    for i in range(1, 260):
        w = (texts[rng.randrange(i)].split() if i % 5 == 0 else base)[:]
        for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 9])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = [] if rng.random() < 0.2 else [f"e{rng.randrange(9999)}"]
        texts[i] = " ".join(w)
    roots, _ = links(texts, 4, 80)
    assert len(set(roots.values())) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    made = []
    monkeypatch.setattr(neardup, "drop_table", lambda *tables: made.extend(tables))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=4).collect()}
    assert got == roots
    assert sum(df.count() for df in made if "ok" in df.columns) < 12 * len(texts)  # of 33,670 pairs


def test_near_duplicates_odd(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    t = " ".join(f"v{i}" for i in range(50))
    odd = spark.createDataFrame([(3, t), (3, t), (None, t), (7, t.upper()), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, None, True), (7, 3, False), (8, 8, True)], key=str)


def test_index_guarantee():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (neardup.SYMBOLS, 200)).astype(np.uint16)
    b = a.copy()
    for j in range(200):  # the most symbols apart that the pigeonhole allows
        at = rng.permutation(neardup.SYMBOLS)[: 2 * neardup.CHUNKS - 1]
        b[at, j] += 1
    x, y = neardup.index_keys(a), neardup.index_keys(b)
    assert all(set(x[j]) & set(y[j]) for j in range(200))


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = {1: " ".join(words(rng, 40, 9999)), 2: "short item here", 3: None, 4: " ".join(words(rng, 30, 9999))}
    near = items[1].split()
    near[20] = "changed"
    far = items[1].split()
    far[::4] = ["z"] * len(far[::4])
    rows = {
        1: " ".join([*words(rng, 50), *items[1].upper().split(), *words(rng, 50)]),
        2: " ".join([*words(rng, 9), *near]),
        3: " ".join(far),
        4: "a short  item here b",
        5: None,
        6: " ".join([items[4], items[1]]),
        7: "short item",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.search(docs, bench, similarity=0.7).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (6, 1), (6, 4)}
    assert got[1, 1].first_word == 50 and got[1, 1].similarity == 1 and got[6, 1].first_word == 30 and got[2, 1].similarity < 1
    assert decontaminate.search(empty, bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0


def test_pieces_lattice_equals_library():
    codec = pieces.Codec(open(pieces.default_model(), "rb").read())
    cases = ["aaaaaaaaaaaaaaaaaaa", "abcabcabc" * 9, "supercalifragilistic" * 3, "日本語テキスト" * 20, "  a   b", "the" * 50, "ünïcödé" * 10, "    " * 9, "\n\n a\t b ", " ", "x ", "Hello, world! It's 12:30."]
    for text in cases:
        for chunk in (1, 2, 3, 7, 50, 1000):
            assert pieces.lattice_encode(codec, pieces.MARK + text.replace(" ", pieces.MARK), chunk) == codec.sp.encode(text)


def test_pieces_round_trip(spark, texts, empty):
    rows = {**texts, 200: "a▁b ▁\x00 ﷐", 201: "no spaces " * 50 + "q" * 5000 + "日本" * 500, 202: "wörd " * 3000}
    df = spark.createDataFrame([(i, t, None, 1) for i, t in rows.items()], SCHEMA)
    df = df.withColumn("x", F.lit(7)).withColumn("i", F.lit("c")).withColumn("pieces", F.lit(1))
    found = pieces.decode(pieces.encode(df, chunk=512, fan=3))
    assert found.columns == ["doc_id", "text", "lang", "h1", "x", "i", "pieces", "n_chunks", "decoded"]
    out = found.collect()
    assert max(r.n_chunks for r in out) > 27  # four levels of products
    sp = pieces.Codec(open(pieces.default_model(), "rb").read()).sp
    assert len(out) == len(rows) and any(r.n_chunks > 3 for r in out)
    for r in out:
        assert r.decoded == (rows[r.doc_id] or "")
        if pieces.MARK not in r.decoded:
            assert r.pieces == sp.encode(r.decoded)
    assert pieces.decode(pieces.encode(empty)).count() == 0


def test_pieces_decoded_while_encoding(spark, texts, empty):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, decoded string").repartition(3)
    found = pieces.encode(df, chunk=512, fan=3, decoded=True)
    other = pieces.decode(pieces.encode(df, chunk=512, fan=3))
    assert found.columns == other.columns and sorted(map(str, found.collect())) == sorted(map(str, other.collect()))
    assert all(r.decoded == (r.text or "") for r in found.collect())
    assert pieces.encode(empty, decoded=True).count() == 0


def test_tables_are_written_without_checksum_files(spark):
    """Spark's checksum file system forks the JVM for each file; tables of the shared folder go by the raw one."""
    df = common.materialise(spark.range(100).repartition(3), "plain")
    at = Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert len(list(at.glob("*.parquet"))) == 3 and not list(at.glob(".*.crc")) and df.count() == 100
    common.drop_table(df)
    assert not at.exists()


def test_workers_give_memory_back():
    """A Python worker must not keep the most that any of its tasks has held."""
    held = []

    def rss():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) // 1024

    def run(table):
        some = [bytes(2000) for _ in range(75_000)]
        held.append(bytes(2000))  # above the others: the heap cannot shrink by itself
        return table.slice(0, len(some) and 1)

    table, before = common.pa.table({"x": [1, 2]}), rss()
    assert common.freed(run)(table).num_rows == 1
    assert rss() - before < 60
    batches = common.freed(lambda found: (b.slice(1) for b in found))(iter(table.to_batches()))
    assert [b.to_pydict() for b in batches] == [{"x": [2]}]


def test_fingerprints_over_many_buckets(spark, monkeypatch):
    """Neighbours across the borders of more buckets than a plan could list one by one."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 1)
    rng = random.Random(6)
    texts = {3 * i - 700: " ".join(words(rng, rng.randrange(12))) for i in range(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_query(docs, 8).select("doc_id", "edited_sha256").collect()}
    ids = sorted(texts, reverse=True)
    for i, nxt in zip(ids, [*ids[1:], ids[0]]):
        t = texts[i]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + texts[nxt][: len(t) // 2]).encode()).hexdigest()
    assert len(got) == len(texts)


@pytest.mark.parametrize("similarity,recall", [(0.8, 1.0), (0.5, 0.7)])
def test_decontamination_against_brute_force(spark, monkeypatch, similarity, recall):
    """Every item in every document: found at 0.8, mostly at 0.5, and only what the block tables list."""
    rng = random.Random(12)
    items = {i: words(rng, rng.choice([3, 20, 31, 40]), 9999) for i in range(12)}
    rows, pairs = {}, set()
    for i in range(150):
        w = words(rng, rng.randrange(60), 9999)
        for item in rng.sample(range(12), 2):
            part = items[item][:]
            for _ in range(rng.randrange(5)):
                part[rng.randrange(len(part))] = "z"
            w[len(w) // 2 : len(w) // 2] = part
        rows[i] = w
        for item, x in items.items():
            grams = lambda x: Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4)))
            if any(jaccard_of(grams(w[j : j + len(x)]), grams(x)) >= similarity for j in range(len(w) - len(x) + 1)):
                pairs.add((i, item))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()] + [(200, None)], "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(x), 1) for i, x in items.items()] * 2, "item_id long, text string, doc_id long")
    found = decontaminate.search(docs, bench, similarity=similarity)
    got = found.collect()
    assert {(r.doc_id, r.item_id) for r in got} <= pairs and len({(r.doc_id, r.item_id) for r in got}) >= recall * len(pairs) > 20
    assert max(r.distance for r in got) > 8 and len(got) == len(set(got))
    index = decontaminate.Index([(i, " ".join(x)) for i, x in items.items()], 5, similarity)
    assert list(index.search([" ".join(rows[0])]))
    for group in index.lengths:
        group.tables[:] = False
    assert not list(index.search([" ".join(w) for w in rows.values()]))


def test_block_tables_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (50, 8)).astype(np.uint8)
    group = decontaminate.Length(9, 5, [(i, Counter(), p) for i, p in enumerate(prints)])
    bits = np.unpackbits(prints, axis=1)
    for i, b in enumerate(bits):
        b[rng.permutation(64)[: decontaminate.RADIUS]] ^= 1
    found = {(w, i) for w, i, _ in group.within(np.packbits(bits, axis=1))}
    assert {(i, i) for i in range(50)} <= found


def jaccard_of(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_passages_by_the_automata_alone(spark, monkeypatch):
    """Partial, nested, periodic and chained repeats over many units and automata, which alone mark words."""
    monkeypatch.setattr(passages, "UNIT_ROWS", 7)
    monkeypatch.setattr(passages, "PASSAGE", 13)
    monkeypatch.setattr(passages, "SHARD_WORDS", 150)
    monkeypatch.setattr(passages, "GROUP_BYTES", 1 << 10)
    rng = random.Random(21)
    sources = [words(rng, 90, 9999) for _ in range(4)] + [["a", "b"] * 40, ["c"] * 50]
    texts = {}
    for i in range(120):
        w = words(rng, rng.randrange(40), 9999)
        for _ in range(rng.randrange(3)):
            x = rng.choice(sources)
            at = rng.randrange(len(x) - 15)
            w[len(w) // 2 : len(w) // 2] = x[at : at + rng.randrange(15, 60)]
        texts[rng.randrange(10**6)] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("unit", F.lit("x")).repartition(3)
    seen, removed = set(), {}
    for i in sorted(texts):
        w = split(texts[i])
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        removed[i] = " ".join(x for x, g in zip(w, gone) if not g)
    got = passages.strip_repeats(docs)
    assert {r.doc_id: r.kept for r in got.collect()} == removed and got.columns == ["doc_id", "text", "unit", "n_words", "n_removed", "kept"]
    shard = passages.Shard(20)
    source = words(rng, 60, 9999)
    shard.add(3, " ".join(source).encode())
    marks = [passages.np.zeros(41 - 7, bool), passages.np.zeros(1, bool)]
    coded = [w.encode() for w in source]
    shard.cover([(5, coded[3:56]), (2, coded[:20])], marks)
    assert marks[0].all() and not marks[1].any()


def test_passages_of_many_words_in_few_edges():
    """Nodes of an automaton have few edges whatever the words, and what it covers is what brute force finds."""
    rng = random.Random(22)
    shard, seen = passages.Shard(20), set()
    sources = [words(rng, 60, 9) + words(rng, 60, 10**6) for _ in range(500)]
    for doc, source in enumerate(sources):
        shard.add(doc, " ".join(source).encode())
        seen |= {tuple(source[j : j + 20]) for j in range(len(source) - 19)}
    nodes = [edge[0] for edge in shard.build().dump()[1]]
    assert len(shard.numbers) > 20_000 and max(Counter(nodes).values()) < 400
    docs, marks, right = [], [], []
    for _ in range(200):
        x, y = rng.sample(sources, 2)
        text = x[rng.randrange(40) : rng.randrange(50, 120)] + words(rng, 5, 9) + ["new"] + y[rng.randrange(90) :] + words(rng, 30, 9)
        docs.append((500, [w.encode() for w in text]))
        right.append([tuple(text[j : j + 20]) in seen for j in range(len(text) - 19)])
        marks.append(passages.np.zeros(max(0, len(text) - 19), bool))
    shard.cover(docs, marks)
    assert [m.tolist() for m in marks] == right and 0 < sum(map(sum, right)) < sum(map(len, right))


def test_chat_roles_and_cycles(spark):
    roles = ["us|er", "a] b", "\\p<[", "assistant", "x] ] |"]
    df = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_paths(chat.best_paths(chat.chain(df)))).first()
    assert [tuple(t) for t in got.turns] == [(r, f"t{i}") for i, r in enumerate(roles)]
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (2, 1, 1), (3, 1, None), (3, 2, 1), (3, 5, 9), (4, 1, 7)]
    tree = spark.createDataFrame([(c, n, p, 1.0, "user", str(n)) for c, n, p in rows], "conv_id long, node long, parent long, score double, role string, text string")
    got = sorted((r.conv_id, r.branch, r.depth, r.text) for r in chat.best_paths(tree, 9).collect())
    assert got == [(3, 0, 1, "1"), (3, 0, 2, "2"), (3, 1, 1, "5"), (4, 0, 1, "1")]


def test_warc_query_with_odd_ids(spark, tmp_path):
    rows = [(7, "a"), (7, "a"), (3, "a"), (None, "a"), (None, "b"), (1, "b"), (None, "c"), (None, "c"), (2, None), (4, "")]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in catalogue.QUERIES["op6_warc"](spark, str(tmp_path)).collect())
    assert got == Counter(
        [(7, 1, "response", None)] * 2 + [(3, 1, "revisit", 7), (None, 1, "revisit", 7), (None, 1, "revisit", 1), (1, 1, "response", None)]
        + [(None, 1, "response", None)] * 2 + [(2, 0, "revisit", 4), (4, 0, "response", None)]
    )


def test_license_places_against_a_scan(spark):
    """Counts and places of the base phrases by a plain look at every word; also of a very long text, in linear time."""
    rng = random.Random(2)
    pool = "gnu general public license apache mit cc by é x 3".split()
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    texts = {i: rng.choice(["", ", "]).join(rng.choice([w, w.upper()]) + rng.choice(" -\n") for w in rng.choices(pool, k=rng.randrange(60))) for i in range(80)}
    texts[99] = "MIT license. " * 20_000
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in licenses.scan(df).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
