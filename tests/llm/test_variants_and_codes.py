"""Spelling variants and vector codes against brute force, bounds against every edit, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import queries, variants, vectorcodes
from tidegrid.llm.common import read_table

SF_DIR = "/root/testdata/sf0.001"


def edits(w, alphabet):
    for k in range(len(w) + 1):
        yield from (w[:k] + c + w[k:] for c in alphabet)
        if k < len(w):
            yield w[:k] + w[k + 1 :]
            yield from (w[:k] + c + w[k + 1 :] for c in alphabet if c != w[k])


def brute_force(docs):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):  # a word one shorter, and words with another character here
            if (less := w[:k] + w[k + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for k in range(max(map(len, n), default=0)):
        same = collections.defaultdict(list)
        for w in n:
            if len(w) > k:
                same[w[:k], w[k + 1 :]].append(w)
        for own in same.values():
            for w in own:
                near[w].update(x for x in own if x != w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=3, max_size=12), min_size=5, max_size=60), st.integers(0, 6))
def test_an_edit_affects_no_more_grams_than_the_bound(words, too_many):
    counts = collections.Counter(g for w in words for q in range(2, 5) for m in [f"\x02{w}\x03"] for g in (m[k : k + q] for k in range(len(m) - q + 1)))
    d = variants.Dictionary(counts, too_many)
    grams = lambda w: [(p, e, f"\x02{w}\x03"[p:e]) for p, e in d.decompose(f"\x02{w}\x03")]
    for w in words[:5]:
        own = grams(w)
        bound = d.affected(f"\x02{w}\x03", [(p, e) for p, e, _ in own])
        for x in edits(w, "abé"):
            if x != w:
                # A gram stays where it is, or keeps its place from the end.
                there = {(p, g) for p, _, g in grams(x)} | {(p + len(w) - len(x), g) for p, _, g in grams(x)}
                assert sum((p, g) not in there for p, _, g in own) <= bound


@pytest.mark.parametrize("hot, too_many", [(variants.HOT, 3), (0, 3), (5, 10), (variants.HOT, 0)])
def test_pairs(spark, hot, too_many):
    r = random.Random(hot + too_many)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(700)} | {"aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa"})
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long").repartition(3)
    counts = {x["gram"]: x["n"] for x in variants.gram_counts(df).collect()}
    got = variants.near_pairs(df, variants.Dictionary(counts, too_many), hot).collect()
    known = set(words)
    want = {(min(w, x), max(w, x)) for w in words for x in edits(w, "abcé") if x in known and x != w}
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want) > 100
    assert all((words[x["n_a"]], words[x["n_b"]]) == (x["a"], x["b"]) for x in got)


def test_variants_of_made_texts(spark):
    r = random.Random(5)
    base = ["station", "nation", "stations", "müller", "Größe", "ration", "aaaaa", "aaaaaa", "x" * 300, "ßßßßß", "×÷×÷×"]
    docs = [(k, " ".join(r.choice(base) for _ in range(r.randint(0, 120))) + ("\n\t9x-Größen" * (k % 3))) for k in range(80)]
    long = "xyz" * 3000
    docs += [(100 + k, f"{long} {long}q {long[:4000]}{long[4001:]} " + "abcdefgh" * 12 + " " + "abcdefgh" * 12 + "i") for k in range(8)] + [(200, long)] * 9
    docs += [(None, "station nation"), (None, "station nation"), (5, "station " * 500), (7, None), (8, ""), (9, " 12 日本 "), (10, "Y" * 70000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    want = brute_force(docs)
    assert rows_of(variants.variants(df)) == want and any(x[1] for x in want)
    assert rows_of(variants.variants(df, hot=0)) == want
    assert rows_of(variants.variants(df.limit(0))) == []


def test_variants_query(spark):
    docs = [(x["doc_id"], x["text"]) for x in read_table(spark, SF_DIR, "documents").collect()]
    assert rows_of(queries.op12_spelling_variants(spark, SF_DIR)) == brute_force(docs)


def codes_of(vectors, rounds=4, entries=256):
    kept = [(i, v, label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in kept], object).reshape(len(kept), 4, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(x[k][p]) for k in first] for p in range(4)]
    assign = lambda p, part: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            held = collections.defaultdict(list)
            for row in x:
                held[assign(p, row[p])[1]].append(row[p])
            for k, own in held.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[assign(p, row[p]) for p in range(4)] for row in x]
    error, of_label = [sum(d for d, _ in f) for f in found], collections.Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        of_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for p in range(4) for e in books[p] for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, of_label[label], sha) for (i, _, label), f, e in zip(kept, found, error, strict=True)), key=repr)


def made_vectors(n, seed=1):
    r = random.Random(seed)
    vectors = [(k, [r.uniform(-2, 2) for _ in range(8)], r.choice([1, 2, None])) for k in range(n)]
    vectors += [(n + k, vectors[3][1], 9) for k in range(n)]  # a third and more are the same
    return [*vectors, (1, vectors[5][1], 1), (None, [0.5] * 8, 2), (-4, None, 1), (-3, [1.0] * 7 + [None], 1), (-2, [1.0] * 7 + [float("nan")], 1), (-1, [1.0] * 7 + [float("-inf")], 1)]


@pytest.mark.parametrize("n, options", [(150, {}), (60, {"owned": 7, "entries": 16}), (40, {"rounds": 2, "entries": 4, "owned": 1}), (6, {})])
def test_codes(spark, n, options):
    vectors = made_vectors(n)
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in vectors], "vec_id long, embedding array<double>, label int, position int, code string").repartition(3)
    got = sorted(map(tuple, vectorcodes.compressed(df, **options).collect()), key=repr)
    assert got == codes_of(vectors, options.get("rounds", 4), options.get("entries", 256))


def test_large_components_are_exact():
    x = np.array([[2**27, -(2**27), 0], [2**27 - 1, 5, 7]])
    book = np.array([[2**27, -(2**27), 1], [2**27, -(2**27) - 1, 0], [0, 0, 0]])
    assert [a.tolist() for a in vectorcodes.nearest(x, book)] == [[0, 2], [1, (2**27 - 1) ** 2 + 74]]
    with pytest.raises(ValueError, match="too large"):
        vectorcodes.nearest(np.full((1, 16), 2**30), np.zeros((1, 16), np.int64))


def test_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectorcodes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert vectorcodes.compressed(spark.createDataFrame([(1, None, 2)], schema)).count() == 0
    with pytest.raises(Exception, match="components"):
        vectorcodes.compressed(spark.createDataFrame([(1, [1.0] * 8, 2), (2, [1.0] * 4, 2)], schema)).collect()


def test_decoded_vectors_are_near(spark):
    own = vectorcodes.kept_vectors(read_table(spark, SF_DIR, "embeddings"))
    books = vectorcodes.fit(own)
    codes = vectorcodes.encode(own, books)
    back = {x["vec_id"]: x["embedding"] for x in vectorcodes.decode(codes, books).collect()}
    error = {x["vec_id"]: x["error"] for x in codes.collect()}
    for x in own.collect():
        assert sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(x["embedding"], back[x["vec_id"]], strict=True)) == error[x["vec_id"]]


def test_words_of_bytes():
    w = variants.runs(pa.array(["AbÀÿĀ×z ¿q", "", "Ãāé"], pa.large_string()))
    assert [w.names[i].as_py() for i in w.index] == ["abÀÿ", "×z", "q", "Ã", "é"] and w.counts.tolist() == [3, 0, 2]
