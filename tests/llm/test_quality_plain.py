"""The quality classifier against a version in plain Python, text by text."""

import collections
import math
import re

import numpy as np
import xxhash

from tidegrid.llm import quality, queries
from tidegrid.llm.common import read_table

SF_DIR = "/root/testdata/sf0.001"
RUN = re.compile(r"(.)\1+")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def kind(c):
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def measured(text):
    ws = words_of(text)
    n = len(ws)
    windows = [tuple(ws[k : k + 3]) for k in range(n - 2)]
    often = {w for w, k in collections.Counter(windows).items() if k > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    letters = [sum(kind(c) in "aA" for c in w) for w in ws]
    many, chars = max(n, 1), sum(map(len, ws))
    return n, {
        "symbols": sum(c in r"#*$%&|<>{}\^~" for c in text) / many, "repeated_trigrams": len(covered) / many, "same_word_again": sum(a == b for a, b in zip(ws, ws[1:])) / many,
        "duplicate_lines": (len(lines) - len(set(lines))) / (text.count("\n") + 1), "other_than_letters": 1 - sum(letters) / max(chars, 1), "bare_punctuation": sum(k == 0 for k in letters) / many,
        "sentence_words": n / (sum(w.endswith((".", "!", "?", ";", ":")) for w in ws) + 1), "short_words": sum(len(w) <= 3 for w in ws) / many, "distinct_words": len(set(ws)) / many,
    }


def votes(text):
    n, m = measured(text)
    out = [quality.BAD if n == 0 else quality.NONE if n < 3 else quality.GOOD]
    for name, good, bad, least in quality.RISING:
        out.append(quality.NONE if n < least else quality.GOOD if m[name] <= good else quality.BAD if m[name] >= bad else quality.NONE)
    for name, (a, b), (c, d), least in quality.BETWEEN:
        out.append(quality.NONE if n < least else quality.GOOD if a <= m[name] <= b else quality.BAD if not c <= m[name] <= d else quality.NONE)
    return out


def features(text):
    n, m = measured(text)
    size = 1 << quality.BITS
    shape, short, pieces = collections.Counter(), collections.Counter(), 0
    for w in words_of(text):
        classes = "".join(map(kind, w))
        for k in range(0, len(classes), quality.PIECE):
            shape[xxhash.xxh3_64_intdigest(RUN.sub(r"\1", classes[k : k + quality.PIECE]).encode(), 1) % size] += 1
            pieces += 1
        short[xxhash.xxh3_64_intdigest((w.lower() if len(w) <= 3 else "").encode(), 2) % size] += 1
    x = [math.sqrt(shape[k] / max(pieces, 1) + short[k] / max(n, 1)) for k in range(size)]
    x[0], x[1] = math.sqrt(m["same_word_again"]), math.sqrt(m["repeated_trigrams"])
    return x


def posterior(row, prior, vote):
    good, bad = prior, 1 - prior
    for k, v in enumerate(row):
        if v != quality.NONE:
            good, bad = good * vote[quality.GOOD][k][v], bad * vote[quality.BAD][k][v]
    return good / (good + bad)


def plain_em(rows, rounds=100):
    """The probability that each row's text is good, from the votes alone."""
    p = []
    for row in rows:
        g, b = row.count(quality.GOOD) + 0.5, 2 * row.count(quality.BAD) + 0.5
        own = g * g / (g * g + b * b)
        p.append(min(own, 0.1) if row.count(quality.BAD) >= 2 else own)
    for _ in range(rounds):
        prior = min(max(sum(p) / len(p), 0.01), 0.99)
        vote = {}
        for c, weights in ((quality.BAD, [1 - x for x in p]), (quality.GOOD, p)):
            vote[c] = []
            for k in range(len(rows[0])):
                own = [sum(w for w, row in zip(weights, rows) if row[k] == v) + (1.0 if v == c else 0.5) for v in (quality.BAD, quality.GOOD)]
                vote[c].append([x / sum(own) for x in own])
        p = [posterior(row, prior, vote) for row in rows]
    return p


def test_every_document_against_plain_python(spark):
    docs = read_table(spark, SF_DIR, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = {i: votes(t) for i, t in texts.items()}
    p = dict(zip(rows, plain_em(list(rows.values())), strict=True))
    weights = quality.fit(docs).weights
    got = {r["doc_id"]: r for r in queries.op5_weak_label_quality(spark, SF_DIR).collect()}
    assert got.keys() == texts.keys() and len({r["kept"] for r in got.values()}) == 2
    for i, text in texts.items():
        z = float(np.dot(features(text), weights[:-1]) + weights[-1])
        score = 1 / (1 + math.exp(-min(max(z, -50), 50)))
        r = got[i]
        assert (r["n_words"], r["votes_good"], r["votes_bad"]) == (len(words_of(text)), rows[i].count(quality.GOOD), rows[i].count(quality.BAD))
        assert abs(r["posterior"] - p[i]) < 1e-6 and abs(r["score"] - score) < 1e-6 and r["kept"] == (score >= quality.THRESHOLD and len(words_of(text)) > 0)


def test_scorer_against_plain_gradient_steps():
    r = np.random.RandomState(1)
    x, p = r.rand(30, 4), r.rand(30)
    w = quality.fit_scorer(x, p, rounds=5000, strength=1e-4)
    weight = p / p.sum() + (1 - p) / (1 - p).sum()
    weight /= weight.sum()
    slope = [sum(weight[k] * (1 / (1 + math.exp(-(x[k] @ w[:-1] + w[-1]))) - p[k]) * ([*x[k], 1.0][j]) for k in range(30)) + 1e-4 * w[j] for j in range(5)]
    assert max(map(abs, slope)) < 1e-6  # the minimum of the loss
