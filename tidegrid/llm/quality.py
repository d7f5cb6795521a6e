"""Quality classifier without hand labels: overlapping heuristic labellers, weighed by expectation-maximisation.

Each labeller votes good, bad or abstains on a document. Expectation-maximisation estimates how often each votes
what on good and on bad documents, and with that the probability that a document is good. It needs only how
often each pattern of votes occurs, so it sees every document while the driver holds at most 3 to the power of
the labellers' number of counts. The probabilities then train a linear scorer over hashed features of the text
(shapes of words, short words, repeats), which also tells apart documents on which the labellers abstain. Words of
more than ``PIECE`` characters have a shape for each piece of that length, and count as many times.

Scale: one scan counts patterns, one reads the training sample (at most ``sample`` documents by the least hash
of doc_id and text, a parameter), one scores; nothing is shuffled but the patterns' counts and the sample's vectors.

Edge cases: null or empty text = no words, score from the constant alone and rejected by rule (nothing to keep);
equal texts get equal rows; an empty table gives an empty result; a corpus on which all labellers agree leaves
the scorer at that verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Words, duplicate_lines, hash_names, id_and_text, repeats, spread, steps, texts_of, written

BITS = 10
#: Texts that are measured at once, and texts whose features are held at once (a row of 2 ** BITS numbers each).
ROWS, HELD = 1000, 128
#: Characters of a word that make one shape.
PIECE = 64
#: Documents with a score below this are rejected.
THRESHOLD = 0.1
BAD, GOOD, NONE = 0, 1, 2
#: (name, share at or below which it votes good, share at or above which it votes bad, words it needs)
RISING = [
    ("symbols", 0.02, 0.3, 1),
    ("repeated_trigrams", 0.15, 0.5, 50),
    ("same_word_again", 0.02, 0.2, 10),
    ("duplicate_lines", 0.1, 0.4, 50),
    ("other_than_letters", 0.12, 0.25, 1),
    ("bare_punctuation", 0.03, 0.2, 10),
]
#: (name, range in which it votes good, range outside of which it votes bad, words it needs)
BETWEEN = [
    ("sentence_words", (3, 40), (1.5, 120), 20),
    ("short_words", (0.12, 0.7), (0.04, 0.95), 20),
    ("distinct_words", (0.35, 1.01), (0.15, 1.01), 30),
]
_RUN = re.compile(r"(.)\1+")


class _Classes(dict):
    """Characters as A, a or 0 by their kind; others as they are. Filled as they turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


_CLASSES = _Classes()


class Features:
    """Vote patterns and hashed features of a batch of texts."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.n = n = words.counts
        names = words.names.to_pylist()
        owner, many = words.owner(), np.maximum(n, 1)
        share = lambda of_name: np.bincount(owner, of_name[words.index], len(n))
        chars = pc.utf8_length(words.names).to_numpy(zero_copy_only=False).astype(float)
        classes = [w.translate(_CLASSES) for w in names]
        letters = np.fromiter((c.count("a") + c.count("A") for c in classes), float, len(names))
        again = (words.index[1:] == words.index[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][again], minlength=len(n)) / many
        ends = share(np.fromiter((w.endswith((".", "!", "?", ";", ":")) for w in names), float, len(names)))
        repeated = repeats(words) / many
        lines = np.maximum(pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1, 1)
        distinct = np.bincount(np.unique(owner * max(1, len(names)) + words.index) // max(1, len(names)), minlength=len(n))
        self.measures = {
            "symbols": pc.count_substring_regex(texts, r"[#*$%&|<>{}\\^~]").to_numpy(zero_copy_only=False) / many,
            "repeated_trigrams": repeated,
            "same_word_again": again,
            "duplicate_lines": duplicate_lines(texts) / lines,
            "other_than_letters": 1 - share(letters) / np.maximum(share(chars), 1),
            "bare_punctuation": share((letters == 0) & (chars > 0)) / many,
            "sentence_words": n / (ends + 1),
            "short_words": share((chars <= 3).astype(float)) / many,
            "distinct_words": distinct / many,
        }
        votes = [np.where(n < 3, NONE, GOOD) * (n > 0)]  # by length: an empty text is bad
        for name, good, bad, least in RISING:
            m = self.measures[name]
            votes.append(np.where(n < least, NONE, np.where(m <= good, GOOD, np.where(m >= bad, BAD, NONE))))
        for name, good, bad, least in BETWEEN:
            m = self.measures[name]
            inside, outside = (m >= good[0]) & (m <= good[1]), (m < bad[0]) | (m > bad[1])
            votes.append(np.where(n < least, NONE, np.where(inside, GOOD, np.where(outside, BAD, NONE))))
        self.pattern = sum(v.astype(np.int64) * 3**k for k, v in enumerate(votes))
        self.hashed = (names, classes, owner, words.index, many, again, repeated)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Hashed features (shares of word shapes and of short words, and the two kinds of repeats) of ``HELD`` texts
        after another, with the number of the first."""
        names, classes, owner, index, many, again, repeated = self.hashed
        keep, size = np.uint64((1 << BITS) - 1), 1 << BITS
        hashed = lambda ws, seed: (hash_names(pa.array(ws, pa.large_string()), seed) & keep).astype(np.int64)
        shapes = lambda cs: hashed([_RUN.sub(r"\1", c) for c in cs], 1)
        shape, short = shapes([c[:PIECE] for c in classes]), hashed([w.lower() if len(w) <= 3 else "" for w in names], 2)
        # The pieces of long words behind the first; with them, a text's shapes are shares of all its pieces.
        further = np.fromiter((max(0, len(c) - 1) // PIECE for c in classes), np.int64, len(classes))
        behind = shapes([c[k : k + PIECE] for c in classes if len(c) > PIECE for k in range(PIECE, len(c), PIECE)]) if further.any() else None
        begin = np.cumsum(further) - further
        ends = np.searchsorted(owner, np.arange(len(many) + 1))
        for at in range(0, len(many), HELD):
            n = min(HELD, len(many) - at)
            own = slice(ends[at], ends[at + n])
            place, word = (owner[own] - at) * size, index[own]
            counts = lambda both, n=n: np.bincount(both, minlength=n * size).reshape(n, size)
            x, pieces = counts(place + shape[word]).astype(float), many[at : at + n].astype(float)
            if behind is not None:
                who, which = np.repeat(place, further[word]), spread(further[word], begin[word])
                x += counts(who + behind[which])
                pieces = pieces + np.bincount(who // size, minlength=n)
            x /= pieces[:, None]
            x += counts(place + short[word]) / many[at : at + n, None]
            np.sqrt(x, out=x)
            x[:, 0], x[:, 1] = np.sqrt(again[at : at + n]), np.sqrt(repeated[at : at + n])
            yield at, x

    @property
    def x(self) -> np.ndarray:
        """The features of all texts at once, for a few."""
        return np.concatenate([np.zeros((0, 1 << BITS)), *(x for _, x in self.blocks())])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The scorer's value of each text; ``weights``: coefficients and, last, the constant."""
        z = np.empty(len(self.n))
        for at, x in self.blocks():
            z[at : at + len(x)] = x @ weights[:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


LABELLERS = 1 + len(RISING) + len(BETWEEN)


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(LABELLERS) % 3


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of good and ``vote``[class, labeller, vote] = how often a labeller that votes casts it on a class.

    Abstaining says nothing about the class: short texts, on which most abstain, aren't bad for that."""

    prior: float
    vote: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = votes_of(patterns)
        logs = np.log(self.vote[:, np.arange(LABELLERS), votes]).sum(2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[BAD] - logs[GOOD], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right when it doesn't abstain."""
        return self.prior * self.vote[GOOD, :, GOOD] + (1 - self.prior) * self.vote[BAD, :, BAD]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation from the labellers' majority; bad votes count double there, as most abstain from them."""
    votes = votes_of(patterns)
    good = (votes == GOOD).sum(1) + 0.5
    bad = 2 * (votes == BAD).sum(1) + 0.5
    p = good**2 / (good**2 + bad**2)
    p = np.where((votes == BAD).sum(1) >= 2, np.minimum(p, 0.1), p)
    for _ in range(rounds):
        prior = float(np.clip((p * counts).sum() / max(counts.sum(), 1), 0.01, 0.99))
        vote = np.empty((2, LABELLERS, 3))
        for c, weight in ((BAD, (1 - p) * counts), (GOOD, p * counts)):
            for v in (BAD, GOOD):
                vote[c, :, v] = ((votes == v) * weight[:, None]).sum(0) + (1.0 if v == c else 0.5)
        vote[:, :, :NONE] /= vote[:, :, :NONE].sum(2, keepdims=True)
        vote[:, :, NONE] = 1
        model = LabelModel(prior, vote)
        p = model.posterior(patterns)
    return model


def fit_scorer(x: np.ndarray, p: np.ndarray, rounds: int = 400, strength: float = 1e-4) -> np.ndarray:
    """Coefficients and constant of a logistic regression on probabilities, both classes weighing the same."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    weight = p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9)
    weight /= weight.sum()
    step = 1 / (0.25 * float((weight * (x * x).sum(1)).sum() + 1) + strength)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ v, -50, 50))) - p)) + strength * v
        new, t_new = v - step * g, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def pattern_counts(docs: DataFrame) -> DataFrame:
    """pattern and n: how many documents get each pattern of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 2 << 20, ROWS):
            pattern, n = np.unique(Features(texts_of(batch)).pattern, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

    return id_and_text(docs).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = 5000) -> Model:
    """``sample``: texts that the scorer learns from, those with the least hash of doc_id and text."""
    counts = pattern_counts(docs).toPandas().sort_values("pattern")
    labels = fit_labels(counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(float))
    d = id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    # At most ``sample`` numbers go out; a vector of a fixed size comes back for each, however often its row repeats.
    # Keys are spread evenly, so those under a bound with room for twice the sample are enough, unless rows repeat.
    share = 2 * sample / max(1.0, float(counts["n"].sum()))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    keys = written(d.select("key").where(F.col("key") <= bound).distinct().orderBy("key").limit(sample), "keys")
    if share < 1 and keys.count() < sample:
        keys = d.select("key").distinct().orderBy("key").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 2 << 20, ROWS):
            f = Features(texts_of(batch))
            x = pa.array([r.astype("<f4").tobytes() for _, block in f.blocks() for r in block], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.pattern), x], names=["key", "pattern", "x"])

    found = d.join(F.broadcast(keys), "key").mapInArrow(run, "key long, pattern long, x binary")
    rows = found.groupBy("key").agg(F.first("pattern").alias("pattern"), F.first("x").alias("x")).toArrow().sort_by("key")
    x = np.array([np.frombuffer(b, "<f4") for b in rows["x"].to_pylist()], float).reshape(-1, 1 << BITS)
    return Model(labels, fit_scorer(x, labels.posterior(rows["pattern"].to_numpy().astype(np.int64))))


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, votes_good, votes_bad, posterior, score and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches, "text", 2 << 20, ROWS):
            f = Features(texts_of(batch))
            votes = votes_of(f.pattern)
            score = f.scores(own.weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(f.n), pa.array((votes == GOOD).sum(1), pa.int32()), pa.array((votes == BAD).sum(1), pa.int32()), pa.array(own.labels.posterior(f.pattern)), pa.array(score), pa.array((score >= threshold) & (f.n > 0))],
                names=["doc_id", "n_words", "votes_good", "votes_bad", "posterior", "score", "kept"],
            )

    schema = "doc_id long, n_words long, votes_good int, votes_bad int, posterior double, score double, kept boolean"
    return id_and_text(docs).mapInArrow(run, schema)


def kept(docs: DataFrame, sample: int = 5000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier fitted on them keeps, with all their columns."""
    from tidegrid.llm.common import passed

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample).weights)

    def verdict():
        def judge(texts: pa.Array) -> np.ndarray:
            f = Features(texts)
            return (f.scores(shared.value) >= threshold) & (f.n > 0)

        return judge

    return passed(docs, verdict)
