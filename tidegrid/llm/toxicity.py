"""Toxicity: a linear classifier over character n-grams, features scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of 4 and 5 characters (code points; white space as a single space, lower
case) that it holds, present or not. A feature's value is its log-count ratio between toxic and other training texts; a
logistic regression over these values gives the score. Ratios near zero leave a feature with little weight, so a
long clean text isn't carried away by its length, and a few toxic words in it aren't drowned. Every n-gram of three
or more training texts takes part: those of languages with few toxic texts have small ratios.

Training data: labelled rows outside the held-out fold, at most ``most_toxic`` and ``most_other`` of them by the
least hash of doc_id, and of these as many as hold ``most_features`` features together. Only their ids are sent to
the executors and only their feature numbers come back, so training is bounded by these parameters; documents are
scored in one scan without a shuffle.

Edge cases: null or empty text = the model's constant (0 to 1); labels with nulls are left out; without a label of
either class every score is 0; repeated labels count once; equal texts get equal scores; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import give_back, id_and_text, mix64, steps, texts_of, written

BITS = 20
LENGTHS = (4, 5)
#: Gradient steps of a fit, parts of the training rows for calibration, and what a toxic row weighs in it. Steps and
#: weight are those with the highest recall at 0.7 and at most 0.5 % false alarms by cross-validation on sf0.1's training rows.
ROUNDS, FOLDS, WEIGHT = 200, 3, 4.0


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The feature number of every n-gram of every text, and the text's number; repeats included."""
    low = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"\s+", replacement=" ")
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    # A space at both ends of each text.
    data = f" {'  '.join(low.to_pylist())} ".encode("utf-32-le") if len(low) else b""
    x = np.frombuffer(data, "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, who = [], []
    for n in LENGTHS:
        m = max(0, len(x) - n + 1)
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + x[k : k + m]
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        out.append((mix64(code[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
        who.append(owner[:m][inside])
    return np.concatenate(out), np.concatenate(who)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", 1 << 20):
        feature, who = ngrams(texts_of(batch))
        both = np.unique(who << BITS | feature)
        ends = np.searchsorted(both >> BITS, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(both & ((1 << BITS) - 1), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["label", "key", "features"])


@dataclass(frozen=True)
class Model:
    """``weights`` by feature number (ratio times coefficient; zero for most) and the constant."""

    weights: np.ndarray
    constant: float


def _blocks(ends: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows with about ``most`` features, so that little is held beside the features themselves."""
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + most, most), side="right") - 1).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _by_row(of_feature: np.ndarray, ends: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The sum over each row's features."""
    sums, some = np.zeros(len(ends) - 1), np.diff(ends) > 0
    for i, j in _blocks(ends):
        starts = ends[i:j][some[i:j]]
        if len(starts):
            sums[i:j][some[i:j]] = np.add.reduceat(of_feature[features[ends[i] : ends[j]]], starts - ends[i], dtype=np.float64)
    return sums


def _by_feature(of_row: np.ndarray, ends: np.ndarray, features: np.ndarray, size: int) -> np.ndarray:
    """The sum over the rows that hold each feature, block by block: no second copy of the features in another order."""
    sums, counts = np.zeros(size), np.diff(ends)
    for i, j in _blocks(ends):
        sums += np.bincount(features[ends[i] : ends[j]], np.repeat(of_row[i:j], counts[i:j]), size)
    return sums


def _rows_of(keep: np.ndarray, ends: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(ends)
    return np.concatenate([[0], np.cumsum(counts[keep])]), features[np.repeat(keep, counts)]


def regression(labels: np.ndarray, ends: np.ndarray, features: np.ndarray, rounds: int, strength: float) -> Model:
    """The model for rows whose distinct features lie at ends[i] to ends[i + 1], as the fit leaves it."""
    size = 1 << BITS
    toxic = labels == 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model(np.zeros(size, np.float32), -100.0)
    y = toxic.astype(float)
    in_toxic, in_other = _by_feature(y, ends, features, size), _by_feature(1 - y, ends, features, size)
    smooth = max(0.002, 1 / n1)
    used = in_toxic + in_other >= 3
    ratio = np.log((in_toxic[used] / n1 + smooth) / (in_other[used] / n0 + smooth))
    keep = used[features]
    number, ends = np.cumsum(used, dtype=np.int32) - 1, np.concatenate([[0], np.cumsum(_by_row(used, ends, features).astype(np.int64))])
    col = features[keep].astype(np.int32, copy=False)
    del keep
    np.take(number, col, out=col, mode="clip")
    # Accelerated gradient descent with the step that the features' mean square allows.
    lipschitz = 0.25 * max(1.0, float(_by_row(ratio * ratio, ends, col).mean())) + strength
    w, b = np.zeros(len(ratio)), float(np.log(n1 / n0))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = _by_row(ratio * v, ends, col) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        w_new = v - (ratio * _by_feature(g, ends, col, len(ratio)) / len(y) + strength * v) / lipschitz
        b_new = vb - g.mean() / 0.25 / 4
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    weights = np.zeros(size, np.float32)
    weights[used] = w * ratio
    return Model(weights, float(b))


def calibration(z: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and constant that make sigmoid(slope * z + constant) the share of toxic rows (Platt's targets, Newton steps)."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (p - target))
        while np.abs(move).max() > 1e-9 and loss(w - move) > loss(w):
            move = move / 2
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit_rows(labels: np.ndarray, ends: np.ndarray, features: np.ndarray, rounds: int = ROUNDS, strength: float = 1e-3) -> Model:
    """The regression on all rows, its scores calibrated on rows left out of the fit (``FOLDS`` parts; equal texts are in one part).

    0.7 then means odds of 0.7 to 0.3 where a toxic text counts ``WEIGHT`` times."""
    model, toxic = regression(labels, ends, features, rounds, strength), labels == 1
    own = mix64(_by_row(np.arange(1 << BITS), ends, features).astype(np.uint64)) % np.uint64(FOLDS)
    if any(len(np.unique(toxic[own != k])) < 2 or not (own == k).any() for k in range(FOLDS)):
        return model
    z = np.zeros(len(labels))
    for k in range(FOLDS):
        part = regression(labels[own != k], *_rows_of(own != k, ends, features), rounds, strength)
        z[own == k] = _by_row(part.weights, *_rows_of(own == k, ends, features)) + part.constant
    slope, constant = calibration(z, toxic)
    return Model((model.weights * slope).astype(np.float32), model.constant * slope + constant + float(np.log(WEIGHT)))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_other: int = 3000, most_features: int = 20_000_000) -> Model:
    """labels: doc_id and label (0 or 1), the rows that may be learnt from."""
    labels = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    order = F.xxhash64("doc_id")
    chosen = labels.where("label = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(labels.where("label = 0").orderBy(order, "doc_id").limit(most_other))
    # At most most_toxic + most_other rows of 12 bytes; where ids repeat, one text of each.
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("label", F.xxhash64("doc_id").alias("key"), "text")
    rows = written(rows.mapInArrow(_present, "label int, key long, features array<int>").groupBy("label", "key").agg(F.min("features").alias("features")), "features")
    sizes = rows.select("label", "key", F.size("features").alias("n")).toPandas().sort_values(["key", "label"])
    # Rows of both labels by the least hash, as far as the bound goes.
    within = sizes[sizes["n"].cumsum() <= most_features]
    last = int(within["key"].max()) if len(within) else 0
    table = rows.where(F.col("key") <= last).toArrow().sort_by([("key", "ascending"), ("label", "ascending")]) if len(within) else rows.limit(0).toArrow()
    label, counts, features = table["label"].to_numpy(), pc.list_value_length(table["features"]).to_numpy(), pc.list_flatten(table["features"]).to_numpy()
    del table  # one copy stays in the driver
    give_back()
    return fit_rows(label, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), features)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    feature, who = ngrams(texts)
    # n-grams lie by length, then by text. A text's first of each feature counts: the one that wrote its place last, backwards.
    turn = int(np.argmax(np.diff(who) < 0)) + 1 if len(who) > 1 and (np.diff(who) < 0).any() else len(who)
    cuts = np.arange(len(texts) + 1)
    ends = np.searchsorted(who[:turn], cuts), turn + np.searchsorted(who[turn:], cuts)
    place, z = np.zeros(1 << BITS, np.int32), np.full(len(texts), model.constant)
    for i in range(len(texts)):
        own = np.concatenate([feature[e[i] : e[i + 1]] for e in ends])
        number = np.arange(len(own), dtype=np.int32)
        place[own[::-1]] = number[::-1]
        z[i] += model.weights[own[place[own] == number]].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, constant = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        own = Model(weights, constant)
        for batch in steps(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(own, texts_of(batch)))], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id) -> object:
    """True for a third of all ids, which are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted; ``labels`` has doc_id and toxic."""
    train = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    out = scored(docs, fit(docs, train))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    ``learn_from``: the documents whose labelled rows are learnt from, where ``docs`` is only a part of them."""
    from tidegrid.llm.common import passed

    train = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs if learn_from is None else learn_from, train)
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.constant))

    def verdict():
        at, values, constant = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        return lambda texts: score_texts(Model(weights, constant), texts) < threshold

    return passed(docs, verdict)
