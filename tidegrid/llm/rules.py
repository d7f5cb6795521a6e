"""Quality rules: counts by rule, then a hashed n-gram likelihood ratio between trusted and raw text.

Tokens are runs of word characters, lower-cased, and runs of other characters but white space. Token unigrams
and bigrams are hashed into a fixed number of buckets. All documents give the raw multinomial, all trusted
documents the target's; a text's ratio is the mean over its n-grams of log(target / raw), so its length doesn't
matter, and a document passes when that mean reaches a fixed threshold. Which documents are trusted is a table
of doc_ids.

Scale: raw text is counted where it is read, without a join; the target's counts come from a join with the trusted
ids, before which a Bloom filter of those ids leaves out nearly all other texts, so what is shuffled is the trusted
text. A task sends one vector of counts, summed by slice of the vector; scoring is one scan with a table of bucket
weights whose size is a parameter. Nothing depends on an order, so results repeat.

Edge cases: null or empty text = no words and base_failed; a text with words but no token pair is judged by its
unigrams; without trusted documents every text that passes the base rules is kept; equal texts get equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Words, among, bloom_of, duplicate_lines, hash_names, id_and_text, mix64, repeats, spread, squeeze, steps, texts_of, unsqueeze

BITS, SLICES = 18, 16
#: Parts that tasks' counts of one slice are merged in at first.
PARTS = 16
#: Mean log ratio below which a document is dropped.
THRESHOLD = -0.1
MIN_WORDS = 50
#: Tokens of the raw corpus that the target's counts are smoothed with.
PRIOR = 1 << 17
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class NgramBuckets:
    """``bucket`` of each unigram and bigram of a batch and ``owner``, its document."""

    def __init__(self, words: Words):
        tokens = [_TOKEN.findall(w.lower()) for w in words.names.to_pylist()]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = hash_names(pa.array([x for t in tokens for x in t], pa.large_string()))
        of_word = sizes[words.index]
        seq = flat[spread(of_word, (np.cumsum(sizes) - sizes)[words.index])]
        owner = np.repeat(words.owner(), of_word)
        with np.errstate(over="ignore"):
            pair = mix64(seq[:-1] * np.uint64(0x9E3779B97F4A7C15) + seq[1:])
        inside = owner[:-1] == owner[1:]
        shift = np.uint64(64 - BITS)
        self.bucket = np.concatenate([mix64(seq) >> shift, pair[inside] >> shift]).astype(np.int64)
        self.owner = np.concatenate([owner, owner[:-1][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in steps(batches):
        total += np.bincount(NgramBuckets(Words(texts_of(batch))).bucket, minlength=1 << BITS)
    part = TaskContext.get().partitionId() % PARTS
    for k, own in enumerate(np.split(total, SLICES)):
        if own.any():
            yield _slice(k, part, own)


def _slice(number: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([squeeze(counts)], pa.binary())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of a task, its counts summed as the rows come by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            own = sums.setdefault(number, np.zeros((1 << BITS) // SLICES, np.int64))
            own += unsqueeze(counts.as_py())
    for number, own in sums.items():
        yield _slice(number, 0, own)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all rows of ``text``; the result's size is a parameter.

    Tasks' slices are merged by slice and part first, so that no task sees those of all tasks, then by slice."""
    schema, out = "slice int, part int, counts binary", np.zeros((SLICES, (1 << BITS) // SLICES))
    parts = texts.select("text").mapInArrow(_count, schema).repartition(4 * PARTS, "slice", "part").mapInArrow(_merge, schema)
    for r in parts.repartition(SLICES, "slice").mapInArrow(_merge, schema).collect():
        out[r["slice"]] = unsqueeze(r["counts"])
    return out.ravel()


def weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, over all documents and all of them whose id is in ``trusted``."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    d = id_and_text(docs)
    # Both sides are shuffled at every size: the trusted ids grow with the corpus, and so would what a broadcast holds.
    own = among(d.where("doc_id is not null"), "doc_id", bloom_of(ids)).join(ids.hint("merge"), "doc_id", "left_semi")
    raw, target = bucket_counts(d), bucket_counts(own)
    if not target.any():
        return np.zeros(1 << BITS)
    prior = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + PRIOR * prior) / (target.sum() + PRIOR) / prior)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and ratio, the mean log ratio."""
    shared = docs.sparkSession.sparkContext.broadcast(weights(docs, trusted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in steps(batches):
            texts = texts_of(batch)
            words = Words(texts)
            n = words.counts
            chars = np.bincount(words.owner(), pc.utf8_length(words.names).to_numpy(zero_copy_only=False)[words.index], len(n)).astype(np.int64)
            repeated = repeats(words)
            failed = (n < MIN_WORDS) | (100 * repeated > 50 * n)
            found = NgramBuckets(words)
            ratio = np.bincount(found.owner, weight[found.bucket], len(n)) / np.maximum(np.bincount(found.owner, minlength=len(n)), 1)
            symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(chars), symbols, pa.array(duplicate_lines(texts)), pa.array(repeated), pa.array(failed), pa.array(~failed & (ratio >= threshold)), pa.array(ratio)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"
    return id_and_text(docs).mapInArrow(run, schema)
