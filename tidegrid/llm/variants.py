"""Spelling variants: words of one edit from a much more frequent word, by an index of grams of variable length.

Words are counted over all texts. Their grams of ``QMIN`` to ``QMAX`` characters (with a mark at both ends) are counted
too, and a dictionary keeps those that occur often enough and whose beginning, one character shorter, occurs too often to
make a short list. A word is decomposed into the longest grams of the dictionary at each place (else ``QMIN`` characters),
without those inside others. An edit changes at most ``affected`` of a word's grams: those across it, and those beside it
whose place a longer gram of the dictionary through the edit could take. Two words of one edit share all other grams of
either, so one of the ``affected`` + 1 rarest of each: only these lists are merged, and every pair on one is verified.
Long lists are left to the verification.

Lists are by gram, place (from either end) and length. A list of a gram that occurs more than ``HOT`` times is divided by
what is left of the word without one of its ``PIECES`` pieces, as one edit leaves all others as they are; so lists don't grow
with the corpus. Words so short that an edit may change all their grams (1.5 % on 0.1 GB) could share no list; they meet in
lists of their own, by length and what is left.

Scale: texts are read once; counts are combined before they are shuffled. The dictionary's size has a bound that doesn't
depend on the corpus, as a gram in it makes up a fixed share of all: only it goes to the driver and the tasks. A word
makes some twenty rows; a list is read in order and compared in blocks, never emitted as pairs. Links are combined before
they are shuffled. The forms' ends are found by doubling, in a number of rounds that the largest count bounds.

Edge cases: null, empty or wordless texts have no words; a null doc_id counts as an empty one; equal rows count each;
runs of any length are words; an empty table has no words; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Words, give_back, looked_up, steps, texts_of, written

STEP = 4 << 20
#: Every so many-th occurrence, by its checksum, loses a character; words' least characters and occurrences.
DROP_EVERY, LEAST_CHARS, LEAST_N = 97, 5, 3
QMIN, QMAX = 2, 4
#: A gram that makes up more than one of so many words is too frequent for one list; it's kept in the dictionary from one of so many on.
TOO_MANY, ENOUGH = 1000, 10_000
#: Occurrences of a gram beyond which its lists are divided by what an edit in one of so many pieces leaves of the word.
HOT, PIECES = 5000, 3
#: Words whose lists one task merges, of some twenty each.
WORDS = 30_000
#: Pairs that a task compares at once.
BLOCK = 200_000
#: Characters of a run up to which checksums are shifted, and words compared, many at once.
SHORT = 64
BEGIN, END = "\x02", "\x03"


def _crc_table() -> np.ndarray:
    """The checksum's table for one byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def runs(texts: pa.Array) -> Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased."""
    if not len(texts) or texts.buffers()[2] is None:
        return Words(texts)
    x = np.frombuffer(texts.buffers()[2], np.uint8)
    low = np.where((x >= 65) & (x <= 90), x | 32, x)
    lead = x == 0xC3  # of two bytes, the second of which follows
    real = (low >= 97) & (low <= 122) | lead
    real[1:] |= lead[:-1]
    return Words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(np.where(real, low, 32).astype(np.uint8).tobytes())]))


def _checksums(prefixes: list[bytes], words: Words, names: list[bytes]) -> np.ndarray:
    """crc32 of each text's prefix and each of its runs together: a prefix's checksum is shifted by the run's length."""
    own = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    size = np.fromiter(map(len, names), np.int64, len(names))
    state = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    shifted = [state]
    for _ in range(min(SHORT, int(size.max(initial=0)))):
        shifted.append(shifted[-1] >> np.uint32(8) ^ _CRC[shifted[-1] & np.uint32(255)])
    owner = words.owner()
    out = np.stack(shifted)[np.minimum(size, len(shifted) - 1)[words.index], owner] ^ own[words.index]
    for k in np.flatnonzero(size[words.index] > SHORT).tolist():
        out[k] = zlib.crc32(prefixes[owner[k]] + names[words.index[k]])
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words, after the characters that some occurrences lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            words = runs(texts_of(batch))
            names = words.names.to_pylist()
            chars = pc.utf8_length(words.names).to_numpy(zero_copy_only=False).astype(np.int64)
            h = _checksums([f"{'' if i is None else i}:".encode() for i in batch.column(0).to_pylist()], words, words.names.cast(pa.large_binary()).to_pylist())
            lose = h % np.uint32(DROP_EVERY) == 0
            counts = np.bincount(words.index[~lose], minlength=len(names))
            kept = np.flatnonzero((counts > 0) & (chars >= LEAST_CHARS))
            less: Counter[str] = Counter()
            for k, at in zip(words.index[lose].tolist(), (h[lose] % chars[words.index[lose]]).tolist(), strict=True):
                if chars[k] > LEAST_CHARS:
                    less[names[k][:at] + names[k][at + 1 :]] += 1
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.names.take(pa.array(kept)).cast(pa.string()), pa.array(less.keys(), pa.string())]), pa.array(np.concatenate([counts[kept], np.fromiter(less.values(), np.int64, len(less))]))], names=["word", "n"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def gram_counts(words: DataFrame) -> DataFrame:
    """gram and n: how often each gram of ``QMIN`` to ``QMAX`` characters occurs in the words, marks included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for w in batch.column(0).to_pylist():
                w = f"{BEGIN}{w}{END}"
                for q in range(QMIN, QMAX + 1):
                    found.update(w[k : k + q] for k in range(len(w) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Dictionary:
    """Grams with their counts, and what may begin or end a longer one."""

    def __init__(self, counts: dict[str, int], too_many: float):
        self.counts = counts
        self.grams = {g for g in counts if len(g) == QMIN or counts.get(g[:-1], 0) > too_many}
        self.begins = {g[:k] for g in self.grams for k in range(QMIN, len(g))}
        self.ends = {g[-k:] for g in self.grams for k in range(QMIN, len(g))}

    def decompose(self, w: str) -> list[tuple[int, int]]:
        """Place and end of each gram of a word with its marks; ends rise."""
        out, last, n, grams = [], 0, len(w), self.grams
        for p in range(n - QMIN + 1):
            end = p + QMIN
            for q in range(min(QMAX, n - p), QMIN, -1):
                if w[p : p + q] in grams:
                    end = p + q
                    break
            if end > last:
                out.append((p, end))
                last = end
        return out

    def affected(self, w: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit between the marks may change."""
        n, most, places = len(w), 0, [p for p, _ in grams]
        # First place from which a longer gram may go on at i, and last end to which one may come from before i.
        first, last = [0] * (n + 1), [0] * (n + 1)
        for i in range(n + 1):
            first[i] = next((a for a in range(max(0, i - QMAX + 1), i - QMIN + 1) if w[a:i] in self.begins), i)
            last[i] = next((b for b in range(min(n, i + QMAX - 1), i + QMIN - 1, -1) if w[i:b] in self.ends), i)
        for i in range(1, n):
            f, at, to = first[i], last[i], last[i + 1] if i < n - 1 else 0
            gap = char = 0
            for p, e in grams[bisect_left(places, i - QMAX + 1) : bisect_right(places, i + QMAX)]:  # no other reaches this far
                if (e > i or p >= f) and (p < i or e <= at):
                    gap += 1  # a character comes before i
                if i < n - 1 and (e > i or p >= f) and (p <= i or e <= to):
                    char += 1  # the character at i goes or changes
            most = max(most, gap, char)
        return most


def dictionary_of(words: DataFrame, n_words: int) -> Dictionary:
    """Grams of at least one of ``ENOUGH`` words: their number is bounded by the grams of so many words."""
    often = gram_counts(words).where(F.col("n") * ENOUGH >= n_words).collect()
    return Dictionary({r["gram"]: r["n"] for r in often}, n_words / TOO_MANY)


def _rests(w: str, n: int) -> Iterator[str]:
    """What an edit may leave of a word: all but one of its ``PIECES`` pieces, where the shorter word of a pair has ``n`` characters."""
    for k in range(PIECES):
        behind = n - n * (k + 1) // PIECES
        yield f"<{w[: n * k // PIECES]}|{w[len(w) - behind :]}"


def _keys(w: str, grams: Dictionary, hot: int) -> Iterator[tuple[int, str]]:
    """Role (0: word of the list's length, 1: one character more; 2, 3: the same, where only different lengths meet) and list."""
    marked, n = f"{BEGIN}{w}{END}", len(w)
    parts = grams.decompose(marked)
    affected = grams.affected(marked, parts)
    rare = sorted(parts, key=lambda x: (grams.counts.get(g := marked[x[0] : x[1]], 0), g, x[0]))[: affected + 1]
    for p, e in rare:
        g = marked[p:e]
        divided = grams.counts.get(g, 0) > hot
        for role, size in ((0, n), (1, n - 1)):
            for extra in _rests(w, size) if divided else ("",):
                yield role, f"{size} {p} {g}{extra}"
                yield role + 2, f"{size} -{len(marked) - e} {g}{extra}"
    if len(parts) <= affected:
        for role, size in ((0, n), (1, n - 1)):
            for extra in _rests(w, size):
                yield role, f"{size} {extra}"


def listed(words: DataFrame, grams: Dictionary, hot: int = HOT) -> DataFrame:
    """list (hash), role, word and n: a row for each list that a word is on."""
    import xxhash

    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = shared.value, xxhash.xxh3_64_intdigest
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                part = batch.slice(start, 5000)
                lists, roles, counts = [], [], []
                for w in part.column(0).to_pylist():
                    keys = dict.fromkeys(_keys(w, own, hot))
                    lists += [digest(k) for _, k in keys]
                    roles += [r for r, _ in keys]
                    counts.append(len(keys))
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(lists, np.uint64).view(np.int64)), pa.array(roles, pa.int8()), part.column(0).take(rows), part.column(1).take(rows)], names=["list", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "list long, role byte, word string, n long")


def _one_edit(x: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of the characters ``x``, b as long or one longer, differ by exactly one edit."""
    out = np.zeros(len(a), bool)
    same = size[a] == size[b]
    out[same] = (x[a[same]] != x[b[same]]).sum(1) == 1
    a, b = a[~same], b[~same]
    if len(a):
        begin = np.minimum.accumulate(x[a] == x[b], axis=1)  # alike up to here
        out[~same] = (begin[:, :-1] | (x[a][:, :-1] == x[b][:, 1:])).all(1)
    return out


def _edit_apart(s: str, t: str) -> bool:
    """The same for two long words, the second as long or one character longer."""
    k = len(os.path.commonprefix([s, t]))
    return s[k + 1 :] == t[k + 1 :] and k < len(s) if len(s) == len(t) else s[k:] == t[k + 1 :]


def _matches(lists: np.ndarray, roles: np.ndarray, names: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows on the same list, of words of one edit; rows are in order of list. Each row meets the next, the second next and so on."""
    size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    long = size > SHORT
    held = np.where(long, 0, size)
    width = int(held.max(initial=0)) + 1
    x = np.zeros((len(size), width), np.uint8)  # all characters are in Latin-1; a word ends with zeros
    texts = names.to_pylist()
    data = np.frombuffer("".join(w for w in texts if len(w) <= SHORT).encode("latin-1"), np.uint8)
    x[np.repeat(np.arange(len(size)), held), np.arange(len(data)) - np.repeat(np.cumsum(held) - held, held)] = data
    most = max(1, BLOCK * 16 // width)
    rows, longer = np.arange(len(lists)), roles & 1
    for d in range(1, len(lists)):
        rows = rows[: np.searchsorted(rows, len(lists) - d)]
        rows = rows[lists[rows] == lists[rows + d]]
        if not len(rows):
            return
        for at in range(0, len(rows), most):
            a = rows[at : at + most]
            b = a + d
            # Two longer words meet on the lists of their own length; where lists are by place from the end, only different lengths meet.
            meet = (longer[a] != longer[b]) | (longer[a] == 0) & (roles[a] < 2)
            a, b = a[meet], b[meet]
            a, b = np.where(longer[a] > longer[b], b, a), np.where(longer[a] > longer[b], a, b)
            far = long[a] | long[b]
            fits = np.zeros(len(a), bool)
            fits[~far] = _one_edit(x, size, a[~far], b[~far])
            for k in np.flatnonzero(far).tolist():
                fits[k] = _edit_apart(texts[a[k]], texts[b[k]])
            if fits.any():
                yield a[fits], b[fits]


def near_pairs(words: DataFrame, grams: Dictionary, hot: int = HOT) -> DataFrame:
    """a, b, n_a, n_b: every pair of words of one edit, a before b; once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rest: pa.RecordBatch | None = None

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            names, n = table["word"].combine_chunks(), table["n"].combine_chunks()
            pairs = list(_matches(table["list"].to_numpy(), table["role"].to_numpy(), names))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                code = names.dictionary_encode()
                rank = pc.rank(code.dictionary).to_numpy()[code.indices.to_numpy()]
                a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
                _, once = np.unique(rank[a].astype(np.int64) << 32 | rank[b].astype(np.int64), return_index=True)
                a, b = pa.array(a[once]), pa.array(b[once])
                yield pa.RecordBatch.from_arrays([names.take(a), names.take(b), n.take(a), n.take(b)], names=["a", "b", "n_a", "n_b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            lists = table["list"].to_numpy()
            if not len(lists):
                continue
            last = int(np.searchsorted(lists, lists[-1]))  # the last list may go on
            yield from found(table.slice(0, last))
            rest = table.slice(last).combine_chunks().to_batches()[0]
        if rest is not None:
            yield from found(pa.Table.from_batches([rest]))

    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // WORDS))
    own = listed(words.repartition(parts, "word"), grams, hot)
    pairs = own.repartition(parts, "list").sortWithinPartitions("list").mapInArrow(run, "a string, b string, n_a long, n_b long")
    return pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def roots(forms: DataFrame, most_n: int) -> DataFrame:
    """word and root for rows (word, form): where following forms ends. Counts double at each step, so few steps are enough."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log2(max(2, most_n))))) + 1):
        up = out.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        out = written(looked_up(out, "root", up, "word", how="left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return out


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = written(word_counts(docs), "words")
    n_words, most_n = words.agg(F.count(F.lit(1)), F.max("n")).first()
    pairs = written(near_pairs(words, dictionary_of(words, n_words), hot), "near")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    good = -F.col("best.n") >= 2 * F.col("n")
    linked = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))
    linked = written(linked, "linked")
    ends = roots(linked.where("form is not null"), most_n or 1)
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
