"""Substring dedup: words of windows that also start in an earlier document are removed.

A window is ``size`` consecutive words. Every task hashes its windows and deals them by hash range. A range's task
holds the part of the count-min sketch that belongs to its range: first each chunk's sketch (two rows of counters
that stop at two) is merged in by adding; a counter is never too low, so a window whose counters don't all say two
occurs once and is left out, and none that repeats is lost. A second pass over the same chunks groups the windows
estimated repeated exactly, by a hash of 96 bits, and compares them by doc_id; a document's covered words come back
to it as intervals.

Scale: only texts that lose words are shuffled, for the last join (a Bloom filter of them tells which). The number of
ranges follows the corpus (``RANGE_BYTES`` of text each), so what a range's task holds does not; nothing
is broadcast and nothing comes to the driver but the corpus's length. Windows travel as packed arrays, about 14 bytes
each. A chunk sends each window once, with the least doc_id that it has seen it in (later documents of the chunk are
settled at once), so a passage that a third of all documents share makes a row for each chunk, not for each document.
A chunk sends at most ``FAN`` rows, so rows grow with the corpus, not with its square: more ranges than that (some 50 GB
of text) are reached in steps, in which the windows of many chunks in one range are divided into finer ones; each step is
one more shuffle of the windows.
Of n different windows some n * n / 2 ** 97 pairs share a hash: one expected in 10 ** 14 windows is far from reached.

Edge cases: null or empty text = no words; texts under ``size`` words lose nothing; rows of the same doc_id
aren't earlier than each other; a null doc_id counts as later than all; equal rows get equal results; other columns
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Bloom, Words, among, bloom_of, free_names, hash_names_twice, ints_of, squeeze, steps, texts_of, unsqueeze, window_hash, window_starts, written

SIZE, BITS = 13, 23
#: Text of the whole corpus for each hash range: some two million windows.
RANGE_BYTES = 12 << 20
#: Ranges that a chunk's windows are dealt to at once: a row for each of them still holds a hundred windows and more.
FAN = 4096
#: Windows of a task that are grouped at once.
CHUNK = 600_000
#: Text bytes hashed at once.
STEP = 2 << 20
LATEST = (1 << 63) - 1


class Sketch:
    """Two rows of 2 ** bits counters that stop at two, as maps of the cells that reached one and two."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.one, self.two = (np.zeros((2, 1 << bits), bool) for _ in range(2))

    def cells(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return [((high ^ low.astype(np.uint64) * np.uint64(odd)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) for odd in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Merges the sketch of one chunk's windows."""
        for row, cells in enumerate(self.cells(high, low)):
            cells = np.sort(cells)
            again = cells[1:][cells[1:] == cells[:-1]]
            self.two[row, cells[self.one[row, cells]]] = True
            self.two[row, again] = True
            self.one[row, cells] = True

    def repeated(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether all counters of a window say two: true for all that repeat, and for few others."""
        first, second = self.cells(high, low)
        return self.two[0, first] & self.two[1, second]


_SENT = "slice int, chunk long, chunks binary, key_high binary, key_low binary, id_of binary, doc binary, pos binary, ids binary, ties binary"
_FOUND = "chunk long, doc binary, pos binary, ids binary, ties binary"


def _row(schema: str, **values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def _send(size: int, slices: int):
    """The chunks' windows, grouped within the chunk and dealt by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[np.ndarray] = []
        ties: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            if held:
                high, low, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                id_of, tie_of = np.concatenate(ids), np.concatenate(ties)
                held.clear()
                order = np.argsort(high, kind="stable")
                high, low, doc, pos = high[order], low[order], doc[order], pos[order]
                close = np.flatnonzero(high[1:] == high[:-1])
                if len(close):  # only windows whose first halves agree need the second and the ids in order
                    some = np.unique(np.concatenate([close, close + 1]))
                    inner = some[np.lexsort((id_of[doc[some]], low[some], high[some]))]
                    low[some], doc[some], pos[some] = low[inner], doc[inner], pos[inner]
                new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, bool)
                own = id_of[doc]
                late = own > own[new][np.cumsum(new) - 1] if len(high) else new
                yield _row(_SENT, slice=chunk % slices, chunk=chunk, doc=squeeze(doc[late]), pos=squeeze(pos[late]), ids=squeeze(id_of), ties=tie_of.astype("<i8").tobytes())
                high, low, doc, pos = high[~late], low[~late], doc[~late], pos[~late]
                where = (high % np.uint64(slices)).astype(np.int64)
                order = np.lexsort((pos, doc, where))
                ends = np.searchsorted(where[order], np.arange(slices + 1))
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    own = order[ends[k] : ends[k + 1]]
                    yield _row(_SENT, slice=k, chunk=chunk, key_high=high[own].astype("<u8").tobytes(), key_low=low[own].astype("<u4").tobytes(), id_of=squeeze(id_of[doc[own]]), doc=squeeze(doc[own]), pos=squeeze(pos[own]))
            chunk += 1
            held.clear(), ids.clear(), ties.clear()

        n = n_docs = 0
        for batch in steps(batches, "text", STEP):
            words = Words(texts_of(batch))
            starts, doc = window_starts(words.offsets, size)
            if len(starts):
                first, second = (h[words.index] for h in hash_names_twice(words.names))
                held.append((window_hash(first, size, 2)[starts], (window_hash(second, size, 3)[starts] >> np.uint64(32)).astype(np.uint32), (doc + n_docs).astype(np.int32), (starts - words.offsets[:-1][doc]).astype(np.int64)))
                n += len(starts)
            else:
                held.append((np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)))
            ids.append(ints_of(batch, "id_key"))
            ties.append(ints_of(batch, "tie"))
            n_docs += batch.num_rows
            if n > CHUNK:
                yield from flush()
                n = n_docs = 0
        yield from flush()

    return run


def _finer(modulus: int, most: int):
    """Rows of ranges, in their order, as rows of the finer ranges that hashes fall into by ``modulus``; windows of many chunks share a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                high, low, ids, doc, pos, chunks = (np.concatenate(x) for x in zip(*held, strict=True))
                where = (high % np.uint64(modulus)).astype(np.int64)
                order = np.lexsort((pos, doc, chunks, where))
                own, ends = np.unique(where[order], return_index=True)
                for k, part in zip(own.tolist(), np.split(order, ends[1:]), strict=True):
                    yield _row(_SENT, slice=k, chunks=squeeze(chunks[part]), key_high=high[part].astype("<u8").tobytes(), key_low=low[part].astype("<u4").tobytes(), id_of=squeeze(ids[part]), doc=squeeze(doc[part]), pos=squeeze(pos[part]))
            held.clear()

        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["key_high"] is None:  # a chunk's heading goes on as it is
                    yield _row(_SENT, **r)
                    continue
                if r["slice"] != last or n > most:
                    yield from flush()
                    last, n = r["slice"], 0
                high = np.frombuffer(r["key_high"], "<u8")
                chunks = np.full(len(high), r["chunk"]) if r["chunks"] is None else unsqueeze(r["chunks"])
                held.append((high, np.frombuffer(r["key_low"], "<u4"), unsqueeze(r["id_of"]), unsqueeze(r["doc"]), unsqueeze(r["pos"]), chunks))
                n += len(high)
        yield from flush()

    return run


def _compare(bits: int):
    """Of one hash range: which of the sent windows also start in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        columns = {c: table[c].to_pylist() for c in table.column_names}
        del table, batches
        asked = [i for i, k in enumerate(columns["key_high"]) if k is not None]
        out = [{k: columns[k][i] for k in ("chunk", "doc", "pos", "ids", "ties")} for i, k in enumerate(columns["key_high"]) if k is None]
        highs = [np.frombuffer(columns["key_high"][i], "<u8") for i in asked]
        lows = [np.frombuffer(columns["key_low"][i], "<u4") for i in asked]
        sketch = Sketch(bits)
        for high, low in zip(highs, lows, strict=True):
            sketch.add(high, low)
        there = [np.flatnonzero(sketch.repeated(high, low)) for high, low in zip(highs, lows, strict=True)]
        if sum(map(len, there)):
            high, low = (np.concatenate([x[t] for x, t in zip(xs, there, strict=True)]) for xs in (highs, lows))
            del highs, lows
            ids = np.concatenate([unsqueeze(columns["id_of"][i])[t] for i, t in zip(asked, there, strict=True)])
            order = np.lexsort((ids, low, high))
            h, w, i = high[order], low[order], ids[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
            late = np.zeros(len(h), bool)
            late[order] = i > i[new][np.cumsum(new) - 1]
            at = 0
            for i, t in zip(asked, there, strict=True):
                own = t[late[at : at + len(t)]]
                at += len(t)
                if len(own):
                    doc, pos = unsqueeze(columns["doc"][i])[own], unsqueeze(columns["pos"][i])[own]
                    chunks = np.full(len(own), columns["chunk"][i]) if columns["chunks"][i] is None else unsqueeze(columns["chunks"][i])[own]
                    cuts = np.flatnonzero(chunks[1:] != chunks[:-1]) + 1  # a row's windows are in order of chunk
                    out += [{"chunk": int(c[0]), "doc": squeeze(d), "pos": squeeze(p), "ids": None, "ties": None} for c, d, p in zip(*(np.split(x, cuts) for x in (chunks, doc, pos)), strict=True)]
        schema = pa.schema([("chunk", pa.int64()), ("doc", pa.binary()), ("pos", pa.binary()), ("ids", pa.binary()), ("ties", pa.binary())])
        yield from pa.Table.from_pylist(out, schema).to_batches()

    return run


def _intervals(size: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        ids, ties = unsqueeze(head["ids"]), np.frombuffer(head["ties"], "<i8")
        place = np.sort(np.concatenate([unsqueeze(r["doc"]) << 40 | unsqueeze(r["pos"]) for r in rows]))
        doc, pos = place >> 40, place & (1 << 40) - 1
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + size)]) if len(doc) else np.zeros(0, bool)
        last = np.concatenate([first[1:], [True]]) if len(doc) else first
        spans = np.stack([pos[first], pos[last] + size], 1).astype("<i8")
        own = doc[first]
        docs, begin = np.unique(own, return_index=True)
        end = np.append(begin, len(own))[1:]
        return pa.table({"id_key": pa.array(ids[docs]), "tie": pa.array(ties[docs]), "spans": pa.array([spans[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())})

    return run


def _keyed(docs: DataFrame) -> list:
    """Two columns that name a row: the doc_id (null as the latest) and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LATEST)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]


def removed_spans(docs: DataFrame, size: int = SIZE, bits: int = BITS, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """id_key, tie, spans: the word intervals (pairs of little-endian 64-bit integers) to remove from a text."""
    id_key, tie = _keyed(docs)
    d = docs.select(id_key.alias("id_key"), tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = max(2, -(-total // range_bytes))
    levels = next(k for k in range(1, 64) if fan**k >= slices)
    base = next(b for b in range(2, fan + 1) if b**levels >= slices) if levels > 1 else slices
    slices = base**levels
    sent = d.mapInArrow(_send(size, base), _SENT)
    for level in range(1, levels):
        # As many tasks as ranges so far hold the parts of every ``base`` chunks, so that none grows with the corpus.
        group = F.pmod(F.xxhash64("chunk", "chunks"), F.lit(base))
        sent = sent.repartition(base ** (level + 1) if base ** (level + 1) < 100_000 else 100_000, "slice", group).sortWithinPartitions("slice").mapInArrow(_finer(base ** (level + 1), CHUNK), _SENT)
    found = sent.repartitionById(slices, F.col("slice")).mapInArrow(_compare(bits), _FOUND)
    spans = found.groupBy("chunk").applyInArrow(_intervals(size), "id_key long, tie long, spans binary")
    return spans.groupBy("id_key", "tie").agg(F.first("spans").alias("spans"))  # rows may be equal


def _without(text: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the other words joined by a space."""
    words = text.split()
    left, at = [], 0
    for a, b in np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist():
        left += words[at:a]
        at = b
    left += words[at:]
    return len(words), len(words) - len(left), b" ".join(left)


def _kept(batches: Iterator[pa.RecordBatch], passes=None) -> Iterator[pa.RecordBatch]:
    """The output rows of texts with spans; ``passes`` says which rows of a batch are this side's."""
    for batch in steps(batches, "text", STEP):
        if passes:
            batch = batch.filter(pa.array(passes(ints_of(batch, "tie"))))
            if not batch.num_rows:
                continue
        texts = texts_of(batch).cast(pa.large_binary()).to_pylist()
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        n_words, n_removed, left = zip(*map(_without, texts, spans), strict=True)
        kept = [rest if n else text for text, n, rest in zip(texts, n_removed, left, strict=True)]
        sha = [hashlib.sha256(x).hexdigest() for x in left]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "id_key", "tie", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def dedup_windows(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text without them; as it was if it loses nothing)."""
    id_key, tie = _keyed(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key.alias("id_key"), tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    theirs = written(removed_spans(docs, size, **options), "spans")
    bloom = bloom_of(theirs.select("tie"))
    shared = docs.sparkSession.sparkContext.broadcast((bloom.bits, bloom.data.tobytes()))
    schema = "doc_id long, id_key long, tie long, n_words long, n_removed long, kept_sha256 string, kept string"

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(*shared.value)
        return _kept(batches, lambda keys: ~own.holds(keys))

    # Rows whose text hash no span has aren't shuffled.
    some = among(d, "tie", bloom).join(theirs, ["id_key", "tie"], "left").select(*d.columns, "spans")
    rest = d.withColumn("spans", F.lit(None).cast("binary"))
    return some.mapInArrow(_kept, schema).unionByName(rest.mapInArrow(others, schema)).drop("id_key", "tie")


def without_repeats(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """The rows and columns of ``docs`` with the covered words taken out of ``text``; other texts stay as they are."""
    columns, (id_key, tie, spans) = docs.columns, free_names(docs, "id_key", "tie", "spans")
    own_id, own_tie = _keyed(docs)
    theirs = written(removed_spans(docs, size, **options).withColumnsRenamed({"id_key": id_key, "tie": tie, "spans": spans}), "spans")
    bloom, keyed = bloom_of(theirs.select(tie)), docs.withColumns({id_key: own_id, tie: own_tie})
    joined = among(keyed, tie, bloom).join(theirs, [id_key, tie], "left").select(*columns, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            new = [_without(t, s)[2] if s else t for t, s in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield batch.set_column(at, "text", pa.array(new, pa.binary()).cast(pa.string())).select(columns)

    # Rows whose text hash no span has are neither shuffled nor changed.
    return joined.mapInArrow(run, docs.schema).unionByName(among(keyed, tie, bloom, held=False).select(*columns))
