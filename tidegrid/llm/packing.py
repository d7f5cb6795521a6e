"""Best-fit packing of token sequences, certified by dual-feasible-function lower bounds.

Documents become pieces of at most ``capacity`` tokens; a full piece is a sequence by itself. The others are
dealt evenly over partitions, each of which packs its own by best fit decreasing and compares its number of
sequences with a lower bound: the largest sum of u(length) over a family of dual feasible functions u
(functions for which any lengths that fit a sequence sum to 1 at most). A partition that meets its bound is
certified. Partitions with a gap hand over the pieces of all their sequences (in the first ``rounds``), others and
later ones those of their emptiest sequences (``exchanged``: what a partition loses is its last, nearly empty one);
these are dealt anew over fewer partitions, and best fit decreasing runs again. Rounds end when all sequences
together meet the bound of all pieces together, or with the round that has one partition, which holds some thousand
sequences at most. Lengths alone move, never texts or ids.

The result says what was reached: ``n_sequences`` and ``bound`` (of the whole table, from the histogram of
lengths) and ``certified`` (the piece's sequence lies in a partition that met its own bound in its last round).

Scale: a partition of the first round holds about ``per_partition`` pieces (24-byte rows) whatever the corpus; each
later round has a quarter of the partitions at most and sees only what was handed over. The driver gets two numbers
a round and the histogram, at most ``capacity`` rows.

Edge cases: null text = the end id alone, one piece; equal rows are packed apart; an empty table gives an empty
result; a document above capacity is cut so that only its first piece is shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import give_back, id_and_text, steps, texts_of, written
from tidegrid.llm.pieces import TokenizerCodec, with_end

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
PACKED = "place long, sequence_id long, offset long, certified boolean"


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions over the lengths' histogram.

    For a threshold t <= capacity / 2: lengths above capacity - t count 1, those below t count 0, others their
    share. For a whole number k: x counts floor((k + 1) x / capacity) / k unless (k + 1) x / capacity is whole,
    then x / capacity. ``counts``: how often each length occurs.
    """
    if not len(lengths):
        return 0
    sizes, n = np.unique(lengths, return_counts=True) if counts is None else (lengths, counts)
    best = -(-int((sizes * n).sum()) // capacity)
    for t in {0, *sizes[sizes <= capacity // 2].tolist()}:
        large = int(n[sizes > capacity - t].sum())
        middle = (sizes >= t) & (sizes <= capacity - t)
        best = max(best, large + -(-int((sizes[middle] * n[middle]).sum()) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        counted = np.where(whole, sizes * k, (scaled // capacity) * capacity)  # in units of 1 / (capacity k)
        best = max(best, -(-int((counted * n).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit decreasing: the sequence and the offset of each piece, and the number of sequences.

    Sequences with the same remaining room form a stack; a bit set of the rooms that have one finds the
    tightest that still holds a length.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count, values = 0, 0, lengths.tolist()
    for i in order:
        size = values[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_, count = capacity, count, count + 1
        bins[i], offsets[i] = bin_, capacity - room
        left = room - size
        if left:
            stacks[left].append(bin_)
            rooms |= 1 << left
    return bins, offsets, count


def _pieces(tokenizer: str, spaced: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TokenizerCodec(tokenizer, spaced)
        place, batch, docs = TaskContext.get().partitionId() << 33, None, None
        for batch in steps(batches):
            docs = batch.column(0)
            for ids, counts in codec.encoded(texts_of(batch)):
                ids, counts = with_end(ids, counts, end_id)
                n = -(-counts // capacity)
                number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                first = counts - (n - 1) * capacity
                lengths = np.where(number == 0, np.repeat(first, n), capacity)
                starts = np.where(number == 0, 0, np.repeat(first, n) + (number - 1) * capacity)
                ends = np.cumsum(lengths).tolist()  # pieces follow one another in the ids
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends, lengths.tolist(), strict=True)]
                owner = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [docs.take(owner), pa.array(number.astype(np.int32)), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(np.arange(place, place + len(number)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "place"],
                )
                place += len(number)
                docs = docs.slice(len(n))
        del codec, batch, docs
        give_back()

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, spaced: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, place (any unique number) of every piece, as a written table."""
    return written(id_and_text(docs).mapInArrow(_pieces(tokenizer, spaced, end_id, capacity), PIECE_SCHEMA), "pieces")


def _packed(capacity: int, first_id: int):
    schema = "place long, length long, sequence_id long, offset long, fill long, n_sequences long, bound long, emptiest long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).select(["place", "length"]).sort_by("place")
        lengths = table["length"].to_numpy().astype(np.int64)
        bins, offsets, count = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths, count).astype(np.int64)
        rank = np.empty(count, np.int64)
        rank[np.argsort(fill, kind="stable")] = np.arange(count)
        added = [bins + (first_id + (TaskContext.get().partitionId() << 32)), offsets, fill[bins], np.full(len(bins), count), np.full(len(bins), lower_bound(lengths, capacity)), rank[bins]]
        for name, values in zip(("sequence_id", "offset", "fill", "n_sequences", "bound", "emptiest"), added, strict=True):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    return run, schema


def pack(lengths: DataFrame, capacity: int = 2048, per_partition: int = 20_000, exchanged: int = 64, rounds: int = 3) -> DataFrame:
    """place, sequence_id, offset, certified, n_sequences and bound for rows of place and length (1 to capacity)."""
    spark = lengths.sparkSession
    histogram = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("length")  # capacity rows at most
    sizes, n_of = histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    bound, n_full = lower_bound(sizes, capacity, n_of), int(n_of[sizes >= capacity].sum())
    full = lengths.where(F.col("length") >= capacity).select("place", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    done, total = [full], n_full
    open_, n, k = lengths.where(F.col("length") < capacity).select("place", "length"), int(n_of[sizes < capacity].sum()), 0
    parts = -(-n // per_partition)
    while n:
        run, schema = _packed(capacity, (k + 1) << 58)
        packed = written(open_.repartition(parts, F.xxhash64("place", F.lit(k))).mapInArrow(run, schema), "packed")
        made = packed.where("offset = 0").count()
        certified = F.col("n_sequences") <= F.col("bound")
        last = parts == 1 or total + made <= bound
        handed = F.lit(False) if last else (~certified & F.lit(k < rounds)) | (F.col("emptiest") < exchanged) & (F.col("fill") < capacity)
        done.append(packed.where(~handed).select("place", "sequence_id", "offset", certified.alias("certified")))
        total += packed.where(~handed & (F.col("offset") == 0)).count()
        open_ = packed.where(handed).select("place", "length")
        n, k, parts = (0 if last else open_.count()), k + 1, max(1, min(-(-parts // 4), -(-n // per_partition)))
    out = spark.createDataFrame([], PACKED)
    for d in done:
        out = out.unionByName(d)
    return out.withColumns({"n_sequences": F.lit(total).cast("long"), "bound": F.lit(bound).cast("long")})


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, spaced: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; certified, n_sequences, bound (see ``pack``)."""
    made = pieces(docs, tokenizer, end_id, capacity, spaced)
    return made.join(pack(made, capacity), "place").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "n_sequences", "bound")
