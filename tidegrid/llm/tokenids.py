"""Token ids as binary blocks with Elias-Fano document boundaries.

The corpus is one id array in ascending (doc_id, text hash) order. A block holds the ids of consecutive
documents as little-endian integers of 2 or 4 bytes, their doc_ids, and the documents' end offsets coded by
Elias-Fano: the low bits of each offset packed, the high bits in unary, and a sample of the set bits' places
so that ``select`` finds any offset without a table of 64-bit integers. Blocks are rows of Parquet files, one
file for each range of doc_ids, so any store that Spark writes to can hold them and a lost task is redone.

Scale: texts are encoded where they lie, and their ids, about half as large, go through one range shuffle, into as many
ranges as they are long (``RANGE_BYTES``). A block's place in the whole array is its place in its partition plus the
partitions before it, so only one number a partition is gathered.

Edge cases: null text = the end id alone; null doc_ids come first; equal doc_ids lie side by side ordered by
text; an empty table writes no block and reads back as no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import give_back, id_and_text, steps, texts_of, written
from tidegrid.llm.pieces import TokenizerCodec, with_end

#: Every so many set bits of the high part, one place is kept.
SAMPLE = 128
#: Ids of one range of doc_ids, in bytes.
RANGE_BYTES = 16 << 20
BLOCK_SCHEMA = (
    "part int, block int, start long, n_docs int, n_tokens long, id_bytes int, ids binary, doc_ids binary, no_doc_id binary, "
    "low_bits int, low binary, high binary, samples binary"
)


class EliasFano:
    """A nondecreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        values = values.astype(np.int64)
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        shifts = np.arange(low_bits - 1, -1, -1)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits).tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """The values at the places ``i``, from the sampled places around them on: only that stretch of the high part is counted."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if not len(i):
            return i
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError(int(i.max()))
        samples, high = np.frombuffer(self.samples, "<u4"), np.frombuffer(self.high, np.uint8)
        first, last = int(i.min()) // SAMPLE, int(i.max()) // SAMPLE + 1
        begin = int(samples[first])
        a, b = begin >> 3, (int(samples[last]) >> 3) + 1 if last < len(samples) else len(high)
        stretch = high[a:b].copy()
        stretch[0] &= 0xFF >> (begin & 7)
        ones = np.cumsum(_ONES[stretch])  # set bits up to and with each byte
        rank = i - first * SAMPLE
        byte = np.searchsorted(ones, rank, side="right")
        bit = _PLACE[stretch[byte], rank - (ones[byte] - _ONES[stretch[byte]])]
        upper = ((a + byte) << 3) + bit - i
        if not self.low_bits:
            return upper
        # The low part's bits of a value lie in eight bytes at most (it has fewer than 57).
        at = i * self.low_bits
        data = np.frombuffer(self.low + bytes(8), np.uint8)
        window = np.zeros(len(i), np.uint64)
        for k in range(8):
            window = window << np.uint64(8) | data[(at >> 3) + k]
        lower = (window << (at & 7).astype(np.uint64)) >> np.uint64(64 - self.low_bits)
        return (upper << self.low_bits) + lower.astype(np.int64)


#: By byte: its set bits, and the place of each of them from the left.
_ONES = np.array([x.bit_count() for x in range(256)], np.int64)
_PLACE = np.array([([p for p in range(8) if x >> (7 - p) & 1] + [8] * 8)[:8] for x in range(256)], np.int64)


def _encoded(tokenizer: str, spaced: bool, end_id: int):
    """Texts as binary ids, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, batch = TokenizerCodec(tokenizer, spaced), None
        width = 2 if codec.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in steps(batches):
            ids, counts = with_end(*codec.encode(texts_of(batch)), end_id)
            ends = np.concatenate([[0], np.cumsum(counts)]) * width
            own = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(batch.num_rows, width), pa.int32()), own.cast(pa.binary())], names=["doc_id", "tie", "id_bytes", "ids"])
        del codec, batch
        give_back()

    return run


def _blocks(block_tokens: int):
    """Runs of documents in their order as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, t) for n, t in zip(
                [x.split()[0] for x in BLOCK_SCHEMA.split(", ")],
                [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 3],
                strict=True,
            )]
        )
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in steps(batches, "ids"):
            width, values = batch.column(1)[0].as_py(), batch.column(2)
            data = b"".join(values.to_pylist())
            ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)) // width
            docs = batch.column(0)
            null = docs.is_null().to_numpy(zero_copy_only=False)
            docs = docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            first = 0
            while first < len(docs):  # whole documents; one longer than a block is a block
                base = int(ends[first - 1]) if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, base + block_tokens, side="right")))
                n = int(ends[stop - 1]) - base
                ef = EliasFano.encode(ends[first:stop] - base)
                row = [part, block, start, stop - first, n, width, data[base * width : (base + n) * width], docs[first:stop].tobytes(),
                       np.packbits(null[first:stop]).tobytes(), ef.low_bits, ef.low, ef.high, ef.samples]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
                block, start, first = block + 1, start + n, stop

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = False, block_tokens: int = 1 << 20) -> None:
    """Encodes every text, appends ``end_id`` and writes the blocks in ascending doc_id order to ``path``."""
    d = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    # Written first: the ranges are found by a look at the rows, and texts are encoded once.
    ids = written(d.mapInArrow(_encoded(tokenizer, spaced, end_id), "doc_id long, tie long, id_bytes int, ids binary"), "ids")
    total = ids.agg(F.sum(F.octet_length("ids").cast("long"))).first()[0] or 0
    ordered = ids.repartitionByRange(max(1, -(-total // RANGE_BYTES)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "id_bytes", "ids")
    ordered.mapInArrow(_blocks(block_tokens), BLOCK_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}").astype("<u4")
            ends = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["samples"]).select(np.arange(b["n_docs"]))
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.view(np.uint8))
            crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            null = np.unpackbits(np.frombuffer(b["no_doc_id"], np.uint8), count=b["n_docs"]).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=null), pa.array(starts + b["start"] + b["before"]), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the written blocks."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row a partition of the writer: their number is set by the shuffle, not by the documents.
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(totals), "part").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_by_id(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array of int) of a few documents: only their boundaries are selected in the blocks that hold them."""
    wanted = np.unique(np.array(doc_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                docs = np.frombuffer(b["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(b["no_doc_id"], np.uint8), count=b["n_docs"]).astype(bool)
                at = np.flatnonzero(np.isin(docs, wanted) & ~null)
                if not len(at):
                    continue
                ef = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["samples"])
                ids, ends, starts = np.frombuffer(b["ids"], f"<u{b['id_bytes']}"), ef.select(at), np.where(at > 0, ef.select(np.maximum(at - 1, 0)), 0)
                lists = [ids[s:e].astype(np.int64) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(run, "doc_id long, ids array<long>")
