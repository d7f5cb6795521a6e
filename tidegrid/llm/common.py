"""What the operators share: input columns, scratch tables, batches of bounded size, and words as arrays.

Input contract of every operator: a DataFrame with ``doc_id`` and ``text``; further columns are ignored
unless a docstring says otherwise, whatever their names. A null text counts as an empty one.
"""

from __future__ import annotations

import contextlib
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources.files import scratch as scratch_path

#: Text bytes that one step of a Python worker holds at once; a longer single text is a step of its own.
STEP_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and lost executors cost no recomputation.

    ``by``: a column that has a folder for each of its few values."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes a table made by ``written`` that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0].rpartition("/moved=")[0] or f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/tidegrid/" in path:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column of that name already (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Parts that the rows of one key are dealt over where a key may be hot.
SALTS = 64


def looked_up(rows: DataFrame, key: str, table: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    """rows joined with ``table`` (one row for each key), rows of other keys left out (``how="left"``: with nulls).

    A key may hold any share of the rows: they are dealt by key and a hash of the columns ``by``, and the table's
    row goes to each of at most ``SALTS`` parts."""
    (salt,) = free_names(rows, "salt_")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    wanted = salted.select(key, salt).distinct().join(table, key)
    return salted.join(wanted, [key, salt], how).drop(salt)


#: Bits of the largest filter that tasks receive (32 MB).
MOST_BLOOM_BITS = 28


class Bloom:
    """A Bloom filter with two places for each 64-bit key."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        h = mix64(keys.astype(np.int64).view(np.uint64))
        return np.concatenate([h >> np.uint64(64 - bits), (h & np.uint64((1 << bits) - 1))]).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, self.bits)
        there = (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return there[: len(keys)] & there[len(keys) :]


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of a table of one column of longs: about eight bits a key, ``MOST_BLOOM_BITS`` at most.

    The keys' places are merged by range, and only the ranges' bit maps come to the driver. Beyond some 30 million
    keys the filter lets more others through, which costs shuffle and changes no result."""
    n, parts = keys.count(), 16
    bits = min(MOST_BLOOM_BITS, max(16, (8 * n).bit_length()))
    width = (1 << bits - 3) // parts
    column = keys.columns[0]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Bloom.places(ints_of(batch, column), bits))
            ends = np.searchsorted(at, np.arange(parts + 1) * (width << 3))
            some = np.flatnonzero(np.diff(ends)).tolist()
            own = [(at[ends[k] : ends[k + 1]] - k * (width << 3)).astype("<u4").tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(own, pa.binary())], names=["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                merged.setdefault(part, np.zeros(width << 3, bool))[np.frombuffer(data, "<u4")] = True
        for part, own in merged.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << bits - 3, np.uint8)
    schema = "part int, bits binary"
    for r in keys.mapInArrow(places, schema).repartition(parts, "part").mapInArrow(merge, schema).collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(bits, out.tobytes())


def among(rows: DataFrame, key: str, bloom: Bloom, held: bool = True) -> DataFrame:
    """The rows whose ``key`` (a long) the filter holds: all that are in it and few others, before any shuffle.

    ``held=False``: the other rows, none of which is in it."""
    shared = rows.sparkSession.sparkContext.broadcast((bloom.bits, bloom.data.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(own.holds(ints_of(batch, key)) == held))

    return rows.mapInArrow(run, rows.schema)


def give_back() -> None:
    """Free memory of this worker goes back to the machine: workers outlive their tasks and stand beside later ones."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library can do it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, whose ``column`` holds about ``most`` bytes at most."""
    give_back()  # what the task before has left
    yield from _steps(batches, column, most, rows)
    give_back()


def _steps(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The batch's texts in buffers of their own: some kernels misread arrays whose first offset isn't zero."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    return values.take(pa.array(np.arange(len(values))))


def ints_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Words of a batch of texts: ``names`` (distinct), ``index`` into them in reading order, ``ends`` by document.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else lists.values
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary
        empty = pc.index(names, pa.scalar("", names.type)).as_py()
        if empty >= 0:  # the splitter leaves empty strings at the ends of a text
            real = index != empty
            before = np.concatenate([[0], np.cumsum(real)])
            index, offsets = index[real], before[offsets]
        self.names, self.index, self.offsets = names, index, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The document's number for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... for lengths[i] of them, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def repeats(words: Words, size: int = 3) -> np.ndarray:
    """For each document, the words that lie in a window of ``size`` words found twice or more in it."""
    n_docs = len(words.counts)
    starts = spread(np.maximum(words.counts - size + 1, 0), words.offsets[:-1])
    if not len(starts):
        return np.zeros(n_docs, np.int64)
    code = words.index[starts]
    for k in range(1, size):  # renumbered at each step, so the product never overflows
        code = np.unique(code, return_inverse=True)[1].astype(np.int64) * len(words.names) + words.index[starts + k]
    owner = words.owner()
    code = np.unique(code, return_inverse=True)[1].astype(np.int64) * n_docs + owner[starts]
    _, which, count = np.unique(code, return_inverse=True, return_counts=True)
    found = starts[count[which] >= 2]
    covered = np.zeros(len(words.index), bool)
    for k in range(size):
        covered[found + k] = True
    return np.bincount(owner[covered], minlength=n_docs)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text, its lines with a word that are equal to an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = worded[line] if len(line) else np.zeros(0, bool)
    distinct = np.unique(owner[keep] * max(1, len(worded)) + line[keep])
    return np.bincount(owner[keep], minlength=len(texts)) - np.bincount(distinct // max(1, len(worded)), minlength=len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def hash_names(names: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))


def hash_names_twice(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string, halves of one of 128 bits."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join(map(digest, names.cast(pa.large_binary()).to_pylist())), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences; small for rising or repeated ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(values.astype(np.int64), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def window_hash(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes; windows may cross documents, see ``window_starts``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += words[k : k + n] * odd[k]
    return mix64(out)


def window_starts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of ``size`` words of one document starts, and the document's number."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    return spread(counts, offsets[:-1]), np.repeat(np.arange(len(counts)), counts)


def spawn_env() -> None:
    """One thread for each worker: the cores belong to Spark's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    pa.set_cpu_count(1)



def passed(docs: DataFrame, verdict) -> DataFrame:
    """The rows whose texts pass ``verdict()(texts) -> booleans``, with all their columns, from one scan.

    ``verdict`` is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = verdict()
        for batch in steps(batches, "text", 2 << 20, 1000):
            yield batch.filter(pa.array(judge(texts_of(batch))))

    return docs.mapInArrow(run, docs.schema)
