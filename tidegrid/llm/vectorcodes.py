"""Vector codes: each of four parts of a vector as the number of its nearest codebook entry, entries by Lloyd's rounds.

Components become whole numbers (floor of ``SCALE`` times each), so sums, distances and results are exact and don't depend on
the order of work. Parts live with their owners: rows are dealt once by (position, entry, salt). In each round owners sum their
resident parts, the sums of an entry's owners give its new components, and owners assign their parts anew: parts that keep
their entry are written where they are, only those that change it go through the next shuffle, to the new entry's owners.

Scale: an entry has an owner for every ``OWNED`` of its parts, by the last counts, and a part's salt is its turn in the file,
so an entry that holds any share of all parts, or the same vector a million times, is spread evenly. What the driver sees are
the codebooks (4 x ``ENTRIES`` rows) and counts. Residents are tables in the shared folder, so a lost executor costs its tasks
alone; a round's tables go once the next one's are there. Final codes come from one scan of the vectors, without a shuffle.

Edge cases: null vectors and those with a null or non-finite component have no row; equal rows have equal rows; of equal vec_ids
the lesser vector comes first, null vec_ids come last, in the first codebook; fewer vectors than ``ENTRIES`` make as many
entries; null labels are one label; an empty table has no rows; other columns are ignored. Vectors whose length isn't that of the
first one or not a multiple of four, and components too large for exact distances (about 2 ** 27 after scaling), raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import dropped, give_back, looked_up, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that one owner holds.
OWNED = 50_000
#: Vectors compared with a codebook at once.
BLOCK = 4096
_MEMBER = "position byte, entry short, salt int, turn long, part binary, moved boolean"


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and label of vectors without a null or non-finite component."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    return vectors.where("embedding is not null").where(~odd).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), label.cast("string").alias("label"))


def whole(batch: pa.RecordBatch, size: int | None = None) -> np.ndarray:
    """The batch's vectors as whole numbers."""
    lists = batch.column(batch.schema.get_field_index("embedding"))
    sizes = np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    size = int(sizes[0]) if size is None else size
    if (sizes != size).any() or size % PARTS:
        raise ValueError(f"vectors of {sizes.tolist()} components: all must have {size}, in {PARTS} equal parts")
    x = np.floor(SCALE * pc.list_flatten(lists).to_numpy(zero_copy_only=False))
    if size and len(x) and np.abs(x).max() >= 2.0**31:
        raise ValueError("components too large")
    return x.astype(np.int64).reshape(-1, size)


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry, the lowest of equal ones, and the squared distance."""
    most = max(np.abs(x).max(initial=0), np.abs(codebook).max(initial=0))
    reach = x.shape[1] * (2 * int(most)) ** 2
    if reach >= 2**63:
        raise ValueError("components too large for exact distances")
    own, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    kind = np.float64 if 2 * reach < 2**53 else np.int64  # below that, sums of whole numbers are exact as floats
    c = codebook.astype(kind)
    for at in range(0, len(x), BLOCK):
        y = x[at : at + BLOCK].astype(kind)
        if kind is np.float64:
            d = (c * c).sum(1) - 2 * (y @ c.T)
            best = d.argmin(1)
            d = d[np.arange(len(y)), best] + (y * y).sum(1)
        else:
            d = np.stack([((y - e) ** 2).sum(1) for e in c], 1)
            best = d.argmin(1)
            d = d[np.arange(len(y)), best]
        own[at : at + BLOCK], distance[at : at + BLOCK] = best, d.astype(np.int64)
    return own, distance


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary values of four bytes each."""
    data, width = x.astype("<i4").tobytes(), 4 * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype("<i4").tobytes()), pa.py_buffer(data)])


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("part"))
    return np.frombuffer(b"".join(values.to_pylist()), "<i4").astype(np.int64).reshape(len(values), -1)


def _members(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, turn: np.ndarray, part: pa.Array, moved: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(position, pa.int8()), pa.array(entry, pa.int16()), pa.array(salt, pa.int32()), pa.array(turn, pa.int64()), part, pa.array(moved)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _MEMBER.split(", ")])


class Owners:
    """The members' tables: ``stay`` and what has arrived since; deals members to owners by the last counts."""

    def __init__(self, vectors: DataFrame, codebooks: np.ndarray, owned: int):
        self.spark, self.owned, self.size = vectors.sparkSession, owned, codebooks.shape[2]
        self.parts, self.tables = 1, []
        first = self.spark.sparkContext.broadcast(codebooks)
        size = self.size

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = whole(batch, PARTS * size).reshape(-1, PARTS, size)
                turns = np.arange(turn, turn + len(x))
                turn += len(x)
                for p in range(PARTS):
                    entry, _ = nearest(x[:, p], first.value[p])
                    yield _members(np.full(len(x), p), entry, np.zeros(len(x)), turns, _packed(np.ascontiguousarray(x[:, p])), np.ones(len(x), bool))

        assigned = written(vectors.select("embedding").mapInArrow(placed, _MEMBER), "assigned")
        counts = np.zeros((PARTS, codebooks.shape[1]), np.int64)
        for r in assigned.groupBy("position", "entry").count().collect():
            counts[r["position"], r["entry"]] = r["count"]
        self._count(counts)
        # Salts by these counts, as the first owners are not known before.
        salts = F.element_at(F.lit(self.salts.ravel().tolist()).cast("array<int>"), F.col("position") * self.salts.shape[1] + F.col("entry") + 1) if counts.size else F.lit(1)
        self.tables = [self._settled(assigned.withColumn("salt", (F.col("turn") % salts).cast("int")))]
        dropped(assigned)

    def _count(self, counts: np.ndarray) -> None:
        self.salts = np.maximum(1, -(-counts // self.owned))
        self.parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(int(counts.sum()) / self.owned))

    def _settled(self, members: DataFrame) -> DataFrame:
        return written(members.repartition(self.parts, "position", "entry", "salt"), "residents")

    @property
    def members(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def updated(self, codebooks: np.ndarray) -> np.ndarray:
        """The entries after each has become its members' mean, rounded down; entries without members stay."""
        size, entries = self.size, codebooks.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            total, count = np.zeros((PARTS * entries, size), np.int64), np.zeros(PARTS * entries, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, at = _unpacked(batch), batch.column(0).to_numpy().astype(np.int64) * entries + batch.column(1).to_numpy()
                    order = np.argsort(at, kind="stable")
                    some, begin = np.unique(at[order], return_index=True)
                    total[some] += np.add.reduceat(x[order], begin, axis=0)
                    count += np.bincount(at, minlength=len(count))
            some = np.flatnonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), lists], names=["at", "n", "sums"])

        own = self.members.select("position", "entry", "part").mapInArrow(sums, "at long, n long, sums array<long>")
        own = own.groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(size))).alias("sums"))
        new, counts = codebooks.copy(), np.zeros(PARTS * entries, np.int64)
        for r in own.collect():  # at most 4 x ``ENTRIES``
            new[divmod(r["at"], entries)] = [s // r["n"] for s in r["sums"]]
            counts[r["at"]] = r["n"]
        self._count(counts.reshape(PARTS, entries))
        return new

    def migrate(self, codebooks: np.ndarray) -> None:
        """Every member's entry by the new codebooks; those that change it move."""
        shared = self.spark.sparkContext.broadcast((codebooks, self.salts))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            books, salts = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, position, entry, salt, turn = _unpacked(batch), *(batch.column(k).to_numpy().astype(np.int64) for k in range(4))
                new = entry.copy()
                for p in np.unique(position).tolist():
                    rows = position == p
                    new[rows] = nearest(x[rows], books[p])[0]
                moved = new != entry
                yield _members(position, new, np.where(moved, turn % salts[position, new], salt), turn, batch.column(4), moved)

        old = self.tables
        both = written(self.members.mapInArrow(assigned, _MEMBER), "assigned", by="moved")
        self.tables = [both.where("not moved"), self._settled(both.where("moved"))]
        for t in old:
            dropped(t)


def first_codebooks(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest vec_ids, by position, entry and component."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros((PARTS, 0, 0), np.int64)
    x = whole(rows.to_batches()[0])
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, owned: int = OWNED) -> np.ndarray:
    """Codebooks by position, entry and component after ``rounds`` of Lloyd's algorithm; ``vectors``: of ``kept_vectors``."""
    codebooks = first_codebooks(vectors, entries)
    if not codebooks.size or not rounds:
        return codebooks
    owners = Owners(vectors, codebooks, owned)
    for k in range(rounds):
        if k:
            owners.migrate(codebooks)
        codebooks = owners.updated(codebooks)
    for t in owners.tables:
        dropped(t)
    return codebooks


def encode(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector of ``kept_vectors``."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            if batch.num_rows:
                books = shared.value
                x = whole(batch, PARTS * books.shape[2]).reshape(batch.num_rows, PARTS, -1)
                entry, error = zip(*(nearest(x[:, p], books[p]) for p in range(PARTS)), strict=True)
                digits = np.stack(entry, 1).astype(np.uint8).tobytes().hex()
                code = [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array(sum(error))], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``codes`` (vec_id, code) with embedding: the entries that the code names, scaled back."""
    shared = codes.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                books = shared.value
                entry = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, PARTS)
                x = np.stack([books[p][entry[:, p]] for p in range(PARTS)], 1).reshape(len(entry), -1) / SCALE
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "code", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, code string, embedding array<double>")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector without a null or non-finite component."""
    own = kept_vectors(vectors)
    codebooks = fit(own, **options)
    codes = written(encode(own, codebooks).withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("none"))), "codes")
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return looked_up(codes, "label", of_label, "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
