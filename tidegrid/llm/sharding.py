"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups sorted by size, largest first, enter the bin with the tightest remaining capacity that holds them,
found through a balanced tree of remaining capacities. Two uses:

* ``fixed_capacity_shards``: as few shards of a given capacity as best fit decreasing finds;
* ``balanced_shards``: a given number of shards, with nearly the least capacity for which that number suffices.

Scale: every group is sorted and placed, in partitions of about ``per_partition`` groups; the bins that the
partitions fill are then groups themselves, packed in the same way in fewer partitions, until one is left. So a corpus
of any size passes a few levels, each with at most a fraction of the rows of the one before, and no group's list comes
to the driver. Texts are read once and never shuffled. A row's place in its shard is a prefix sum of counts by
scan partition, so no shard is sorted as a whole.

Edge cases: null text = no bytes, size 8, and one group with the empty text; equal rows share a group and get
different slots; an empty table gives an empty result; a group above a fair share gets a shard of its own; one above
a fixed capacity can't be split and gets a shard of its own too, marked ``over_capacity``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import id_and_text, looked_up, written

#: Bytes that a row costs besides its text.
ROW_BYTES = 8


class CapacityTree:
    """Bins by remaining capacity in an AA tree: insert, delete and least-at-or-above in logarithmic time."""

    class Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            left = t.left
            t.left, left.right = left.right, t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            right = t.right
            t.right, right.left = right.left, t
            right.level += 1
            return right
        return t

    def add(self, key: tuple[int, int]) -> None:
        def into(t):
            if t is None:
                return self.Node(key)
            if key < t.key:
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return self._split(self._skew(t))

        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = out(t.left, key)
            elif key > t.key:
                t.right = out(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                after = t.right
                while after.left:
                    after = after.left
                t.key = after.key
                t.right = out(t.right, after.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and t.right.level > low:
                    t.right.level = low
            t = self._skew(t)
            if t.right:
                t.right = self._skew(t.right)
                if t.right.right:
                    t.right.right = self._skew(t.right.right)
            t = self._split(t)
            if t.right:
                t.right = self._split(t.right)
            return t

        self.root = out(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining, bin) with remaining >= size."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; None if more than ``most`` bins would be needed. An item above capacity fills a bin."""
    tree, bins = CapacityTree(), 0
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        found = tree.tightest(size)
        if found:
            tree.remove(found)
            left, out[i] = found[0] - size, found[1]
        else:
            left, out[i] = max(0, capacity - size), bins
            bins += 1
            if most is not None and bins > most:
                return None
        tree.add((left, out[i]))
    return out


def even_bins(sizes: list[int], n: int) -> list[int]:
    """Bins 0 to n - 1 of nearly equal sums: items above a fair share get a bin each, the rest a capacity about a
    thousandth (over their number) above the least at which best fit decreasing needs no more than the bins that are left."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total, out, alone = sum(sizes), [0] * len(sizes), 0
    while alone < min(n - 1, len(order)) and sizes[order[alone]] * (n - alone) > total:
        out[order[alone]] = alone
        total -= sizes[order[alone]]
        alone += 1
    rest, left = order[alone:], n - alone
    if not rest:
        return out
    own = [sizes[i] for i in rest]
    low = max(-(-total // left), own[0])
    near = max(1, low // (1000 * left))  # the last bin gets what the others leave
    high, packed = low + near, best_fit_decreasing(own, low + near, left)
    step = near
    while packed is None:
        low, step = high, 2 * step
        high += step
        packed = best_fit_decreasing(own, high, left)
    while high - low > near:
        middle = (low + high) // 2
        tried = best_fit_decreasing(own, middle, left)
        low, high, packed = (middle, high, packed) if tried is None else (low, middle, tried)
    for i, b in zip(rest, packed, strict=True):
        out[i] = alone + b
    return out


def _slim(docs: DataFrame) -> DataFrame:
    """A row for each document without its text, at a stable place."""
    d = id_and_text(docs)
    return written(
        d.select(
            "doc_id",
            (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("group"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "sharding",
    )


def _placed(place: Callable[[list[int]], list[int]], level: int):
    """Of one partition's items (key, bytes): the bin that each enters, named by level, partition and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).sort_by("key")
            bins, first = place(table["bytes"].to_pylist()), (level << 56) + (TaskContext.get().partitionId() << 28)
            yield from table.append_column("bin", pa.array([first + b for b in bins], pa.int64())).to_batches()

    return run


def _shards(rows: DataFrame, place: Callable[[list[int]], list[int]], per_partition: int, finer: Callable[[list[int]], list[int]] | None = None) -> DataFrame:
    """group and shard (any number) of every group: packed in partitions (by ``finer``, where another level follows),
    then the partitions' bins in turn."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    items, level, steps_ = groups.select(F.col("group").alias("key"), "bytes"), 0, []
    n = items.count()
    while True:
        parts = max(1, -(-n // per_partition))
        key = items.schema["key"].dataType.simpleString()
        placed = written(items.repartition(parts, F.xxhash64("key", F.lit(level))).mapInArrow(_placed(place if parts == 1 else finer or place, level), f"key {key}, bytes long, bin long"), "placed")
        steps_.append(placed)
        if parts == 1:
            break
        items, before = placed.groupBy("bin").agg(F.sum("bytes").alias("bytes")).select(F.col("bin").alias("key"), "bytes"), n
        n, level = items.count(), level + 1
        if n >= before:  # nothing fits together any more
            break
    out = steps_[0].select(F.col("key").alias("group"), "bin")
    for placed in steps_[1:]:
        above = placed.select(F.col("key").alias("bin"), F.col("bin").alias("next"))
        out = looked_up(out, "bin", above, "group").select("group", F.col("next").alias("bin"))
    return out.withColumnRenamed("bin", "shard")


def _with_slots(rows: DataFrame) -> DataFrame:
    """Gapless places in each shard: those in a scan partition by its own order, after those of earlier partitions."""
    rows = rows.withColumn("part", F.shiftright("place", 33))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place")) - 1
    return rows.withColumn("at", at).join(counts, ["shard", "part"]).withColumn("slot", F.col("at") + F.col("before"))


def balanced_shards(docs: DataFrame, n_shards: int = 24, per_partition: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard 0 to n_shards - 1, slot, grown_shard (null)."""
    rows = _slim(docs)
    # Partitions fill many small bins, so that the last level can still even them out.
    shards = _shards(rows, lambda sizes: even_bins(sizes, n_shards), max(per_partition, 16 * n_shards), lambda sizes: even_bins(sizes, max(n_shards, len(sizes) // 16)))
    # The last level has one partition, whose bins are numbered from 0.
    shards = shards.withColumn("shard", F.col("shard").bitwiseAND((1 << 28) - 1).cast("int"))
    return _with_slots(looked_up(rows, "group", shards, "place")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def fixed_capacity_shards(docs: DataFrame, capacity: int, per_partition: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard (any number), slot, over_capacity, for as few shards of ``capacity`` bytes as
    best fit decreasing finds."""
    rows = _slim(docs)
    shards = written(_shards(rows, lambda sizes: best_fit_decreasing(sizes, capacity), per_partition), "shards")
    bytes_ = looked_up(rows, "group", shards, "place").groupBy("shard").agg((F.sum("size") > capacity).alias("over_capacity"))
    shards = looked_up(shards, "shard", bytes_, "group")
    return _with_slots(looked_up(rows, "group", shards, "place")).select("doc_id", "size", "text_crc32", "shard", "slot", "over_capacity")
