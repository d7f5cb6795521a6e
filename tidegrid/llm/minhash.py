"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct shingles of ``size`` words (A-Z lower-cased). Two random permutations make its
whole signature: the first scatters the shingles, the second, shifted by one place for each coordinate, ranks
them; a coordinate is the least rank. Coordinates are banded; documents that agree on a band are candidates;
every link is confirmed on full sets, in whole numbers.

Documents with equal sets are one class from the start. In a bucket all classes are compared with its least
member, its hub, never each with each:

1. a class with the hub that it shares most bands with; links join classes to components;
2. a class with its other hubs, where that could still join two components;
3. members of a bucket in different components with one another, inside the tasks that hold the bucket. A bucket
   is divided by set size first (sets more than a size class apart can't be linked), and members of its largest
   component meet only the others. Pairs whose sizes or signatures still allow a link are compared on full sets,
   most alike first, and only links that join two components leave the task.

So a large group of near copies costs a few rows a class, and every candidate pair is in one component, or
compared, or ruled out. With 26 bands of 4 a pair at the threshold of 0.8 misses every band with a probability
of about one in a million, and as seldom agrees on so few coordinates (60 %) that step 3 leaves it out.
``exact=True`` misses none: buckets are then the least shingles of each set (of two sets with a similarity of t or
more, of n shingles each, the n - ceil(t n) + 1 least have one in common), and step 3 compares every pair.

Sets of more than ``LARGE`` shingles would fill the universe that the two permutations are tables of. They use two
bijections of 2 ** 32 places computed as they are needed; sets that may be linked across that size have both
signatures.

Scale: signatures, links and components are tables in the shared folder and never on the driver. Texts pass a Bloom
filter of the classes that share a bucket before they are shuffled. Where rows are dealt by bucket, by hub, by set
or by neighbour, one key may hold any share of them: they are dealt by key and salt (``looked_up``). A hub with many
partners is dealt over tasks by partner.

Edge cases: null or empty text, or no words = empty set, linked with nothing; fewer words than a shingle = the
sequence as one shingle; rows of one doc_id and different texts are documents of their own, named by that id; a
null doc_id comes after all others; equal rows get equal results; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import SALTS, Words, among, bloom_of, dropped, free_names, hash_names, looked_up, mix64, steps, texts_of, window_hash, written

SIZE, BANDS, ROWS, UNIVERSE = 4, 26, 4, 1 << 20
LATEST = (1 << 63) - 1
#: Shingles of the largest sets that the tables of permutations are for.
LARGE = 1 << 16
#: Partners of a hub that one group of rows holds.
SALTED = 512
#: Members of a bucket that a task compares with one another; larger buckets are dealt as pairs of blocks.
BLOCK = 1500
#: Share of agreeing coordinates under which step 3 leaves a pair out.
AGREEING = 0.6


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = Words(pc.ascii_lower(texts))
    hashes = hash_names(words.names)[words.index] if len(words.index) else np.zeros(0, np.uint64)
    windows = window_hash(hashes, size, 4)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(window_hash(hashes[a:b], b - a, 4 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Circulant:
    """Signatures from two permutations of the universe of hashed shingles."""

    def __init__(self, coordinates: int, universe: int = UNIVERSE, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.first = rng.permutation(universe).astype(np.int32)
        second = rng.permutation(universe).astype(np.int32)
        # Row p holds the ranks of place p in the permutation shifted by 1, 2, ..., coordinates.
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)[1:]
        self.keep, self.coordinates = np.uint64(universe - 1), coordinates

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return self.shifted[self.first[(shingles & self.keep).astype(np.int64)]].min(0)

    def large_signature(self, shingles: np.ndarray) -> np.ndarray:
        """The same over 2 ** 32 places, for sets that a table's universe is too small for."""
        place = _permuted(shingles.astype(np.uint32), 1)
        return np.array([int(_permuted(place + np.uint32(k), 2).min()) for k in range(1, self.coordinates + 1)], np.uint32).view(np.int32)


def _permuted(x: np.ndarray, seed: int) -> np.ndarray:
    """A fixed bijection of 32-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint32(0x9E3779B9 * seed & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
        return x ^ (x >> np.uint32(15))


def band_keys(low: np.ndarray, bands: int, rows: int, kind: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each signature (its coordinates' low 16 bits); equal only for the same band of one kind."""
    parts = low.reshape(len(low), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(kind << 32), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _least(n: int, percent: int) -> int:
    """The shingles of a set of n of which one lies in any set that may be linked with it, as the least of each."""
    return n + (-n * percent) // 100 + 1


def _keyed(docs: DataFrame) -> list:
    """Two columns that name a row: the doc_id (null as the latest) and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LATEST)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]


def _texts(docs: DataFrame) -> DataFrame:
    id_key, tie = _keyed(docs)
    return docs.select(id_key.alias("id_key"), F.coalesce("text", F.lit("")).alias("text"), tie.alias("tie"))


def signatures(docs: DataFrame, percent: int = 80, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, exact: bool = False) -> DataFrame:
    """id_key, tie, n_shingles, set_key, bands (buckets) and low (each coordinate's low 16 bits); the last three null for empty sets.

    ``low`` is of the signature that suits the set's size; sets just above ``LARGE`` have the other's buckets as well.
    ``exact``: buckets are the least shingles."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        for batch in steps(batches, "text", 4 << 20):
            sets = shingle_sets(texts_of(batch), size)
            some = [s for s in sets if len(s)]
            n = np.array([len(s) for s in some], np.int64)
            signed = np.zeros((len(some), bands * rows), np.uint16)
            for i, s in enumerate(some):
                signed[i] = (circulant.large_signature(s) if len(s) > LARGE else circulant.signature(s)).astype(np.uint16)
            if exact:
                buckets = [s[: _least(len(s), percent)].view(np.int64) for s in some]
            else:
                buckets = list(np.where((n > LARGE)[:, None], band_keys(signed, bands, rows, 1), band_keys(signed, bands, rows)))
                for i in np.flatnonzero((n > LARGE) & (n * percent <= LARGE * 100)):
                    buckets[i] = np.concatenate([buckets[i], band_keys(circulant.signature(some[i]).astype(np.uint16)[None], bands, rows)[0]])
            there, low = np.array([len(s) > 0 for s in sets]), iter(signed.astype('<u2'))
            counts = np.zeros(len(sets), np.int64)
            counts[there] = [len(b) for b in buckets]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(~there, False))
            keys = np.concatenate([np.zeros(0, np.int64), *buckets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["id_key", "tie", "n_shingles", "set_key", "bands", "low"],
            )

    return _texts(docs).mapInArrow(run, "id_key long, tie long, n_shingles long, set_key binary, bands array<long>, low binary")


def _overlaps(size: int):
    """Rows in the order hub, salt, role (the hub's own text first): the common shingles of each partner and the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub_set = None, np.zeros(0, np.uint64)
        for batch in steps(batches, "text", 4 << 20):
            rows: list[tuple[int, int, int, int]] = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("hub", "salt", "role", "node")]
            for hub, salt, role, node, own in zip(*columns, shingle_sets(texts_of(batch), size), strict=True):
                if role == 0:
                    now, hub_set = (hub, salt), own
                elif now == (hub, salt):
                    common = len(own) + len(hub_set) - len(np.union1d(own, hub_set))
                    rows.append((node, hub, common, len(own) + len(hub_set) - common))
                else:
                    raise ValueError("a hub's text is missing")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "hub", "common", "either"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int = SIZE) -> DataFrame:
    """node, hub, common, either for pairs of node and hub, from the texts (node, text) of both."""
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    counts = pairs.groupBy("hub", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.sum("n").alias("partners"))
    salted = looked_up(pairs, "hub", counts, "node").select("node", "hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("partners") / SALTED).cast("long")).alias("salt"))
    nodes = salted.join(texts, "node").select("hub", "salt", F.lit(1).alias("role"), "node", "text")
    hubs = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("node"), "text")
    rows = nodes.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "node")
    return rows.mapInArrow(_overlaps(size), "node long, hub long, common long, either long")


def _possible(table: pa.Table, percent: int, bands: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one part of a bucket that may be linked and lie in different components, and on how many
    coordinates they agree. The part holds the pairs between its blocks a and b; two guests meet in the part that
    they are no guests in.

    Where both signatures are of one kind, a pair counts in the first bucket that it shares and is left out if too
    few coordinates agree; ``exact`` leaves none out."""
    n = table.num_rows
    low = np.frombuffer(b"".join(table["low"].to_pylist()), "<u2").reshape(n, -1)
    size, component, own, guest = (table[c].to_numpy() for c in ("n", "component", "own", "guest"))
    a, b, bucket = (table[c][0].as_py() for c in ("a", "b", "bucket"))
    rows, large = low.shape[1] // bands, size > LARGE
    keys = np.where(large[:, None], band_keys(low, bands, rows, 1), band_keys(low, bands, rows))
    left, right, agree = [], [], []
    for i in np.flatnonzero(own == a).tolist():
        others = (component != component[i]) & ~(guest & guest[i])
        others &= (np.arange(n) > i) if a == b else (own == b)
        others &= np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent
        j = np.flatnonzero(others)
        same = (low[j] == low[i]).sum(1)
        if not exact:
            alike, at = large[j] == large[i], np.flatnonzero(keys[i] == bucket)
            keep = (same >= AGREEING * low.shape[1]) | ~alike
            if len(at):
                keep &= ~(keys[j, : at[0]] == keys[i, : at[0]]).any(1) | ~alike
            j, same = j[keep], same[keep]
        left.append(np.full(len(j), i))
        right.append(j)
        agree.append(same)
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


def _still_open(percent: int, bands: int, exact: bool):
    """Of one part of a bucket: the members that may still be linked with one of another component."""

    def run(table: pa.Table) -> pa.Table:
        left, right, _ = _possible(table, percent, bands, exact)
        return table.take(pa.array(np.unique(np.concatenate([left, right]))))

    return run


def _joining(percent: int, size: int, bands: int, exact: bool):
    """Links between members of one part of a bucket that join two components, confirmed on full sets."""

    def run(table: pa.Table) -> pa.Table:
        left, right, agree = _possible(table, percent, bands, exact)
        sets = shingle_sets(table["text"].combine_chunks().cast(pa.large_string()), size)
        nodes, parent = table["node"].to_pylist(), {c: c for c in table["component"].to_pylist()}
        component = table["component"].to_pylist()

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = []
        order = np.argsort(-agree, kind="stable")
        for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
            p, q = root(component[i]), root(component[j])
            if p != q:
                either = len(np.union1d(sets[i], sets[j]))
                if (len(sets[i]) + len(sets[j]) - either) * 100 >= either * percent:
                    parent[max(p, q)] = min(p, q)
                    found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for links of a and b; nodes without a link don't appear.

    Each round takes the least label among neighbours, then follows labels to their own label, until none changes;
    labels only fall, so it ends."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = written(both.distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component"), F.lit(True).alias("changed")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        near = looked_up(edges, "other", theirs, "node").groupBy("node").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "theirs").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        # A component's label may belong to any share of the nodes; each label is a node of its own.
        jumped = looked_up(least, "new", jump, "node").withColumn("least", F.least("new", "next"))
        after = written(jumped.select("node", F.col("least").alias("component"), (F.col("least") != F.col("component")).alias("changed")), "labels")
        dropped(labels)
        labels = after
        if after.where("changed").isEmpty():
            dropped(edges)
            return labels.select("node", "component")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, exact: bool = False) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, component_id and kept of every document.

    ``exact``: complete whatever the signatures say, at the price of a fifth of each set as buckets."""
    signed = written(signatures(docs, percent, size, bands, rows, exact), "signatures")
    # A class is named by a number of its own; one of its rows stands for its text.
    classes = written(
        signed.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("id_key", "tie")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
        .select("set_key", F.monotonically_increasing_id().alias("node"), "least.id_key", "least.tie", "n", "bands", "low"),
        "classes",
    )
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    buckets = members.groupBy("bucket", part.alias("part")).agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k"))
    buckets = buckets.groupBy("bucket").agg(F.min("hub").alias("hub"), F.sum("k").alias("n_members")).where("n_members > 1")
    shared = written(looked_up(members, "bucket", buckets, "node"), "buckets")
    stars = written(shared.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n_bands")), "stars")
    nodes = written(shared.select("node").distinct(), "nodes")
    wanted = nodes.join(classes.select("node", "id_key", "tie"), "node")
    near = among(_texts(docs), "tie", bloom_of(wanted.select("tie")))
    texts = written(near.join(wanted, ["id_key", "tie"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    def is_link(d: DataFrame) -> DataFrame:
        return d.where(F.col("common") * 100 >= F.col("either") * percent).select(F.col("node").alias("a"), F.col("hub").alias("b"))

    def labels_of(links: DataFrame) -> DataFrame:
        """A component for every node of a bucket: itself where it has no link."""
        return written(nodes.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")

    # 1. Each class and its closest hub.
    best = stars.groupBy("node").agg(F.max_by("hub", F.struct("n_bands", -F.col("hub"))).alias("hub"))
    links = is_link(written(verified(best, texts, size), "tried"))
    labels = labels_of(links)
    # 2. The other hubs.
    rest = stars.join(best, ["node", "hub"], "left_anti").join(labels, "node").withColumnRenamed("component", "own")
    rest = looked_up(rest, "hub", labels.withColumnRenamed("node", "hub"), "node").where("own <> component").select("node", "hub")
    links = links.unionByName(is_link(written(verified(rest, texts, size), "tried")))
    labels = labels_of(links)
    # 3. Members of a bucket in different components, by set size.
    inside = shared.where("n_members > 2").select("bucket", "node", "n").join(labels, "node")
    mixed = inside.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("bucket")
    size_class = F.floor(F.log(F.col("n")) / math.log(100 / percent * (1 + 1e-9))) if percent < 100 else F.col("n")
    inside = looked_up(inside, "bucket", mixed, "node").withColumn("as", F.explode(F.array(F.struct(size_class.alias("c"), F.lit(False).alias("guest")), F.struct((size_class + 1).alias("c"), F.lit(True).alias("guest")))))
    inside = written(inside.select(F.struct("bucket", "as.c").alias("part"), "node", "n", "component", "as.guest"), "inside")
    counts = inside.groupBy("part", "component").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("guest")).alias("own"))
    counts = counts.groupBy("part").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("k"), F.sum("own").alias("own"))
    counts = counts.where("own > 0 and k > most.k").select("part", F.col("most.component").alias("largest"), F.ceil((F.col("k") - F.col("most.k")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most.k") / BLOCK).cast("int").alias("largests"))
    inside = looked_up(inside, "part", counts, "node").join(classes.select("node", "low"), "node")
    in_largest, h = F.col("component") == F.col("largest"), F.xxhash64("node")
    own = F.when(in_largest, F.col("others") + F.pmod(h, "largests")).otherwise(F.pmod(h, "others")).cast("int")
    met = F.when(in_largest, F.col("others")).otherwise(F.col("others") + F.col("largests"))
    pairs_of = F.transform(F.sequence(F.lit(0), met - 1), lambda k: F.struct(F.least(k, own).alias("a"), F.greatest(k, own).alias("b")))
    inside = inside.withColumn("own", own).withColumn("pair", F.explode(pairs_of))
    inside = inside.select("part.bucket", "part.c", "pair.a", "pair.b", "own", "guest", "node", "n", "component", "low")
    key, schema = ["bucket", "c", "a", "b"], "bucket long, c long, a int, b int, own int, guest boolean, node long, n long, component long, low binary"
    open_ = written(inside.groupBy(*key).applyInArrow(_still_open(percent, bands, exact), schema), "open")
    found = written(open_.join(texts, "node").groupBy(*key).applyInArrow(_joining(percent, size, bands, exact), "a long, b long"), "found")
    if not found.isEmpty():
        labels = labels_of(links.unionByName(found))
    # Components by their least doc_id; classes that share no bucket are alone.
    named = classes.select("set_key", "node", "id_key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component", part.alias("part")).agg(F.min("id_key").alias("least")).groupBy("component").agg(F.min("least").alias("least"))
    named = looked_up(named, "component", least, "node").select("set_key", "least")
    filled = looked_up(signed.where("set_key is not null").select("id_key", "tie", "n_shingles", "set_key"), "set_key", named, "id_key", "tie")
    out = filled.select("id_key", "tie", "n_shingles", "least").unionByName(signed.where("set_key is null").select("id_key", "tie", "n_shingles", F.col("id_key").alias("least")))
    plain = lambda c: F.when(F.col(c) != LATEST, F.col(c))
    return out.select(plain("id_key").alias("doc_id"), "tie", "n_shingles", plain("least").alias("component_id"), (F.col("id_key") == F.col("least")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which near_duplicates keeps the document; of equal rows one.

    Only rows that go, or that have an equal, are shuffled with their texts (and a few that a filter takes for them)."""
    id_key, tie = free_names(docs, "id_key", "tie")
    own_id, own_tie = _keyed(docs)
    found = near_duplicates(docs, **options).select(F.coalesce("doc_id", F.lit(LATEST)).alias(id_key), F.col("tie").alias(tie), "kept")
    found = written(found.groupBy(id_key, tie).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "kept")
    bloom = bloom_of(found.where("not kept or n > 1").select(tie))
    keyed = docs.withColumns({id_key: own_id, tie: own_tie})
    some = among(keyed, tie, bloom).groupBy(id_key, tie).agg(F.first(F.struct(*docs.columns)).alias("row"))
    some = some.join(found.where("kept").select(id_key, tie), [id_key, tie], "left_semi")
    return among(keyed, tie, bloom, held=False).select(*docs.columns).unionByName(some.select("row.*"))
