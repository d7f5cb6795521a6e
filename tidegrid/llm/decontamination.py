"""Benchmark decontamination: passages of test items in training documents, by a hash set of their windows.

Words are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII. A window is ``size`` consecutive
words of an item; an item of fewer words, but not none, is one window. Tasks receive all distinct windows as sorted
64-bit hashes with their words; the documents' windows are hashed as they are read, looked up, and each hit is
verified word for word. What is hit goes from the text as a span, or the document as a whole.

Scale: documents are read once and not shuffled, whatever share of them holds a passage. The windows are sent to
tasks only while their text has at most ``most`` bytes (a parameter, counted before). Beyond it a Bloom filter of
bounded size goes out instead, only windows that pass it are shuffled, and a join on the words themselves verifies
them: dealt by words and salt, as one passage may be in any share of the documents. Both ways give the same rows.

Edge cases: null, empty or wordless text = no words, no hit; a null or wordless item has no window; items of one id
are one item; a null item_id marks words as hit but has no name to be counted or listed; equal rows get equal results;
an empty table on either side gives no hits; other columns of documents are passed on whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Bloom, Words, among, bloom_of, free_names, hash_names, looked_up, spread, steps, texts_of, window_hash, window_starts, written

SIZE = 10
#: Bytes of windows' text that tasks receive at most.
MOST = 16 << 20
STEP = 4 << 20
SEED = 11
LATEST = (1 << 63) - 1


def _table() -> np.ndarray:
    """Each byte as itself, lower-cased, or as a space."""
    out = np.full(256, 32, np.uint8)
    for first, last in (("0", "9"), ("a", "z")):
        out[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[128:] = np.arange(128, 256)
    return out


_PLAIN = _table()
_WORD = re.compile(rb"[^ ]+")


def plain(texts: pa.Array) -> pa.Array:
    """The texts with words lower-cased and every other character a space; bytes keep their places."""
    if not len(texts):
        return texts
    data = texts.buffers()[2]
    new = _PLAIN[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(new.tobytes())])


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item and words of every window of every item; repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            items, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), plain(texts_of(batch)).to_pylist(), strict=True):
                words = [w for w in text.split(" ") if w]
                n = min(size, len(words))
                own = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if n else []
                items += [item] * len(own)
                windows += own
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], names=["item", "words"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "item string, words string")


class Windows:
    """Distinct windows by number of words and hash, and the items that hold each."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        """``rows``: the words of a window and the names of its items."""
        self.items = sorted({i for _, names in rows for i in names})
        number = {name: k for k, name in enumerate(self.items)}
        self.by_size: dict[int, tuple] = {}
        for n in sorted({w.count(" ") + 1 for w, _ in rows}):
            own = [(w, names) for w, names in rows if w.count(" ") + 1 == n]
            keys = window_hash(hash_names(pa.array([x for w, _ in own for x in w.split(" ")], pa.large_string())), n, SEED)[::n]
            order = np.argsort(keys, kind="stable").tolist()
            keys, own = keys[order], [own[k] for k in order]
            counts = np.array([len(names) for _, names in own], np.int64)
            held = np.array([number[i] for _, names in own for i in names], np.int64)
            bits = max(16, min(24, int(16 * len(own)).bit_length()))
            self.by_size[n] = (keys, [w for w, _ in own], counts, np.cumsum(counts) - counts, held, bits)

    def prepared(self) -> Windows:
        """With a table of the hashes' first bits, by which nearly all other windows are left out; made where it's used."""
        self.first = {}
        for n, (keys, *_, bits) in self.by_size.items():
            there = np.zeros(1 << bits, bool)
            there[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.first[n] = there
        return self

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By number of words: places of verified windows, their documents' numbers and the windows' numbers."""
        hashes = hash_names(words.names)[words.index]
        names: list[str] | None = None
        for n, (keys, own, *_, bits) in self.by_size.items():
            starts, doc = window_starts(words.offsets, n)
            if not len(starts):
                continue
            h = window_hash(hashes, n, SEED)[starts]
            some = np.flatnonzero(self.first[n][(h >> np.uint64(64 - bits)).astype(np.int64)])
            at = np.searchsorted(keys, h[some])
            fits = keys[np.minimum(at, len(keys) - 1)] == h[some]
            some, at = some[fits], at[fits]
            known: dict[bytes, int] = {}
            found = np.full(len(some), -1)
            for k, (place, begin) in enumerate(zip(starts[some].tolist(), at.tolist(), strict=True)):
                window = words.index[place : place + n]
                which = known.get(key := window.tobytes())
                if which is None:
                    names = words.names.to_pylist() if names is None else names
                    text, end = " ".join(names[i] for i in window.tolist()), int(np.searchsorted(keys, keys[begin], side="right"))
                    which = known[key] = next((w for w in range(begin, end) if own[w] == text), -1)
                found[k] = which
            real = found >= 0
            yield n, starts[some[real]], doc[some[real]], found[real]


def _spans(words: Words, hits: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words: their documents, first words and ends, counted within the document."""
    cover = np.zeros(len(words.index) + 1, np.int64)
    for n, starts in hits:
        cover += np.bincount(starts, minlength=len(cover)) - np.bincount(starts + n, minlength=len(cover))
    inside = np.cumsum(cover[:-1]) > 0
    owner = words.owner()
    begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (owner[1:] != owner[:-1])])) if len(inside) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | (owner[1:] != owner[:-1]), [True]])) + 1 if len(inside) else begins
    doc = owner[begins]
    return doc, begins - words.offsets[doc], ends - words.offsets[doc]


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def _marks(windows: Windows, words: Words) -> list[pa.Array]:
    """n_words, spans and items of each text."""
    n = len(words.counts)
    found = list(windows.hits(words))
    doc, first, end = _spans(words, [(size, starts) for size, starts, _, _ in found])
    pairs = [np.zeros(0, np.int64)]
    many = max(1, len(windows.items))
    for size, _, docs, which in found:
        _, own, counts, begins, held, _ = windows.by_size[size]
        both = np.unique(docs * len(own) + which)
        docs, which = both // len(own), both % len(own)
        pairs.append(np.repeat(docs, counts[which]) * many + held[spread(counts[which], begins[which])])
    pairs = np.unique(np.concatenate(pairs))
    names = pa.array(windows.items, pa.string()).take(pa.array(pairs % many)) if len(pairs) else pa.array([], pa.string())
    spans = pa.StructArray.from_arrays([pa.array(first), pa.array(end)], fields=list(_SPAN))
    return [pa.array(words.counts.astype(np.int64)), _lists(doc, n, spans), _lists(pairs // many, n, names)]


def _added_to(docs: DataFrame, columns: list[str]) -> tuple[list[str], str]:
    """The names of the three new columns, and the schema of ``columns`` with them."""
    names = free_names(docs, "n_words", "spans", "items")
    types = ["long", "array<struct<first: long, end: long>>", "array<string>"]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return names, ", ".join([own] * bool(own) + [f"`{n}` {t}" for n, t in zip(names, types, strict=True)])


def marked(docs: DataFrame, items: DataFrame, size: int = SIZE, most: int = MOST, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of them) with n_words, spans (word intervals to remove, in order, apart) and items (names, in order).

    Names that ``docs`` has already are lengthened by an underscore. ``items``: item_id and text."""
    columns = docs.columns if columns is None else columns
    names, schema = _added_to(docs, columns)
    own = written(windows_of(items, size).distinct(), "windows")
    total = own.agg(F.sum(F.octet_length("words").cast("long") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    if total > most:
        return _by_join(docs, own, columns, names)
    rows = own.groupBy("words").agg(F.collect_set("item").alias("items")).collect()  # at most ``most`` bytes
    shared = docs.sparkSession.sparkContext.broadcast(Windows([(r["words"], r["items"]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value.prepared()
        for batch in steps(batches, "text", STEP):
            new = _marks(windows, Words(plain(texts_of(batch))))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*columns, *names])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def _by_join(docs: DataFrame, own: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The same where the windows are too many for every task."""
    id_key, tie = free_names(docs, "id_key", "tie")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({id_key: F.coalesce(F.col("doc_id").cast("long"), F.lit(LATEST)), tie: F.xxhash64(text)})
    sizes = [r[0] for r in own.select(F.size(F.split("words", " ")).alias("n")).distinct().collect()]  # at most ``size`` numbers

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(texts_of(batch, "words"))
            hashes = hash_names(words.names)[words.index]
            keys = np.zeros(len(words.counts), np.uint64)
            for n in np.unique(words.counts).tolist():
                rows = words.counts == n
                starts, doc = window_starts(words.offsets, n)
                keys[rows] = window_hash(hashes, n, SEED)[starts[rows[doc]]] if n else 0
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    bloom = bloom_of(own.select("words").distinct().mapInArrow(hashed, "key long"))
    shared = docs.sparkSession.sparkContext.broadcast((bloom.bits, bloom.data.tobytes()))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = Bloom(*shared.value)
        for batch in steps(batches, "text", STEP):
            words = Words(plain(texts_of(batch)))
            hashes, known = hash_names(words.names)[words.index], words.names.to_pylist()
            for n in sizes:
                starts, doc = window_starts(words.offsets, n)
                held = there.holds(window_hash(hashes, n, SEED)[starts].view(np.int64)) if len(starts) else np.zeros(0, bool)
                starts, doc = starts[held], doc[held]
                own = [" ".join(known[i] for i in words.index[k : k + n].tolist()) for k in starts.tolist()]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts - words.offsets[doc]), pa.array(own, pa.string())], names=["id_key", "tie", "start", "words"]
                )

    found = keyed.select(F.col(id_key).alias("id_key"), F.col(tie).alias("tie"), text.alias("text")).mapInArrow(candidates, "id_key long, tie long, start long, words string").distinct()
    hits = written(looked_up(found, "words", own.select("words").distinct(), "id_key", "tie", "start"), "hits")
    places = hits.groupBy("id_key", "tie").agg(F.sort_array(F.collect_list(F.struct("start", F.size(F.split("words", " ")).cast("long").alias("n")))).alias("places"))  # as many as the text has words
    named = looked_up(hits.select("id_key", "tie", "words").distinct(), "words", own.where("item is not null"), "id_key", "tie")
    named = named.select("id_key", "tie", "item").distinct().groupBy("id_key", "tie").agg(F.sort_array(F.collect_list("item")).alias("named"))
    marks = places.join(named, ["id_key", "tie"], "left").withColumnsRenamed({"id_key": id_key, "tie": tie})
    p, q = free_names(docs, "places", "named")
    marks = written(marks.withColumnsRenamed({"places": p, "named": q}), "marks")
    none = {p: F.lit(None).cast(marks.schema[p].dataType), q: F.lit(None).cast("array<string>")}
    keyed = keyed.select(*dict.fromkeys([*columns, "text"]), id_key, tie)
    bloom = bloom_of(marks.select(tie))  # texts without a hit aren't shuffled
    out = among(keyed, tie, bloom).join(marks, [id_key, tie], "left").select(*keyed.columns, p, q).unionByName(among(keyed, tie, bloom, held=False).withColumns(none))
    _, schema = _added_to(docs, columns)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            words = Words(plain(texts_of(batch)))
            of = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            held = [(doc, x["start"], x["n"]) for doc, own in enumerate(of(p).to_pylist()) for x in own or []]
            doc, start, n = np.array(held, np.int64).reshape(-1, 3).T
            starts = words.offsets[doc] + start
            doc, first, end = _spans(words, [(k, starts[n == k]) for k in np.unique(n).tolist()])
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(end)], fields=list(_SPAN))
            new = [pa.array(words.counts.astype(np.int64)), _lists(doc, batch.num_rows, spans), pa.array([x or [] for x in of(q).to_pylist()], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(of(c) for c in columns), *new], names=[*columns, *names])

    return out.mapInArrow(finished, schema)


def without_passages(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs``; hit words, and what stands between the words of one span, are cut from ``text``."""
    columns, (_, spans, _) = docs.columns, free_names(docs, "n_words", "spans", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            at = batch.schema.get_field_index("text")
            texts, cuts = batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(batch.schema.get_field_index(spans)).to_pylist()
            for i, own in enumerate(cuts):
                if own:
                    places = [m.span() for m in _WORD.finditer(_PLAIN[np.frombuffer(texts[i], np.uint8)].tobytes())]
                    ends = [0, *(x for s in own for x in (places[s["first"]][0], places[s["end"] - 1][1])), len(texts[i])]
                    texts[i] = b"".join(texts[i][a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string())).select(columns)

    return marked(docs, items, **options).mapInArrow(run, docs.schema)


def without_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns."""
    _, spans, _ = free_names(docs, "n_words", "spans", "items")
    return marked(docs, items, **options).where(F.size(spans) == 0).select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = marked(d, items, columns=["doc_id"], **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
