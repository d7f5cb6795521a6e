"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidegrid.llm import bpe, flac, minhash, packing, quality, queries, rules, sharding, substring, tokenids, toxicity
from tidegrid.llm.common import read_table, steps, texts_of

SF_DIR = "/root/testdata/sf0.001"
WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
ODD = ["", None, "  ", "one", "A b c", "x\n\n y\t z ", "naïve café 123 ﷽ 👍 <|endoftext|>", "word " * 3000, "dup line\ndup line\n", "\x1c a'll I'm"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (3, "one"), (3, "another text of the same id")]
    return spark.createDataFrame([(i, t, 1, 2, 3, 4.0, "s") for i, t in rows], "doc_id long, text string, size int, tie int, label int, score double, slice string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_DIR, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def reference(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_slices_of_a_batch_keep_their_texts():
    batch = pa.RecordBatch.from_pydict({"text": [f"Text {i} " * 50 for i in range(200)]})
    assert [t for b in steps([batch], "text", 1000) for t in texts_of(b).to_pylist()] == batch.column(0).to_pylist()


def test_elias_fano():
    for values in ([0], [5, 5, 5], list(range(0, 5000, 7)), np.cumsum(np.random.RandomState(1).randint(0, 4000, 1000)).tolist()):
        ef = tokenids.EliasFano.encode(np.array(values))
        assert ef.select(np.arange(len(values))).tolist() == list(values)
        assert [int(ef.select(i)[0]) for i in range(len(values))] == list(values)
    with pytest.raises(IndexError):
        tokenids.EliasFano.encode(np.zeros(0, np.int64)).select(0)


def test_token_ids(spark, texts, odd, empty, tmp_path):
    encode, start = reference(WORD), 0
    got = {r["doc_id"]: r for r in queries.op1_elias_fano_token_ids(spark, SF_DIR).collect()}
    for doc in sorted(texts):
        ids = encode(texts[doc]) + [1]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    for name, frame, n in (("odd", odd, odd.count()), ("empty", empty, 0)):
        tokenids.write_token_ids(frame, str(tmp_path / name), WORD, 1, block_tokens=50)
        rows = tokenids.read_token_ids(spark, str(tmp_path / name)).collect()
        assert len(rows) == n
        ends = sorted((r["start"], r["n_tokens"]) for r in rows)
        assert all(a + k == b for (a, k), (b, _) in zip(ends, ends[1:], strict=False))
    some = {r["doc_id"]: r["ids"] for r in tokenids.documents_by_id(spark, str(tmp_path / "odd"), [6, 7, 0]).collect()}
    assert some == {i: encode(ODD[i]) + [1] for i in (6, 7, 0)} and 49407 in some[6]


def test_flac_round_trip():
    rng, r = np.random.RandomState(1), random.Random(2)
    payloads = [b"", b"a" * 64, b"hello world " * 700, rng.bytes(5000), b"\xff\x00" * 3000, (b"ab" * 500 + b"\x00" * 500 + b"\xff") * 20]
    payloads += [np.clip(128 + np.cumsum(rng.randint(-3, 4, r.randint(1, 5000))), 0, 255).astype(np.uint8).tobytes() for _ in range(8)]
    payloads = [flac.payload(p) for p in payloads]
    streams = flac.encode(payloads)
    bare = [b"fLaC\x80" + s[5:42] + s[flac.Stream(s).first :] for s in streams]  # without the seek table
    for made in (streams, bare):
        assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode(made)] == payloads
    assert flac.seek(streams[2], 5000)[:5].tolist() == flac.decode(streams)[2][5000:5005].tolist()
    for at in (-100, -1):
        broken = bytearray(streams[2])
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_media(spark, texts, odd, empty):
    for r in queries.op2_flac_media(spark, SF_DIR).collect():
        data = flac.payload(texts[r["doc_id"]].encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    rows = flac.media_features(flac.text_media(odd)).collect()
    assert len(rows) == odd.count() and len({r["media_sha256"] for r in rows if r["n_bytes"] == 0}) == 1
    assert flac.media_features(flac.text_media(empty)).count() == 0
    blocks = flac.pcm_blocks(flac.text_media(odd), 64).where("doc_id = 7").orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [64 * k for k in range(len(blocks))]
    assert (np.frombuffer(b"".join(b["pcm"] for b in blocks), "<i2") + 128).astype(np.uint8).tobytes() == flac.payload(ODD[7].encode())


def test_toxicity(spark, odd, empty):
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = read_table(spark, "/root/testdata/sf0.1", "labels").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [(x["toxic"], got[x["doc_id"]]["predicted"]) for x in labels if got[x["doc_id"]]["held_out"]]
    toxic, other = [p for t, p in held if t], [p for t, p in held if not t]
    # Few labelled toxic texts in three of the four languages here: recall is 0.58 (README).
    assert sum(toxic) / len(toxic) >= 0.5 and sum(other) / len(other) <= 0.01
    some = spark.createDataFrame([(7, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, some).count() == odd.count()
    assert toxicity.score_documents(odd, some.limit(0)).agg({"score": "max"}).first()[0] < 1e-6
    assert toxicity.score_documents(empty, some).count() == 0


def test_toxicity_keeps_rare_ngrams():
    """6 of 1,000 toxic texts, and no other, hold features 20 to 39: a log-count ratio under 1.5."""
    rows = [(1, range(20, 40))] * 6 + [(1, range(20))] * 994 + [(0, range(40, 60))] * 1000
    ends = np.cumsum([0] + [len(f) for _, f in rows])
    model = toxicity.fit_rows(np.array([label for label, _ in rows]), ends, np.concatenate([np.array(f) for _, f in rows]))
    assert (model.weights[20:40] > 0).all() and model.weights[20:40].sum() > model.weights[40:60].sum()


def test_toxicity_calibration():
    z = np.random.RandomState(1).normal(0, 2, 20000)
    slope, constant = toxicity.calibration(z, np.random.RandomState(2).rand(len(z)) < 1 / (1 + np.exp(-(1.5 * z - 1))))
    assert abs(slope - 1.5) < 0.1 and abs(constant + 1) < 0.1


def test_toxicity_by_language(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    scores = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "score").toPandas()
    for lang, least in (("en", 0.98), ("fr", 0.7), ("de", 0.8), ("es", 0.8)):
        own = scores[scores["lang"] == lang]
        toxic, other = (own[own["toxic"] == k]["score"].to_numpy() for k in (1, 0))
        assert (toxic[:, None] > other).mean() + (toxic[:, None] == other).mean() / 2 >= least


def test_prefix_table_equals_the_library():
    encoder = bpe.PrefixEncoder(bpe.read_ranks(RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    r, tokens = random.Random(1), list(encoder.ranks)
    for k in range(400):
        data = b"".join(r.choice(tokens) for _ in range(4)) if k % 2 else bytes(r.choice(b"abcdeinth  \xc3\xa9\xff") for _ in range(r.randint(1, 40)))
        assert encoder.encode(data) == library._core_bpe.encode_single_piece(data)
        table = bpe.PrefixTable(encoder, data)
        a = r.randint(0, len(data))
        table.edit(a, r.randint(a, min(len(data), a + 4)), bytes(r.choice(b"abth ") for _ in range(r.randint(0, 4))))
        assert table.last == bpe.PrefixTable(encoder, table.data).last
    long = bpe.PrefixTable(encoder, b"abcdefghij" * 300)
    assert long.edit(1500, 1501, b"x") < 500  # re-encodes near the edit only


def test_bpe(spark, texts, odd, empty):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(texts[r["doc_id"]], r) for r in queries.op4_prefix_bpe(spark, SF_DIR).collect()]
    got += [(ODD[r["doc_id"]], r) for r in bpe.encode_and_decode(odd.where("doc_id <> 3"), RANKS, public_tokenizers.PATTERN).collect()]
    for text, r in got:
        ids = library.encode_ordinary(text or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    ids = bpe.token_ids(odd, RANKS, public_tokenizers.PATTERN)
    assert {bytes(r["bytes"]) for r in bpe.decoded(ids, RANKS).collect()} >= {(t or "").encode() for t in ODD}
    assert bpe.encode_and_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_quality(spark, odd, empty):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, sample=500)
    assert all(a > 0.5 for a in model.labels.accuracy())
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, model).collect()}
    good = [kept[r["doc_id"]] for r in labels.collect() if r["quality"] == 1]
    bad = [kept[r["doc_id"]] for r in labels.collect() if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1
    rows = quality.judge(odd, model).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["n_words"] == 0)
    assert quality.judge(empty, quality.fit(empty)).count() == 0 and quality.kept(odd).columns == odd.columns


def test_quality_reads_long_words_to_their_end():
    begin, clean, junk = "Plain" * 12 + "text", "wholesome" * 300, "".join(f"{'#$%'[i % 3]}{{9}}Qx{i % 10}|=" for i in range(300))
    a, b, c, d = quality.Features(pa.array([begin + clean, begin + junk, junk, "x " + begin + junk + " y"], pa.large_string())).x
    assert np.abs(a - b).sum() > 0.5 and np.abs(b - c).sum() < np.abs(b - a).sum()
    # All shapes together, and all words' short forms together, make one whole each.
    assert all(abs((x[2:] ** 2).sum() - 2) < 1e-9 for x in (a, b, c, d))
    short = quality.Features(pa.array(["A few words of 64 characters or less, 12.5 % of them odd: " + "aB" * 32], pa.large_string())).x
    assert np.array_equal(short, quality.Features(pa.array(["A few words of 64 characters or less, 12.5 % of them odd: " + "aB" * 32, begin + junk], pa.large_string())).x[:1])


def removed(rows, size=13):
    first = {}
    split = [(2**63 - 1 if i is None else i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {k + d for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for d in range(size)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs, odd, empty):
    take = lambda d: sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in d.collect())
    assert take(substring.dedup_windows(docs, bits=20)) == removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(5, f"a b {passage} c"), (2, f"{passage} d"), (5, f"z {passage}"), (9, f"{passage} {passage}"), (None, passage), (1, "w0 w1 w2")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (12, 20):  # a sketch far too small passes more windows, with the same result
        assert take(substring.dedup_windows(made, bits=bits)) == removed(rows)
    assert take(substring.dedup_windows(odd, bits=16)) == removed([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert substring.dedup_windows(empty, bits=16).count() == 0
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(made.where("doc_id in (1, 2, 9)"), bits=16).collect()}
    assert left == {1: "w0 w1 w2", 2: f"{passage} d", 9: ""}


def test_quality_rules(spark, texts, odd, empty):
    for r in [*queries.op7_quality_rules(spark, SF_DIR).collect(), *rules.judge(odd.where("doc_id <> 3"), odd.limit(0).select("doc_id")).collect()]:
        text = texts[r["doc_id"]] if r["n_words"] not in {len(words(t)) for t in ODD} or r["doc_id"] not in range(len(ODD)) else None
        if text is None:
            continue
        w = words(text)
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        worded = [x for x in text.split("\n") if words(x)]
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(again), base)
        assert not (base and r["kept"])
    assert rules.judge(odd, odd.select("doc_id")).count() == odd.count() and rules.judge(empty, odd.select("doc_id")).count() == 0


def test_rules_tell_trusted_text_from_junk(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    got = {r["doc_id"]: r for r in rules.judge(docs, labels.where("quality = 1")).collect()}
    judged = [(r["quality"], got[r["doc_id"]]["kept"]) for r in labels.collect() if not got[r["doc_id"]]["base_failed"]]
    assert all(k for q, k in judged if q == 1) and sum(k for q, k in judged if q == 0) <= 2


def test_lower_bounds_and_best_fit():
    r = random.Random(5)
    for _ in range(30):
        sizes = np.array([r.choice([3, 4, 5, 6, 7, 10]) for _ in range(r.randint(1, 9))])
        bins, offsets, n = packing.best_fit(sizes, 10)
        best = exact_bins(sorted(sizes.tolist(), reverse=True), 10)
        assert packing.lower_bound(sizes, 10) <= best <= n
        for b in range(n):
            own = sorted((o, s) for o, s, x in zip(offsets.tolist(), sizes.tolist(), bins.tolist(), strict=True) if x == b)
            assert [o for o, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))] and sum(s for _, s in own) <= 10
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4] * 5), 10) == 3


def exact_bins(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_packing(spark, texts, odd, empty):
    encode = reference(BYTE)
    rows = queries.op8_best_fit_packing(spark, SF_DIR).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for doc, own in by_doc.items():
        ids, at = encode(texts[doc]) + [0], 0
        own.sort(key=lambda r: r["piece"])
        assert all(r["length"] == 2048 for r in own[1:]) and [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in by_bin.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) <= 2048
    assert set(by_doc) == set(texts) and len(by_bin) <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1
    assert {(r["n_sequences"], r["bound"]) for r in rows} == {(len(by_bin), packing.lower_bound(np.array([r["length"] for r in rows]), 2048))}
    lengths = packing.pieces(odd, BYTE, 0)
    assert packing.pack(lengths, 2048, per_partition=3).count() == lengths.count() >= odd.count()
    # Many partitions exchange what is left over: nearly as few sequences as in one.
    sizes = np.random.RandomState(3).lognormal(5.5, 1.2, 6000).astype(int).clip(1, 2048)
    frame = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "place long, length long")
    out = packing.pack(frame, 2048, per_partition=300, exchanged=8).toPandas().merge(frame.toPandas(), on="place")
    used = out.groupby("sequence_id")["length"].sum()
    assert len(out) == 6000 == out["place"].nunique() and used.max() <= 2048 and len(used) == out["n_sequences"][0] <= packing.best_fit(sizes, 2048)[2] + 4
    ends = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (ends["offset"].apply(list) == ends["length"].apply(lambda x: [0, *np.cumsum(x)[:-1]])).all()
    assert packing.packed_pieces(empty, BYTE, 0).count() == 0


def test_capacity_tree():
    r, tree, keys = random.Random(3), sharding.CapacityTree(), set()
    for k in range(2000):
        if keys and r.random() < 0.4:
            key = r.choice(sorted(keys))
            tree.remove(key)
            keys.discard(key)
        else:
            key = (r.randint(0, 50), k)
            tree.add(key)
            keys.add(key)
        size = r.randint(0, 55)
        assert tree.tightest(size) == min((x for x in keys if x[0] >= size), default=None)


def test_sharding(spark, texts, odd, empty):
    for rows, source in ((queries.op9_sharding(spark, SF_DIR).collect(), texts), (sharding.balanced_shards(odd, 3).collect(), None)):
        shards = collections.defaultdict(list)
        for r in rows:
            shards[r["shard"]].append(r["slot"])
            if source:
                assert (r["size"], r["text_crc32"]) == (len(source[r["doc_id"]].encode()) + 8, zlib.crc32(source[r["doc_id"]].encode()))
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        groups = collections.defaultdict(set)
        for r in rows:
            groups[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(s) == 1 for s in groups.values())
    assert sharding.balanced_shards(empty).count() == 0
    sizes = collections.Counter()
    for r in queries.op9_sharding(spark, "/root/testdata/sf0.01").collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) <= 1.01 * min(sizes.values())
    many = collections.Counter()  # several levels of partitions
    for r in sharding.balanced_shards(read_table(spark, "/root/testdata/sf0.1", "documents"), 8, per_partition=2500).collect():
        many[r["shard"]] += r["size"]
    assert sorted(many) == list(range(8)) and max(many.values()) <= 1.02 * min(many.values())
    for per_partition, more in ((20_000, 1), (30, 3)):
        packed, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        for r in sharding.fixed_capacity_shards(read_table(spark, SF_DIR, "documents"), 200_000, per_partition).collect():
            packed[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            groups[r["text_crc32"], r["size"]].add(r["shard"])
            assert not r["over_capacity"]
        assert max(packed.values()) <= 200_000 and len(packed) <= -(-sum(packed.values()) // 200_000) + more
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in groups.values())
    rows = sharding.fixed_capacity_shards(odd, 1000).collect()
    assert len(rows) == odd.count() and {r["over_capacity"] for r in rows if r["size"] > 1000} == {True} and not any(r["over_capacity"] for r in rows if r["size"] <= 1000)


def test_best_fit_decreasing_against_brute_force():
    """Each item in turn, largest first, to the fullest bin that holds it."""
    r = random.Random(7)
    for _ in range(100):
        sizes, capacity = [r.randint(1, 60) for _ in range(r.randint(0, 40))], 60
        rooms, expected = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fitting = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
            if not fitting:
                rooms.append(capacity)
            expected[i] = min(fitting)[1] if fitting else len(rooms) - 1
            rooms[expected[i]] -= sizes[i]
        assert sharding.best_fit_decreasing(sizes, capacity) == expected


def components(rows, size=4, percent=80):
    sets = []
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((2**63 - 1 if i is None else i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_near_duplicates(spark, docs, odd, empty):
    take = lambda d: sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], 2**63 - 1 if r["component_id"] is None else r["component_id"]) for r in d.collect())
    assert take(minhash.near_duplicates(docs)) == components([(r["doc_id"], r["text"]) for r in docs.collect()])
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    made = []
    for k in range(60):  # near copies around the threshold, so that links chain
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        made.append((k, " ".join(w)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    for block in (minhash.BLOCK, 7):
        old, minhash.BLOCK = minhash.BLOCK, block
        try:
            assert take(minhash.near_duplicates(frame)) == components(made)
        finally:
            minhash.BLOCK = old
    assert take(minhash.near_duplicates(odd)) == components([(x["doc_id"], x["text"]) for x in odd.collect()])
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.one_of_each(odd).columns == odd.columns and minhash.one_of_each(odd).where("text = 'one'").count() == 1


def test_circulant_signatures_estimate_jaccard():
    c, rng = minhash.Circulant(512), np.random.Generator(np.random.PCG64(9))
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    assert abs((c.signature(a) == c.signature(b)).mean() - 800 / 1200) < 0.08
