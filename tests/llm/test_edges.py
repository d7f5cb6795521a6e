"""Odd columns, very long texts, and verdicts against plain Python."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from tidegrid.llm import bpe, flac, minhash, packing, quality, rules, sharding, substring, tokenids, toxicity
from tidegrid.llm.common import bloom_of, looked_up, read_table

SF_DIR = "/root/testdata/sf0.001"
WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
CLASHING = ["tie", "id_key", "spans", "_n", "_tie", "_id_key", "_spans", "n", "salt_", "node", "hub", "bucket", "label", "score", "kept", "size", "length", "place", "features", "Key"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows with nulls in every column, repeats, and columns of names that the operators use inside."""
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [passage, f"{passage} tail", f"head {passage}", None, "", "one two", passage, "A clean text of a few plain words that says nothing much. " * 6]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    rows += [(0, passage), (0, passage), (1, "other words under one id")]
    columns = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *(None if k == n % 7 else f"{c}-{n}" for k, c in enumerate(CLASHING))) for n, (i, t) in enumerate(rows)], columns)


def rest(rows):
    return {tuple(r[c] for c in CLASHING) for r in rows}


def test_stages_keep_columns_of_any_name(spark, clashing):
    given = clashing.collect()
    cut = substring.without_repeats(clashing, bits=12)
    assert cut.columns == clashing.columns
    got = cut.collect()
    assert rest(got) == rest(given) and len(got) == len(given)
    texts = collections.defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append(r["text"])
    assert texts[1] == ["tail", "other words under one id"] or sorted(texts[1]) == ["other words under one id", "tail"]
    assert texts[2] == ["head"] and texts[3] == [None] and texts[6] == [""]
    once = minhash.one_of_each(clashing, size=5)
    assert once.columns == clashing.columns
    left = once.collect()
    assert rest(left) <= rest(given) and len([r for r in left if r["doc_id"] == 0]) == 1 and not [r for r in left if r["doc_id"] == 6]
    labels = spark.createDataFrame([(0, 0), (1, 0), (7, 1), (2, 1)], "doc_id long, toxic int")
    for made in (quality.kept(clashing), toxicity.clean(clashing, labels)):
        assert made.columns == clashing.columns and rest(made.collect()) <= rest(given)
    assert packing.packed_pieces(clashing, BYTE, 0).count() == len(given)
    assert quality.judge(clashing, quality.fit(clashing)).count() == len(given)
    assert sum(r["n"] for r in sharding.balanced_shards(clashing, 3).groupBy("shard").agg({"slot": "count"}).withColumnRenamed("count(slot)", "n").collect()) == len(given)


def test_one_text_longer_than_a_step(spark):
    """Nine megabytes of words: longer than what a worker reads at once, and than the tables of permutations are for."""
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(1_250_000)]
    long, near = " ".join(base), " ".join(base[: len(base) - 1000])
    frame = spark.createDataFrame([(1, long), (2, near), (3, "short text")], "doc_id long, text string").repartition(3)
    assert len(long) > 8 << 20
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.dedup_windows(frame).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (1_250_000, 0), 2: (1_249_000, 1_249_000), 3: (2, 0)}
    assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3}
    assert quality.judge(frame, quality.fit(frame)).count() == 3 and rules.judge(frame, frame.where("doc_id = 3")).where("n_words = 1250000").count() == 1
    n = {x["doc_id"]: x["n"] for x in packing.packed_pieces(frame, BYTE, 0).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert n[1] > n[2] > 1_249_000
    one = frame.where("doc_id = 2")
    media = flac.media_features(flac.text_media(one)).first()
    assert media["n_bytes"] == len(near) and media["payload_bytes"] == -(-len(near) // 64) * 64
    assert bpe.encode_and_decode(one, RANKS, public_tokenizers.PATTERN).first()["n_tokens"] > 1_249_000
    labels = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(frame, labels).count() == 3


def test_sets_across_the_size_of_the_tables(spark):
    """Near copies on both sides of the largest set that the tables are for."""
    base = [f"x{i}" for i in range(minhash.LARGE + 1500)]
    frame = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[3000:])), (3, " ".join(f"y{i}" for i in range(70000)))], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"] > minhash.LARGE, x["component_id"]) for x in minhash.near_duplicates(frame).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 3)}


def pairs_near_the_threshold(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        size = r.choice([30, 80, 200, 500])
        a = [f"t{r.randrange(10**9)}" for _ in range(size)]
        b = list(a)
        for _ in range(max(1, round(size * r.uniform(0.005, 0.03)))):
            b[r.randrange(size)] = f"u{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return rows


def linked(rows, size=4, percent=80):
    def shingles(t):
        w = words(t)
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    out = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a), shingles(b)
        out[i], out[j] = i, i if 100 * len(x & y) >= percent * len(x | y) else j
    return out


def test_recall_near_the_threshold(spark):
    """1,000 pairs of similarity 0.6 to 0.95: the default misses none of them, and neither does the exact mode."""
    rows = pairs_near_the_threshold(1000, 3)
    want = linked(rows)
    assert 200 < sum(want[i] == want[i + 1] for i in range(0, 2000, 2)) < 990
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for exact in (False, True):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, exact=exact).collect()}
        assert got == want


def test_exact_mode_on_documents(spark):
    docs = read_table(spark, SF_DIR, "documents")
    take = lambda **o: sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, **o).collect())
    assert take(exact=True) == take()


def test_three_near_copies_of_which_two_share_an_id(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(base)), (3, " ".join([*base[:-1], "a"])), (3, " ".join(["b", *base[1:]]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (3, 3), (7, 3)]


def test_hot_keys_are_looked_up_in_parts(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 4000, 1, id) as k")
    table = spark.range(4500).selectExpr("id as k", "id * 2 as v")
    got = looked_up(rows, "k", table, "id")
    assert got.columns == ["k", "id", "v"] and got.count() == 4500 and got.where("k = 1 and v = 2").count() == 4000


def test_bloom_filter_holds_all_keys(spark):
    bloom = bloom_of(spark.range(20000).selectExpr("xxhash64(id) as k"))
    keys = np.array([r["k"] for r in spark.range(40000).selectExpr("xxhash64(id) as k").collect()])
    there = bloom.holds(keys)
    assert there[:20000].all() and there[20000:].mean() < 0.2
    assert not bloom_of(spark.range(0).selectExpr("id as k")).holds(np.array([5])).any()


MASK = (1 << 64) - 1


def mixed(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def test_toxicity_scores_against_plain_python(spark):
    docs, labels = read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels")
    model = toxicity.fit(docs, labels.selectExpr("doc_id", "toxic as label"))
    texts = {r["doc_id"]: r["text"] for r in docs.limit(40).collect()} | {-1: "", -2: "Ünï  Çode\n日本語テキスト", -3: "abc"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.scored(frame, model).collect():
        low, found = " " + re.sub(r"\s+", " ", texts[r["doc_id"]].lower()) + " ", set()
        for n in toxicity.LENGTHS:
            for k in range(len(low) - n + 1):
                code = n
                for c in low[k : k + n]:
                    code = (code * 0x100000001B3 + ord(c)) & MASK
                found.add(mixed(code) >> (64 - toxicity.BITS))
        z = model.constant + sum(float(model.weights[f]) for f in found)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-50, min(50, z))))) < 1e-5


def test_likelihood_ratios_against_plain_python(spark):
    docs = read_table(spark, SF_DIR, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x\n\n y\t z "), (-4, "long words " * 3000), (-5, "no id")], "doc_id long, text string").selectExpr("if(doc_id = -5, null, doc_id) as doc_id", "text"))
    trusted = docs.where("doc_id % 3 = 0").select("doc_id").unionByName(docs.where("doc_id is null").select("doc_id"))
    rows = docs.collect()

    def buckets(text):
        tokens = [t for w in words(text) for t in re.findall(r"\w+|[^\w\s]+", w.lower())]
        h = [xxhash.xxh3_64_intdigest(t.encode(), 0) for t in tokens]
        return [mixed(x) >> (64 - rules.BITS) for x in h] + [mixed((a * 0x9E3779B97F4A7C15 + b) & MASK) >> (64 - rules.BITS) for a, b in zip(h, h[1:], strict=False)]

    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(buckets(r["text"]))
        if r["doc_id"] is not None and r["doc_id"] % 3 == 0:
            target.update(buckets(r["text"]))
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), 1 << rules.BITS
    prior = lambda b: (raw[b] + 1) / (n_raw + size)
    weight = lambda b: math.log((target[b] + rules.PRIOR * prior(b)) / (n_target + rules.PRIOR) / prior(b))
    want = {}
    for r in rows:
        own = buckets(r["text"])
        want[r["doc_id"]] = sum(map(weight, own)) / max(1, len(own))
    for r in rules.judge(docs, trusted).collect():
        assert abs(r["ratio"] - want[r["doc_id"]]) < 1e-9 and r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= rules.THRESHOLD)
        w = words(next(x["text"] for x in rows if x["doc_id"] == r["doc_id"]))
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (len(w), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_expectation_maximisation_finds_the_labellers_accuracies():
    rng = np.random.Generator(np.random.PCG64(5))
    n, accuracy = 40_000, np.linspace(0.7, 0.97, quality.LABELLERS)
    good = rng.random(n) < 0.7
    votes = np.where(rng.random((n, quality.LABELLERS)) < accuracy, good[:, None], ~good[:, None]).astype(np.int64)
    votes[rng.random(votes.shape) < 0.3] = quality.NONE
    pattern, counts = np.unique((votes * 3 ** np.arange(quality.LABELLERS)).sum(1), return_counts=True)
    model = quality.fit_labels(pattern, counts.astype(float))
    assert np.abs(model.accuracy() - accuracy).max() < 0.02 and abs(model.prior - 0.7) < 0.02
    posterior = dict(zip(pattern.tolist(), model.posterior(pattern).tolist(), strict=True))
    right = [(posterior[p] > 0.5) == g for p, g in zip((votes * 3 ** np.arange(quality.LABELLERS)).sum(1).tolist(), good.tolist(), strict=True)]
    assert sum(right) / n > 0.97


def test_quality_sample_does_not_depend_on_order_or_repeats(spark):
    docs = read_table(spark, SF_DIR, "documents").select("doc_id", "text")
    first = quality.fit(docs.repartition(5), sample=50).weights
    again = quality.fit(docs.unionByName(docs.where("doc_id < 20")).orderBy("text"), sample=50)
    assert quality.fit(docs.orderBy("text"), sample=50).weights.tolist() == first.tolist() and len(again.weights) == len(first)


def test_added_tokens_are_found_as_the_library_does(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "plain", "<|endoftext|><|startoftext|> x  y", ""]
    for path, spaced in ((WORD, False), (BYTE, True)):
        library = Tokenizer.from_file(path)
        from tidegrid.llm.pieces import TokenizerCodec

        ids, counts = TokenizerCodec(path, spaced).encode(pa.array(texts, pa.large_string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_blocks_hold_whole_documents(spark, tmp_path):
    docs = read_table(spark, SF_DIR, "documents")
    tokenids.write_token_ids(docs, str(tmp_path / "t"), WORD, 1, block_tokens=5000)
    some = {r["doc_id"]: len(r["ids"]) for r in tokenids.documents_by_id(spark, str(tmp_path / "t"), [0, 7, 199, 10**9]).collect()}
    all_ = {r["doc_id"]: r["n_tokens"] for r in tokenids.read_token_ids(spark, str(tmp_path / "t")).collect()}
    assert some == {i: all_[i] for i in (0, 7, 199)}


def test_ranges_in_steps_remove_the_same(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = lambda **options: sorted(map(tuple, substring.dedup_windows(docs, bits=14, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    want = rows()
    assert sum(r[2] for r in want) > 100
    for fan in (3, 8):  # three steps and two
        assert rows(range_bytes=20_000, fan=fan) == want
