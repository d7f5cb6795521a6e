"""Benchmark passages: brute force, the way of the join against that of the hash set, cut texts and odd inputs."""

import hashlib
import random
import re

import pytest

from tidegrid.llm import decontamination, queries
from tidegrid.llm.common import read_table

SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= own
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    r = random.Random(3)
    vocabulary = ["a", "bb", "Ccc", "été", "42", "x9", "日本"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\t!"]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 9, 10, 14, 40]))) for k in range(25)] + [(3, text(12)), (None, text(11)), (77, None), (78, " ,.- ")]
    items = [(i, t) for i, t in items if len(words(t)) > 2 or not words(t)]
    docs = [(k, text(r.choice([0, 2, 8, 30])) + (r.choice(items)[1] or "") + text(r.choice([0, 5]))) for k in range(60)]
    docs += [(90, None), (91, ""), (92, " - "), (1, docs[0][1]), (1, docs[0][1]), (None, docs[3][1]), (93, text(20000) + (items[2][1] or ""))]
    return docs, items


@pytest.mark.parametrize("most", [decontamination.MOST, 0])
def test_brute_force(spark, made, most):
    docs, items = made
    d = spark.createDataFrame([(i, t, 1, "s", [2], 3) for i, t in docs], "doc_id long, text string, n_words int, spans string, items array<int>, id_key int").repartition(3)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, words int")
    assert rows_of(decontamination.contamination(d, b, most=most)) == brute_force(docs, items)
    out = decontamination.marked(d, b, most=most)
    assert out.columns == [*d.columns, "n_words_", "spans_", "items_"] and out.select(*d.columns).exceptAll(d).count() == 0


@pytest.mark.parametrize("most", [decontamination.MOST, 0])
def test_cuts(spark, most):
    passage = "One two, THREE four five six seven eight nine TEN eleven."
    docs = spark.createDataFrame(
        [(1, f"Before. {passage} After.", 7), (2, "One two three four five six seven eight nine, not ten.", 7), (3, None, None), (4, passage, 7), (5, f"é {passage[:-1]} twelve", 7)], "doc_id long, text string, kept int"
    )
    items = spark.createDataFrame([("x", passage), ("y", None)], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.without_passages(docs, items, most=most).collect()}
    assert got == {1: "Before. . After.", 2: "One two three four five six seven eight nine, not ten.", 3: None, 4: ".", 5: "é  twelve"}
    assert {r["doc_id"] for r in decontamination.without_documents(docs, items, most=most).collect()} == {2, 3}
    assert decontamination.without_documents(docs, items).columns == docs.columns


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    none = hashlib.sha256(b"").hexdigest()
    for most in (decontamination.MOST, 0):
        assert rows_of(decontamination.contamination(docs, items.limit(0), most=most)) == [(1, 2, 0, 0, none, False)]
        assert rows_of(decontamination.contamination(docs.limit(0), items, most=most)) == []
        assert rows_of(decontamination.contamination(docs, items, most=most)) == [(1, 2, 1, 1, hashlib.sha256(b"x").hexdigest(), True)]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, SF_DIR, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF_DIR, "benchmark").collect()]
    assert rows_of(queries.op11_decontamination(spark, SF_DIR)) == brute_force(docs, items)
