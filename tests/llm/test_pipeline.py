"""The pipeline's stages in order, each on what the one before has kept."""

import corpus_pipeline
from tidegrid.llm.common import read_table, written

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read_table(spark, SF_DIR, "documents")
    labels = {r["doc_id"]: r for r in read_table(spark, SF_DIR, "labels").collect()}
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF_DIR), name))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert all(d.columns == columns for d in kept[1:-1]) and all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    good = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in ids[1] for i in good) >= 0.98 * len(good)
    clean = [i for i in ids[1] if i in labels and labels[i]["toxic"] == 0]
    assert sum(i in ids[2] for i in clean) >= 0.99 * len(clean)
    assert kept[4].where("n_chars <> length(text)").count() == 0 and ids[4] == ids[3] == ids[5]


def test_the_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_an_empty_table(spark):
    docs = read_table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
