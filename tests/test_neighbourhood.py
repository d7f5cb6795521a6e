"""Relations that roles may see, and a report's context."""

import pytest

from tidegrid.operators import graph

RELATIONS = [
    (1, "a", "COMPANY", "b", "TARGET", 1, 1, 10, "2024", "REPORT"), (2, "a", "COMPANY", "c", "NEWS", 1, 1, 10, "2024", "POLICY"), (3, "b", "COMPANY", "a", "FINANCIAL", 2, 1, 11, "2023", "NEWS"),
    (4, "a", "COMPANY", "d", "TARGET", 1, 0, 12, "2024", "REPORT"), (5, "a", "COMPANY", "e", "TARGET", 3, 1, 13, "2024", "REPORT"), (6, "x", "COMPANY", "y", "TARGET", 1, 1, 14, "2024", "REPORT"),
]


@pytest.fixture(scope="module")
def frames(spark):
    relations = spark.createDataFrame(RELATIONS, "id int, from_name string, from_type string, to_name string, to_type string, source_id int, version_id int, chunk_id int, period string, data_type string")
    return relations, spark.createDataFrame([(1, 1, None), (2, 1, "7,8"), (3, 1, "9")], "source_id int, current_version int, allowed_roles string")


def test_neighbourhoods(frames):
    ids = lambda **options: [r["id"] for r in graph.neighbourhood(*frames, **options).collect()]
    assert ids(names=["a"]) == [2, 1] and ids(names=["a"], roles=["8"]) == [3, 2, 1] and ids(names=["a"], admin=True) == [5, 3, 2, 1] and ids(names=["a"], admin=True, limit=2) == [5, 3]
    assert ids(names=["a"], admin=True, data_type="FINANCIAL") == [5, 3, 1] and ids(names=["a"], admin=True, data_type="NEWS") == [3, 2] and ids(names=["a"], admin=True, data_type="POLICY") == [2]
    assert ids(names=["a"], admin=True, period="2023") == [3] and ids(names=["a"], admin=True, of_sources=[2, 3]) == [5, 3]
    assert ids(chunks=[12, 13]) == [4] and ids(chunks=[]) == [] and ids(names=["none"]) == [] and ids(chunks=[10], limit=0) == [2]
    with pytest.raises(ValueError, match="either"):
        graph.neighbourhood(*frames, names=["a"], chunks=[1])


def test_report_context(spark):
    rows = [
        (1, "v", 1, "market.meta", "t", "abc"), (2, "v", 2, "market.meta", "t", "bcd"), (3, "v", 3, "market.meta", "u", "other path"), (4, "v", 4, "X.FACT_PACK", None, "pack"), (5, "v", 5, None, None, 'a "对象" of 销量/数值'),
        (6, "v", 6, None, None, "nothing"), (7, "w", 1, "market.top_model", "t", "another report"), (8, "w", 2, "own", "t", "found"), (9, "w", 3, None, None, "alone"),
    ]
    chunks = spark.createDataFrame(rows, "id int, version string, chunk_no int, metric_id string, title_path string, content string")
    got = graph.report_context(spark.createDataFrame([(1,), (1,), (8,), (9,)], "id int"), chunks).collect()
    assert sorted((r["version"], r["metric_id"] or "", r["content"], r["is_found"]) for r in got) == [
        ("v", "", 'a "对象" of 销量/数值', False), ("v", "X.FACT_PACK", "pack", False), ("v", "market.meta", "abcd", True), ("w", "", "alone", True), ("w", "own", "found", True),
    ]
