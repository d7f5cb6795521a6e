"""Reports of hand-made depth, broken ones, and JSON cut out of text."""

import json

from tidegrid.operators import reports as op

REPORT = {
    "computed_metrics": {"a": [{"metric_id": "m1"}, {"x": {"metric_id": "m1", "v": [1, {"evidence": 2, "k": 3}], "comparison_evidence": "c"}}], "b": {"metric_id": " ", "v": 1}, "c": {"metric_id": "m2", "in": {"metric_id": "hidden"}}, "d": 5},
    "evidence": [{"metric_id": "m2", "evidence": {"file": "f"}}, {"metric_id": "m2", "evidence": "second"}, 7, {"metric_id": None}],
    "insights": [["one", {"deep": " one\n two "}], "one"], "other": {"drivers": "three", "quality": {"overview": "no"}}, "overview": 5,
    "narrative_sources": [{"conclusion": "one  two", "metric_ids": ["m2"], "evidence": [1]}, {"conclusion": None}, {"conclusion": "four"}], "data_gaps": ["g"],
}


def rows_of(spark, *contents):
    df = spark.createDataFrame([(k, "t", "m", c, 1) for k, c in enumerate(contents)], "report_id int, report_type string, generation_mode string, content string, nr int")
    return [(r["report_id"], r["kind"], r["key"], r["content"], r["json_path"], r["evidence"]) for r in op.projected(df).orderBy("report_id", "nr").collect()]


def test_projection(spark):
    got = rows_of(spark, json.dumps(REPORT))
    assert [g[1:3] for g in got] == [("METRIC", "m1"), ("METRIC", "m2"), ("DATASET", "dataset.d"), ("CONCLUSION", ""), ("CONCLUSION", "m2"), ("CONCLUSION", ""), ("CONCLUSION", ""), ("METADATA", "")]
    assert got[0][3:] == ('{"metric_id":"m1","v":[1,{"k":3}]}', "$.computed_metrics.a[0]", '{"comparison_evidence":"c"}')
    assert got[1][3:] == ('{"metric_id":"m2","in":{"metric_id":"hidden"}}', "$.computed_metrics.c", '{"file":"f"}')
    assert [g[3] for g in got[3:7]] == ["结论：one", "结论：one  two", "结论：three", "结论：four"] and json.loads(got[4][5])["source_evidence"] == [1]
    assert json.loads(got[7][3]) == {"report_id": 0, "report_type": "t", "generation_mode": "m", "data_gaps": ["g"]}


def test_broken_and_deep_reports(spark):
    deep = '{"computed_metrics":' + '{"a":' * 300 + '{"metric_id":"low"}' + "}" * 301
    got = rows_of(spark, None, "", "{", "[1]", "null", "{}", deep, '{"computed_metrics":' + "[" * 100000)
    assert [(g[0], g[2]) for g in got] == [(6, "low")] and got[0][4] == "$.computed_metrics" + ".a" * 300


def test_balanced_slices(spark):
    text = 'x "k" : {"a": "}\\"}", "b": {"c": [1, "]"]}} {"k": {}} "l": [[1], {"z": "["}] "m": {"open": "}"'
    assert op.balanced(text, "k", "{") == '{"a": "}\\"}", "b": {"c": [1, "]"]}}' and op.balanced(text, "l", "[") == '[[1], {"z": "["}]'
    assert op.balanced(text, "m", "{") is None and op.balanced(None, "k", "{") is None and op.balanced("", "k", "{") is None and op.balanced(text, "none", "{") is None
    assert op.balanced('"k": "a } {" ' + "{" * 50000 + "}" * 50000, "k", "{") == "{" * 50000 + "}" * 50000
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(op.balanced_slice(df.t, "l", "[")).collect()] == ['[[1], {"z": "["}]', None]


def test_labels_and_own_names(spark):
    ranked = '"对象": "%s" , "销量/数值": 3.5'
    content = '"display_label": "week 9", "latest_period": "2024-01" top_model ' + " ".join(ranked % m for m in ("Acme", "Acme X1", "Y2"))
    df = spark.createDataFrame([(content, "ACME news"), (content, "other"), (None, "acme"), ('{"rankings": {"model": [' + ranked % "Z" + "]}}", "acme")], "content string, names string")
    assert [(r["nr"], r["model"], r["units"], r["fact"]) for r in op.model_rankings(df, "Acme").collect()] == [
        (1, "Acme X1", 3.5, "week 9Acme车型Acme X1销量为3.5辆"), (2, "Y2", 3.5, "week 9Acme车型Y2销量为3.5辆"), (1, "Z", 3.5, "Acme车型Z销量为3.5辆"),
    ]
