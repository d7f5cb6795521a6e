"""Files by their names and tables that nobody has listed."""

import pytest

from tidegrid.sources import files, tables


def test_files_by_name(spark, tmp_path):
    path = tmp_path / "A.CSV"
    path.write_text("a,b\n1,2\n")
    assert [tuple(r) for r in files.read_table_file(spark, str(path)).collect()] == [("1", "2")]
    for name in ("x.xlsx", "x", "csv"):
        with pytest.raises(ValueError, match="no reader"):
            files.read_table_file(spark, name)


def test_tables_that_are_not_listed(spark):
    spark.range(1).createOrReplaceTempView("Seen_one")
    spark.range(1).createOrReplaceTempView("new_one")
    known = spark.createDataFrame([("SEEN_ONE",), ("gone",), (None,)], "table string")
    found = {r["table"]: r["kind"] for r in tables.unregistered(spark, known).collect()}
    assert "new_one" in found and not any(t.lower() == "seen_one" for t in found) and found["new_one"] == "TEMPORARY"
