"""Text files of unknown encoding and separator, and datasets as folders: rows by sheet and a description beside them."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried, by Python's and by Java's name.
ENCODINGS = [("utf-8-sig", "UTF-8"), ("gb18030", "GB18030"), ("gbk", "GBK")]
SEPARATORS = [",", "\t", ";", "|"]
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a run on one machine may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.get("dir") or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tidegrid-"))
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidegrid/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, where their lineage ends."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def separator(head: str) -> str:
    """The separator that every line holds equally often, most often."""
    lines = [x for x in head.splitlines()[:20] if x.strip()]
    counts = {s: [x.count(s) for x in lines] for s in SEPARATORS}
    even = [s for s in SEPARATORS if lines and min(counts[s]) > 0 and min(counts[s]) == max(counts[s])]
    best = max(even or SEPARATORS, key=lambda s: (sum(counts[s]), -SEPARATORS.index(s)))
    return best


def dialect(head: bytes) -> tuple[str, str]:
    """Java's name of the first encoding that these bytes are valid in, and their separator. ``head`` may end inside a character."""
    for name, java in ENCODINGS:
        try:
            return java, separator(head.decode(name))
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 4:
                return java, separator(head[: e.start].decode(name))
    return "UTF-8", separator(head.decode("utf-8", "replace"))


@contextlib.contextmanager
def encodings_allowed(spark: SparkSession) -> Iterator[None]:
    """Within it, the session reads and writes encodings beyond the Unicode and Latin ones."""
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def encoding_of(lines: DataFrame) -> tuple[str, str, bool]:
    """Python's and Java's name of the first encoding that every line (column ``value``, bytes) is valid in, and whether
    quotes span lines. One scan; an error names how many lines are valid in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, odd = [0] * len(ENCODINGS), 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if line:
                    odd += line.count(b'"') % 2
                    if not line.isascii():
                        for k, (name, _) in enumerate(ENCODINGS):
                            try:
                                line.decode(name)
                            except UnicodeDecodeError:
                                bad[k] += 1
        yield pa.RecordBatch.from_pydict({"bad": [bad], "odd": [odd]})

    found = lines.select("value").mapInArrow(run, "bad array<long>, odd long")
    sums = found.agg(*(F.sum(F.col("bad")[k]).alias(f"n{k}") for k in range(len(ENCODINGS))), F.sum("odd").alias("odd")).first()
    for k, names in enumerate(ENCODINGS):
        if not sums[k]:
            return *names, bool(sums["odd"])
    raise ValueError("lines that aren't valid: " + ", ".join(f"{sums[k]} as {names[0]}" for k, names in enumerate(ENCODINGS)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings; only empty fields are null. All lines, read byte for byte, tell the encoding, the first ones the separator.

    A file is one task only where quotes span lines. Other encodings than UTF-8 are read once and stored as a table, as
    the setting that they need holds for the session."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("value"))
    name, java, spans = encoding_of(lines)
    head = b"\n".join(bytes(r[0]) for r in lines.limit(20).collect()).decode(name)
    reader = spark.read.option("header", True).option("encoding", java).option("sep", separator(head)).option("nullValue", "").option("multiLine", spans)
    if java == "UTF-8":
        return reader.csv(path)
    with encodings_allowed(spark):
        return written(reader.csv(path), "csv")


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """A file by the end of its name: comma-separated text is read; workbooks must be landed as cells first."""
    if path.lower().rstrip("/").endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError(f"no reader for {path!r}: only .csv; workbooks are read as cells (file, sheet, row, col, value)")


def _folder(root: str, name: str) -> str:
    if not name or "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError(f"not the name of a dataset: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def save_dataset(rows: DataFrame, root: str, name: str, by: list[str], about: dict) -> None:
    """The rows as Parquet, a folder a sheet, and what there is to know about them as one JSON file."""
    folder, spark = _folder(root, name), rows.sparkSession
    rows.write.partitionBy(*by).mode("overwrite").parquet(f"{folder}/rows")
    spark.createDataFrame([(json.dumps(about | {"columns": rows.columns}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{_folder(root, name)}/rows")


def describe_dataset(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{_folder(root, name)}/about").first()[0])


def _delete(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True))


def delete_dataset(spark: SparkSession, root: str, name: str) -> bool:
    """The dataset with all that belongs to it; only what lies directly under ``root`` can be named."""
    return _delete(spark, _folder(root, name))


def delete_sheet(spark: SparkSession, root: str, name: str, column: str, value: str) -> bool:
    """One sheet's rows."""
    if "/" in value or value in ("", ".", ".."):
        raise ValueError(f"not the name of a sheet: {value!r}")
    return _delete(spark, f"{_folder(root, name)}/rows/{column}={value}")
