"""Sheets as cells: rows of file, sheet, row, col (from 1) and value (string). One sheet is small; there are many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import headers
from tidegrid.functions.values import extract_yoy, normal_text, parse_numeric, parse_period

SHEET = ["file", "sheet"]


def is_number(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")).rlike(r"^\s*[+-]?\d+(?:\.\d+)?\s*$")


def filled_rectangles(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """The cells with each merged rectangle (file, sheet, top, left, bottom, right) filled with its first cell's value."""
    root = cells.select(*SHEET, F.col("row").alias("top"), F.col("col").alias("left"), "value")
    over = merged.join(root, [*SHEET, "top", "left"], "left")
    spread = over.select(*SHEET, "value", "left", "right", F.explode(F.sequence("top", "bottom")).alias("row")).select(*SHEET, "row", F.explode(F.sequence("left", "right")).alias("col"), F.col("value").alias("own"), F.lit(True).alias("in_merged"))
    joined = cells.join(spread, [*SHEET, "row", "col"], "full")
    return joined.select(*SHEET, "row", "col", F.when(F.col("in_merged"), F.col("own")).otherwise(F.col("value")).alias("value"))


def header_scores(cells: DataFrame, first: int = 100) -> DataFrame:
    """file, sheet, row and score of the first rows with two filled cells or more.

    Ten points a registered name, two a cell of the longest run of filled cells, one a text, seven a period; 25 more
    for six periods or 10 for two; ten less for rows of two cells that say neither."""
    text = normal_text(F.col("value"))
    filled = cells.where((F.col("row") <= first) & (text != ""))
    # Cells of one run share the difference of their column and their place in the row.
    run = F.col("col") - F.row_number().over(Window.partitionBy(*SHEET, "row").orderBy("col"))
    runs = filled.select(*SHEET, "row", "value", run.alias("run")).groupBy(*SHEET, "row", "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(headers.field_of(F.col("value")).isNotNull()).alias("names"),
        F.count_if(~is_number(F.col("value"))).alias("texts"),
        F.count_if(headers.is_period_header(F.col("value"))).alias("periods"),
    )
    rows = runs.groupBy(*SHEET, "row").agg(F.sum("n").alias("n"), F.max("n").alias("longest"), F.sum("names").alias("names"), F.sum("texts").alias("texts"), F.sum("periods").alias("periods")).where("n >= 2")
    bonus = F.when(F.col("periods") >= 6, 25).when(F.col("periods") >= 2, 10).otherwise(0)
    poor = F.when((F.col("n") <= 2) & (F.col("names") < 2) & (F.col("periods") < 2), 10).otherwise(0)
    return rows.select(*SHEET, "row", (F.col("names") * 10 + F.col("longest") * 2 + F.col("texts") + F.col("periods") * 7 + bonus - poor).alias("score"))


def header_rows(cells: DataFrame) -> DataFrame:
    """file, sheet, header_row and score: the best row of each sheet, the first of equals, if it has six points."""
    best = header_scores(cells).groupBy(*SHEET).agg(F.max(F.struct("score", -F.col("row"))).alias("best"))
    return best.select(*SHEET, (-F.col("best.col2")).alias("header_row"), F.col("best.score").alias("score")).where("score >= 6")


def header_cells(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """The headers below which a sheet's data lie: col, header (repeats numbered: x, x_2), field and is_period.

    Of headers that name one field the first counts."""
    own = cells.join(rows.select(*SHEET, "header_row"), SHEET).where("row = header_row").select(*SHEET, "header_row", "col", normal_text(F.col("value")).alias("base"))
    own = own.withColumn("base", F.when(F.col("base") == "", "未命名列").otherwise(F.col("base")))
    nth = F.row_number().over(Window.partitionBy(*SHEET, "base").orderBy("col"))
    own = own.withColumn("header", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), nth.cast("string"))))
    own = own.withColumns({"named": headers.field_of(F.col("header")), "is_period": headers.is_period_header(F.col("header"))})
    first = F.row_number().over(Window.partitionBy(*SHEET, "named").orderBy("col")) == 1
    return own.withColumn("field", F.when(first, F.col("named"))).drop("base", "named")


def letters(col: Column) -> Column:
    """A column's letters, A for 1 and AA for 27 (up to ZZ)."""
    char = lambda n: F.char(n + 64)
    return F.when(col <= 26, char(col)).otherwise(F.concat(char(F.floor((col - 1) / 26).cast("int")), char((F.pmod(col - 1, F.lit(26)) + 1).cast("int"))))


def long_table(cells: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """A sheet whose headers hold two periods or more as a row for each number below them: the fields of its other
    columns as a map, time_period, the value as ``metric`` and where it comes from. Cells without a number drop."""
    heads = header_cells(cells, rows)
    wide = heads.groupBy(*SHEET).agg(F.count_if("is_period").alias("n_periods")).where("n_periods >= 2").select(*SHEET)
    body = cells.join(heads.join(wide, SHEET, "left_semi"), [*SHEET, "col"]).where("row > header_row")
    dims = body.where("field is not null and not is_period").groupBy(*SHEET, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("dims"))
    facts = body.where("is_period").withColumn(metric, parse_numeric(F.col("value"))).where(F.col(metric).isNotNull())
    return facts.join(dims, [*SHEET, "row"], "left").select(
        F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"), "dims", parse_period(F.col("header")).alias("time_period"), metric,
        F.col("row").alias("source_row"), F.col("header").alias("source_column"), F.concat(letters(F.col("col")), F.col("row").cast("string")).alias("source_cell"),
    )


def standard_frame(records: DataFrame, fields: list[str]) -> DataFrame:
    """Text columns named by ``fields`` as typed ones: metrics as numbers, with the change on the year before that
    their text speaks of (yoy_...); time_period as a period. Where only one of market and vehicle_type is there, the
    other follows: vehicle_type is a market that names a kind of vehicle, market is the vehicle_type."""
    out = {}
    for f in fields:
        if f in headers.METRICS:
            out[f] = parse_numeric(F.col(f))
            if f"yoy_{f}" not in fields and f != "inventory":
                out[f"yoy_{f}"] = extract_yoy(F.col(f))
        elif f.startswith("yoy_"):
            out[f] = parse_numeric(F.col(f))
        elif f == "time_period":
            out[f] = parse_period(F.col(f))
    rows = records.withColumns(out)
    if "market" in fields and "vehicle_type" not in fields:
        rows = rows.withColumn("vehicle_type", F.when(F.col("market").rlike("乘用|商用|新能源|燃油"), F.col("market")))
    elif "vehicle_type" in fields and "market" not in fields:
        rows = rows.withColumn("market", F.col("vehicle_type"))
    return rows


def column_kinds(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """file, sheet, col, header, field, text_ratio and number_ratio of each column below the header row."""
    heads = header_cells(cells, rows)
    body = cells.join(heads, [*SHEET, "col"]).where("row > header_row and value is not null")
    text = normal_text(F.col("value"))
    is_text = text.rlike(r"[A-Za-z一-鿿]") | ((text != "") & ~F.regexp_replace(text, ",", "").rlike(r"^[+-]?\d+(?:\.\d+)?(?:%|万|亿|辆|台)?$"))
    return body.groupBy(*SHEET, "col", "header", "field", "is_period").agg(F.avg(is_text.cast("double")).alias("text_ratio"), F.avg(parse_numeric(F.col("value")).isNotNull().cast("double")).alias("number_ratio"))


def unique_columns(kinds: DataFrame) -> DataFrame:
    """file, sheet, dimension_column and value_column: the one column that may be read so, null where it isn't alone.

    Among unmapped columns of at least 75 % text (90 % numbers) the one with a generic name counts; without any such
    the only one of the others."""
    free = kinds.where("field is null and not is_period")

    def only(enough: Column, generic: list[str]) -> Column:
        named = headers.token(F.col("header")).isin([g.lower() for g in generic])
        pick = lambda c: F.collect_list(F.when(enough & c, F.col("header")))  # noqa: E731  a few columns
        one, other = pick(named), pick(~named)
        return F.when(F.size(one) == 1, F.element_at(one, 1)).when((F.size(one) == 0) & (F.size(other) == 1), F.element_at(other, 1))

    return free.groupBy(*SHEET).agg(
        only(F.col("text_ratio") >= 0.75, headers.GENERIC_DIMENSIONS).alias("dimension_column"), only(F.col("number_ratio") >= 0.9, headers.GENERIC_VALUES).alias("value_column")
    )


_MONTH, _YEAR, _YYYYMM = r"^(?:0?[1-9]|1[0-2])月$", r"^20\d{2}年?$", r"^20\d{2}(?:0[1-9]|1[0-2])(?:\.0)?$"


def structures(cells: DataFrame) -> DataFrame:
    """file, sheet, structure, header_rows and metric of each sheet.

    annual_month_blocks: rows with six months and a year (first 120 rows); yyyymm_wide: the row with most YYYYMM
    headers, two at least; long_table: the row with most registered names, two at least (first 100 rows). The metric
    is the one that the sheet's name names, else the file's, else the only one among a long table's headers."""
    text = F.regexp_replace(F.trim(F.coalesce("value", F.lit(""))), " ", "")
    field = headers.field_of(F.col("value"))
    rows = cells.where("row <= 120").groupBy(*SHEET, "row").agg(
        F.count_if(text.rlike(_YYYYMM)).alias("wide"), F.count_if(text.rlike(_MONTH)).alias("months"), F.count_if(text.rlike(_YEAR)).alias("years"),
        F.count_if(field.isNotNull()).alias("names"), F.collect_set(F.when(field.isin(headers.METRICS), field)).alias("metrics"),
    )
    place = F.struct("names", (-F.col("row")).alias("up"), "metrics")
    sheets = rows.groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.when((F.col("months") >= 6) & (F.col("years") >= 1), F.col("row")))).alias("annual"),
        F.max(F.when(F.col("wide") >= 2, F.struct("wide", "names", F.col("row").alias("at")))).alias("wide"),
        F.max(F.when((F.col("names") >= 2) & (F.col("row") <= 100), place)).alias("long"),
    )
    by_name = F.coalesce(headers.metric_named(F.col("sheet")), headers.metric_named(F.col("file")))
    structure = F.when(F.size("annual") > 0, "annual_month_blocks").when(F.col("wide").isNotNull(), "yyyymm_wide").when(F.col("long").isNotNull(), "long_table").otherwise("unknown")
    found = F.when(F.size("annual") > 0, F.col("annual")).when(F.col("wide").isNotNull(), F.array("wide.at")).when(F.col("long").isNotNull(), F.array(-F.col("long.up"))).otherwise(F.array().cast("array<int>"))
    own = F.when((structure == "long_table") & (F.size("long.metrics") == 1), F.element_at("long.metrics", 1))
    return sheets.select(*SHEET, structure.alias("structure"), found.alias("header_rows"), F.coalesce(by_name, own).alias("metric"))


#: Dimensions that are carried down an annual block, and labels of its total rows.
CARRIED = ["oem", "manufacturer", "brand", "origin_type", "vehicle_type", "region", "size_class"]
BLOCK_TOTALS = ["total", "grandtotal", "总计", "合计", "小计", "全部"]


def annual_blocks(cells: DataFrame, heads: DataFrame, metric: str) -> DataFrame:
    """Stacked blocks, each under a row of dimensions, twelve months and a year, as one row a number.

    ``heads``: file, sheet and header_rows. Rows of totals drop, then dimensions that stay the same are carried down
    their block. A block without a year or with less than six months gives nothing."""
    starts = heads.select(*SHEET, F.explode("header_rows").alias("block"))
    after = F.lead("block").over(Window.partitionBy(*SHEET).orderBy("block"))
    starts = starts.withColumn("until", after)
    inside = cells.join(starts, SHEET).where("row >= block and (until is null or row < until)")
    text = F.regexp_replace(normal_text(F.col("value")), " ", "")
    heads_ = inside.where("row = block").select(
        *SHEET, "block", "col", F.regexp_extract(text, r"^(0?[1-9]|1[0-2])月$", 1).try_cast("int").alias("month"),
        F.regexp_extract(text, r"^(20\d{2})年?$", 1).try_cast("int").alias("year"), headers.field_of(F.col("value")).alias("field"),
    )
    whole = heads_.groupBy(*SHEET, "block").agg(F.min_by("year", F.when(F.col("year").isNotNull(), F.col("col"))).alias("of_year"), F.count("month").alias("n_months")).where("of_year is not null and n_months >= 6")
    body = inside.where("row > block").join(heads_.drop("year").join(whole, [*SHEET, "block"]), [*SHEET, "block", "col"])
    squeezed = F.lower(F.regexp_replace(normal_text(F.col("value")), r"\s+", ""))
    is_sum = F.col("field").isNotNull() & (squeezed.isin(BLOCK_TOTALS) | squeezed.rlike("(total|合计|总计)$"))
    labelled = F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull() & (squeezed != ""), F.struct("field", "value"))))
    rows = body.groupBy(*SHEET, "block", "row").agg(labelled.alias("own"), F.max(is_sum.cast("int")).alias("is_sum"), F.max((squeezed != "").cast("int")).alias("filled")).where("is_sum = 0 and filled = 1")
    down = Window.partitionBy(*SHEET, "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    dims = headers.dimensions()
    carried = {f: F.last(F.col("own")[f], ignorenulls=True).over(down) if f in CARRIED else F.col("own")[f] for f in dims}
    rows = rows.select(*SHEET, "block", "row", *(c.alias(f) for f, c in carried.items()))
    facts = body.where("month is not null").withColumn(metric, parse_numeric(F.col("value"))).where(F.col(metric).isNotNull())
    period = F.format_string("%04d-%02d", "of_year", "month")
    return facts.join(rows, [*SHEET, "block", "row"]).select(
        F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"), *dims, period.alias("time_period"), metric, F.col("row").alias("source_row"), F.concat(letters(F.col("col")), F.col("row").cast("string")).alias("source_cell")
    )


#: Words in the first two cells of rows that close a table.
FOOTERS = ["合计", "总计", "小计", "汇总", "total", "subtotal", "source:"]


def records(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """file, sheet, row and record (header to value, source_cell) of each row that is neither empty nor a footer."""
    heads = header_cells(cells, rows)
    body = cells.join(heads, [*SHEET, "col"]).where("row > header_row")
    entry = F.struct(F.col("header").alias("key"), F.struct("value", F.concat(letters(F.col("col")), F.col("row").cast("string")).alias("source_cell")).alias("value"))
    made = body.groupBy(*SHEET, "row").agg(F.sort_array(F.collect_list(F.struct("col", entry.alias("entry")))).alias("fields"), F.max((F.trim(F.coalesce("value", F.lit(""))) != "").cast("int")).alias("filled"))
    first = F.lower(F.concat_ws(" ", F.transform(F.slice("fields", 1, 2), lambda f: F.trim(f["entry"]["value"]["value"]))))
    closes = F.exists(F.array(*(F.lit(w) for w in FOOTERS)), lambda w: F.contains(first, w))
    return made.where((F.col("filled") == 1) & ~closes).select(*SHEET, "row", F.map_from_entries(F.transform("fields", lambda f: f["entry"])).alias("record"))


def column_bands(cells: DataFrame, gap: int = 2) -> DataFrame:
    """file, sheet, first_row, last_row, first_col, last_col and n_filled of each region: rows, then columns within
    them, split where the next filled one is more than ``gap`` away; regions of four filled cells or more in two columns or more."""
    filled = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "")

    def banded(d: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
        lines = d.select(*by, at).distinct()
        before = F.lag(at).over(Window.partitionBy(*by).orderBy(at))
        lines = lines.withColumn("new", F.coalesce((F.col(at) - before > gap).cast("int"), F.lit(0)))
        lines = lines.withColumn(name, F.sum("new").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))).drop("new")
        return d.join(lines, [*by, at])

    parts = banded(banded(filled, SHEET, "row", "row_band"), [*SHEET, "row_band"], "col", "col_band")
    regions = parts.groupBy(*SHEET, "row_band", "col_band").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count(F.lit(1)).alias("n_filled"), F.countDistinct("col").alias("n_cols"))
    return regions.where("n_filled >= 4 and n_cols >= 2").drop("row_band", "col_band", "n_cols")


#: Words in the headers of shipment tables, and cells that stand for no number.
HEADER_WORDS = ["year", "quarter", "qy", "panel maker", "client", "original specification"]
PLACEHOLDERS = ["", "-", "—", "–", "n/a", "na", "null", "none", "缺失"]


def region_headers(cells: DataFrame, regions: DataFrame, reach: int = 20) -> DataFrame:
    """The regions with ``header_row``: of their first rows the one with most points, the first of equals.

    A point a text, two more for one that holds a header's word, and one for each number in the next row up to three."""
    inside = cells.join(regions, SHEET).where("row between first_row and last_row and col between first_col and last_col")
    text = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    is_text = (text != "") & ~is_number(F.col("value"))
    named = F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(text, w))
    keys = [*SHEET, "first_row", "first_col"]
    rows = inside.groupBy(*keys, "row").agg(F.count_if(is_text).alias("texts"), F.count_if(is_text & named).alias("named"), F.count_if(is_number(F.col("value"))).alias("numbers"))
    below = rows.select(*keys, (F.col("row") - 1).alias("row"), F.least("numbers", F.lit(3)).alias("next_numbers"))
    rows = rows.join(below, [*keys, "row"], "left").where(F.col("row") <= F.col("first_row") + reach)
    points = F.col("texts") + F.col("named") * 2 + F.coalesce("next_numbers", F.lit(0))
    best = rows.groupBy(*keys).agg(F.max(F.struct(points.alias("points"), (-F.col("row")).alias("up"))).alias("best")).where("best.points > 0")
    return regions.join(best.select(*keys, (-F.col("best.up")).alias("header_row")), keys, "left")


def template_checks(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """metric_ok, field_ok, period_ok, value_ok, dimension_ok and status of each sheet.

    The metric must be named (by the sheet, the file or one header); every named column with values must be a
    registered field, a period or one to ignore; periods must be read; every value below a period or a metric must be a
    number or a known placeholder, and there must be one; a dimension must be there. PASS with all five, REVIEW
    otherwise; columns without a header that hold values turn a PASS into CORE_PASS_AUX_REVIEW."""
    heads = header_cells(cells, rows).withColumn("unnamed", F.col("header").rlike("^未命名列(_\\d+)?$"))
    body = cells.join(heads, [*SHEET, "col"]).where("row > header_row")
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    is_metric = F.coalesce(F.col("field").isin(headers.METRICS), F.lit(False))
    placeholder = headers.token(F.col("value")).isin(PLACEHOLDERS)
    columns = body.groupBy(*SHEET, "col", "header", "field", "is_period", "unnamed").agg(
        F.count_if(filled).alias("n_filled"), F.count_if(filled & ~placeholder).alias("n_checked"), F.count_if(filled & ~placeholder & parse_numeric(F.col("value")).isNull()).alias("n_bad")
    )
    ignored = headers.token(F.col("header")).isin(headers.IGNORED)
    unknown = (F.col("n_filled") > 0) & F.col("field").isNull() & ~F.col("is_period") & ~ignored & ~F.col("unnamed")
    numbers = F.col("is_period") | is_metric
    read = parse_period(F.col("header")).rlike(r"^20\d{2}(?:-\d{2}|-Q[1-4])?$")
    sheets = columns.groupBy(*SHEET).agg(
        F.count_if(unknown).alias("unknown"), F.count_if(F.col("field").isNotNull() & (F.col("n_filled") > 0)).alias("mapped"), F.count_if("is_period").alias("periods"), F.count_if(F.col("is_period") & ~read).alias("unread"),
        F.max(F.coalesce(F.col("field") == "time_period", F.lit(False))).alias("has_time"), F.sum(F.when(numbers, F.col("n_checked")).otherwise(0)).alias("checked"), F.sum(F.when(numbers, F.col("n_bad")).otherwise(0)).alias("bad"),
        F.count_if(F.col("field").isNotNull() & ~is_metric & (F.col("field") != "time_period")).alias("dimensions"), F.countDistinct(F.when(is_metric, F.col("field"))).alias("metrics"), F.count_if(F.col("unnamed") & (F.col("n_filled") > 0)).alias("unlabelled"),
    )
    named = F.coalesce(headers.metric_named(F.col("sheet")), headers.metric_named(F.col("file"))).isNotNull()
    checked = sheets.select(
        *SHEET, (named | (F.col("metrics") >= 1)).alias("metric_ok"), ((F.col("unknown") == 0) & (F.col("mapped") > 0)).alias("field_ok"), F.when(F.col("periods") > 0, F.col("unread") == 0).otherwise(F.col("has_time")).alias("period_ok"),
        ((F.col("checked") > 0) & (F.col("bad") == 0)).alias("value_ok"), (F.col("dimensions") > 0).alias("dimension_ok"), "unlabelled",
    )
    all_ok = F.col("metric_ok") & F.col("field_ok") & F.col("period_ok") & F.col("value_ok") & F.col("dimension_ok")
    return checked.withColumn("status", F.when(~all_ok, "REVIEW").when(F.col("unlabelled") > 0, "CORE_PASS_AUX_REVIEW").otherwise("PASS")).drop("unlabelled")
