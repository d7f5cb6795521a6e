"""Quarterly shipments: grains from one grouping-set pass, shares with their own denominators, growth, labels, overlays.

Two populations: the market counts every technology in scope, makers only the core ones. A share names its
numerator's and its denominator's population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.market import change

#: Upper ends of the size buckets.
SIZE_EDGES = ((8, "<8"), (12, "8-12"), (15, "12-15"))


def size_bucket(size: Column) -> Column:
    out = F.when(size < SIZE_EDGES[0][0], SIZE_EDGES[0][1])
    for edge, name in SIZE_EDGES[1:]:
        out = out.when(size < edge, name)
    return out.when(size.isNotNull(), ">=15")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def year_sum(value: str, year: int, where: Column | None = None) -> Column:
    """The sum over a year; null, not zero, if no row counts."""
    here = F.col("year") == year
    return F.sum(F.when(here if where is None else here & where, F.col(value)))


def through(facts: DataFrame, year: int, quarter: int) -> DataFrame:
    """The summary population: this year's and the last one's quarters up to the one that data go to."""
    return facts.where(F.col("year").isin(year - 1, year) & (F.col("quarter") <= quarter))


def grains(facts: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """grain (a list of column names), the columns (null where summed over) and the value's sum for each grain, in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = facts.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.sum(value).alias("value"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    names = F.concat_ws("+", *(F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns))
    return rows.select(names.alias("grain"), *columns, "value")


def populations(facts: DataFrame, sets: dict[str, tuple[Column, dict[str, Column]]], value: str, line: str, most: int = 12) -> DataFrame:
    """grain, key (the set's columns as one map), value, n and refs (the first ``most`` lines) of several grains, each over
    the rows that its condition holds for.

    One scan: a row goes to each grain that it counts for. The lines are cut to ``most`` a group where they lie,
    before they are gathered."""
    as_map = lambda cols: F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(c.cast("string") for c in cols.values())))
    entries = F.filter(F.array(*(F.when(where, F.struct(F.lit(name).alias("grain"), F.to_json(as_map(cols)).alias("key"))) for name, (where, cols) in sets.items())), lambda e: e.isNotNull())
    rows = facts.select(F.col(value).alias("value"), F.col(line).alias("line"), F.inline(entries))
    sums = rows.groupBy("grain", "key").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("grain", "key").orderBy("line"))
    refs = rows.select("grain", "key", "line").withColumn("nth", first).where(F.col("nth") <= most).groupBy("grain", "key").agg(F.array_sort(F.collect_list("line")).alias("refs"))
    return sums.join(refs, ["grain", "key"])


def growth_contribution(facts: DataFrame, dim: str, value: str, year: int) -> DataFrame:
    """``dim``, current, previous, yoy and its part of the total's change; null if that is zero or a side is missing."""
    rows = facts.groupBy(dim).agg(year_sum(value, year).alias("current"), year_sum(value, year - 1).alias("previous"))
    delta = F.col("current") - F.col("previous")
    whole = F.sum(F.coalesce("current", F.lit(0)) - F.coalesce("previous", F.lit(0))).over(Window.partitionBy())  # over a row a label
    return rows.select(dim, "current", "previous", change(F.col("current"), F.col("previous")).alias("yoy"), F.when(whole != 0, delta / whole).alias("contribution"))


def summary_matrix(facts: DataFrame, year: int, core: list[str], maker: str) -> DataFrame:
    """11 rows: two technologies by four sizes, a subtotal of each, and all.

    Market values of the last row hold every technology in scope, its share's denominator the core ones only;
    maker values are of the core ones everywhere."""
    bucket = size_bucket(F.col("size"))
    is_core, is_maker = F.col("technology").isin(core), F.col("maker") == maker
    cells = facts.withColumn("bucket", bucket).groupBy("technology", "bucket").agg(
        year_sum("quantity", year).alias("market"), year_sum("quantity", year - 1).alias("market_before"),
        year_sum("quantity", year, is_maker).alias("maker"), year_sum("quantity", year - 1, is_maker).alias("maker_before"),
    )
    names = ("market", "market_before", "maker", "maker_before")
    sums = [F.sum(n).alias(n) for n in names]
    inside = cells.where(is_core)
    by_cell = inside.groupBy("technology", "bucket").agg(*sums)
    by_tech = inside.groupBy("technology").agg(*sums).withColumn("bucket", F.lit("subtotal"))
    maker_sums = [F.sum(F.when(is_core, F.col(n))).alias(n) if n.startswith("maker") else F.sum(n).alias(n) for n in names]
    whole = cells.agg(*maker_sums).withColumn("technology", F.lit("All")).withColumn("bucket", F.lit("All"))
    rows = by_cell.unionByName(by_tech).unionByName(whole)
    base = inside.agg(*(F.sum(n).alias(f"all_{n}") for n in names))
    rows = rows.crossJoin(base)  # eleven rows and one
    tech = by_tech.select("technology", F.col("market").alias("tech_market"))
    rows = rows.join(tech, "technology", "left")
    last = F.col("technology") == "All"
    return rows.select(
        "technology", "bucket", "market", change(F.col("market"), F.col("market_before")).alias("market_yoy"),
        F.when(last, F.when(F.col("all_market").isNotNull(), F.lit(1.0))).otherwise(share(F.col("market"), F.col("all_market"))).alias("market_share"),
        F.when(last, F.when(F.col("all_market").isNotNull(), F.lit(1.0))).otherwise(share(F.col("market"), F.col("tech_market"))).alias("technology_internal_share"),
        "maker", change(F.col("maker"), F.col("maker_before")).alias("maker_yoy"),
        share(F.col("maker"), F.col("all_maker")).alias("maker_internal_share"),
        share(F.col("maker"), F.when(last, F.col("all_market")).otherwise(F.col("market"))).alias("maker_market_share"),
        F.when(F.col("all_maker") - F.col("all_maker_before") != 0, (F.col("maker") - F.col("maker_before")) / (F.col("all_maker") - F.col("all_maker_before"))).alias("growth_contribution"),
    )


def with_labels(facts: DataFrame, current: int) -> DataFrame:
    """A row for each period label that it counts for: Yyy for earlier years, YyyF and, up to the third quarter,
    YyyQ1-Q3 for the current one, YyyQn for later quarters."""
    year, quarter = F.col("year"), F.col("quarter")
    yy = F.lpad((year % 100).cast("string"), 2, "0")
    labels = F.when(year < current, F.array(F.concat(F.lit("Y"), yy)))
    labels = labels.when((year == current) & (quarter <= 3), F.array(F.concat(F.lit("Y"), yy, F.lit("F")), F.concat(F.lit("Y"), yy, F.lit("Q1-Q3"))))
    labels = labels.when(year == current, F.array(F.concat(F.lit("Y"), yy, F.lit("F"))))
    labels = labels.otherwise(F.array(F.concat(F.lit("Y"), yy, F.lit("Q"), quarter.cast("string"))))
    return facts.withColumn("period", F.explode(labels))


def top_with_rest(facts: DataFrame, dim: str, value: str, year: int, n: int, left_out: list[str]) -> DataFrame:
    """rank, ``dim``, current, previous, share of all, yoy, change of share in points and share of the growth of all, of the n largest but the left-out ones.

    Sums over all are one row; only the n largest are ranked."""
    rows = facts.groupBy(dim).agg(year_sum(value, year).alias("current"), year_sum(value, year - 1).alias("previous"))
    every = rows.agg(F.sum("current").alias("_now"), F.sum("previous").alias("_then"))
    best = rows.where(~F.col(dim).isin(left_out) & F.col("current").isNotNull()).orderBy(F.desc("current"), dim).limit(n)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("current"), dim))).crossJoin(every)  # n rows and one
    now, then = share(F.col("current"), F.col("_now")), share(F.col("previous"), F.col("_then"))
    grown = share(F.col("current") - F.coalesce("previous", F.lit(0)), F.col("_now") - F.col("_then"))
    return best.select("rank", dim, "current", "previous", now.alias("share"), change(F.col("current"), F.col("previous")).alias("yoy"), ((now - then) * 100).alias("share_points"), grown.alias("contribution"))


def overlay(files: DataFrame, order: str, *period: str) -> DataFrame:
    """Rows of the newest file of each period; a file replaces a period as a whole."""
    newest = files.groupBy(*period).agg(F.max(order).alias("_newest"))  # a row a period
    on = [F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}")) for p in period]
    joined = files.alias("l").join(newest.alias("r"), [*on, F.col(f"l.{order}") == F.col("r._newest")])
    return joined.select("l.*")


def key_sizes(sums: DataFrame, threshold: Column) -> DataFrame:
    """application, size and value of sums (application, size, value) above the threshold and of each application's largest."""
    first = F.row_number().over(Window.partitionBy("application").orderBy(F.desc("value"), "size"))
    return sums.withColumns({"place": first, "least": threshold}).where("value > least or place = 1").select("application", "size", "value")


def product_narratives(segments: DataFrame, period_label: str, period: str) -> DataFrame:
    """maker and text: what drove each maker's growth. ``segments``: maker, label, quantity, yoy and contribution; those without a change or a
    contribution don't count. Two that add most, the one that takes most away, and the largest by quantity; makers that nothing drove have no text.

    The text's phrases are fixed values; a maker's segments are a few rows, and the first of equals counts."""
    rows = segments.where("yoy is not null and contribution is not null")
    cell = F.struct(*(F.col(c) for c in ("label", "quantity", "yoy", "contribution")))
    least = lambda sign, where: F.sort_array(F.collect_list(F.when(where, F.struct((F.col(sign[1:]) * (-1 if sign[0] == "-" else 1)).alias("by"), F.col("label").alias("then"), cell.alias("s")))))
    found = rows.groupBy("maker").agg(least("-contribution", F.col("contribution") > 0).alias("up"), least("+contribution", F.col("contribution") < 0).alias("down"), least("-quantity", F.lit(True)).alias("size"))
    first, second, drag, base = (F.get(c, F.lit(k))["s"] for c, k in (("up", 0), ("up", 1), ("down", 0), ("size", 0)))
    pct = lambda v, sign="+": F.concat(F.format_string(f"%{sign}.0f", F.rint(v * 100)), F.lit("%"))
    text = F.concat(
        F.col("maker"), F.lit(f" {period_label}增长主要于"), first["label"], F.lit("产品增长所驱动，同比"), pct(first["yoy"]), F.lit("，增长贡献"), pct(first["contribution"], ""),
        F.coalesce(F.concat(F.lit("；其次是"), second["label"], F.lit("产品，同比"), pct(second["yoy"]), F.lit("，增长贡献"), pct(second["contribution"], "")), F.lit("")),
        F.coalesce(F.concat(F.lit("；"), drag["label"], F.lit("产品表现不佳，同比"), pct(drag["yoy"]), F.lit("，贡献"), pct(drag["contribution"]), F.lit("，拖累整体增速")), F.lit("")),
        F.lit("。从产品结构看，"), F.col("maker"), F.lit(period), base["label"], F.lit("作为基本盘稳固地位，"), first["label"], F.lit("发力作为核心引擎提拉增长。"),
    )
    return found.where(F.size("up") > 0).select("maker", text.alias("text"))
