"""Totals, rankings, mixes, trends and indicators over fact views with a time_period column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.periods import shift_months

#: Labels of total rows, compared as whole strings without white space and in lower case.
TOTAL_LABELS = ["总体市场", "总体", "整体", "总计", "合计", "总市场", "全部", "all", "total", "grandtotal"]
#: Power types by group, compared in the same way.
NEW_ENERGY, FUEL = ["ev", "bev", "phv", "phev", "fcv"], ["ice", "hv", "hev", "mhv", "mhev"]
BLANK_LABEL = "未分类(空白)"


def squeezed(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", ""))


def is_total(label: Column) -> Column:
    return squeezed(label).isin(TOTAL_LABELS)


def is_blank(label: Column) -> Column:
    return F.trim(F.coalesce(label.cast("string"), F.lit(""))) == ""


def dimension_label(label: Column) -> Column:
    """Blank and null as a label of their own; a literal N/A stays."""
    return F.when(is_blank(label), BLANK_LABEL).otherwise(F.trim(label))


def power_group(label: Column, overrides: dict[str, str] | None = None) -> Column:
    """new_energy, fuel or unclassified by exact match, ``overrides`` (label to group) first."""
    name = squeezed(label)
    out = F.when(name.isin(NEW_ENERGY), "new_energy").when(name.isin(FUEL), "fuel").otherwise("unclassified")
    for group in ("new_energy", "fuel", "unclassified"):
        mine = [k.lower().replace(" ", "") for k, g in (overrides or {}).items() if g == group]
        out = F.when(name.isin(mine), group).otherwise(out) if mine else out
    return out


def change(current: Column, previous: Column) -> Column:
    """current / previous - 1; null without a previous value or with one of zero."""
    return F.when(previous != 0, current / previous - 1)


def ranking(facts: DataFrame, dim: str, metric: str, total: Column | None = None, top: int | None = None) -> DataFrame:
    """rank, ``dim``, value, share. Blank and total labels don't take part; the share's denominator is ``total``
    or, without it or when it is zero, the ranked values' sum. Ranks are 1, 2, ... by value, then label.

    With ``top`` the rows are cut before they are numbered, so that no more than these meet in one task."""
    rows = facts.where(~is_blank(F.col(dim)) & ~is_total(F.col(dim))).groupBy(dim).agg(F.sum(metric).alias("value")).where("value is not null")
    own = rows.agg(F.sum("value").alias("_sum"))
    if top:
        rows = rows.orderBy(F.desc("value"), dim).limit(top)
    rows = rows.crossJoin(own)  # one row
    base = F.col("_sum") if total is None else F.when(total.isNotNull() & (total != 0), total).otherwise(F.col("_sum"))
    rows = rows.withColumn("share", F.when(base != 0, F.col("value") / base))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), dim))).select("rank", dim, "value", "share")


def period_totals(facts: DataFrame, *metrics: str) -> DataFrame:
    return facts.groupBy("time_period").agg(*(F.sum(m).alias(m) for m in metrics))


def preferred_total(facts: DataFrame, dim: str, metric: str) -> DataFrame:
    """time_period and value: the first total row's value if there is one, else the sum of labelled rows, else of all."""
    total, value = is_total(F.col(dim)), F.col(metric)
    detail = ~total & ~is_blank(F.col(dim))
    return facts.groupBy("time_period").agg(
        F.coalesce(
            F.min_by(value, F.when(total & value.isNotNull(), F.col("line"))), F.sum(F.when(detail, value)), F.sum(value)
        ).alias("value")
    )


def with_shifted(series: DataFrame, months: int, values: list[str], suffix: str, keys: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """The series with the values of the row so many months earlier; keys match null-safely.

    A join on the month, not a lag: months may be missing. Where a key has several rows in a month, the last one by
    ``order`` (the greatest without it) that has the value counts."""
    last = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))) if order else F.max(v)
    earlier = series.groupBy("time_period", *keys).agg(*(last(v).alias(f"{v}_{suffix}") for v in values))
    earlier = earlier.select(shift_months(F.col("time_period"), months).alias("_month"), *(F.col(k).alias(f"_{k}") for k in keys), *(f"{v}_{suffix}" for v in values))
    on = F.col("time_period") == F.col("_month")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return series.join(earlier, on, "left").drop("_month", *(f"_{k}" for k in keys))


def with_yoy(series: DataFrame, value: str, keys: tuple[str, ...] = (), explicit: str | None = None, order: str | None = None) -> DataFrame:
    """The series with ``yoy``: the change that the source states, where it states one, else that on the year before."""
    rows = with_shifted(series, 12, [value], "before", keys, order)
    derived = change(F.col(value), F.col(f"{value}_before"))
    return rows.withColumn("yoy", F.coalesce(F.col(explicit), derived) if explicit else derived)


def window_sum(metric: Column, months: tuple[str, ...]) -> Column:
    return F.sum(F.when(F.col("time_period").isin(list(months)), metric))


def mix(facts: DataFrame, dim: Column, metric: str, *by: str) -> DataFrame:
    """``by``, label, value and share within ``by``; blank and total labels don't count, unclassified ones do."""
    rows = facts.where(~is_blank(dim) & ~is_total(dim)).groupBy(*by, dim.alias("label")).agg(F.sum(metric).alias("value"))
    base = F.sum("value").over(Window.partitionBy(*by))
    return rows.withColumn("share", F.when(base != 0, F.col("value") / base))


def first_value_reconcile(rows: DataFrame, keys: list[str], metrics: list[str], order: str, sheet: str, tolerance: float = 1e-7) -> DataFrame:
    """One row for each grain (nulls equal): each metric's first value by ``order``, how many metrics conflict
    beyond the tolerance, and the sheets of each metric, distinct and joined by `` | ``."""
    value = lambda m: F.min_by(m, F.when(F.col(m).isNotNull(), F.col(order)))
    spread = lambda m: F.max(m) - F.min(m) > F.greatest(F.lit(1e-9), tolerance * F.greatest(F.abs(F.max(m)), F.abs(F.min(m))))
    sheets = lambda m: F.substring(F.array_join(F.array_sort(F.collect_set(F.when(F.col(m).isNotNull(), F.col(sheet)))), " | "), 1, 1000)
    conflicts = sum((F.coalesce(spread(m), F.lit(False)).cast("int") for m in metrics), F.lit(0))
    return rows.groupBy(*keys).agg(*(value(m).alias(m) for m in metrics), conflicts.alias("conflicts"), *(sheets(m).alias(f"{m}_sheets") for m in metrics))


#: What speaks for a source, in points.
SOURCE_POINTS = {"total_row_snapshot": 1000.0, "total_row_trend": 180.0, "metric": 300.0, "dimension": 600.0, "dimension_present": 150.0, "confidence": 80.0, "period": 40.0, "row": 0.2}


def source_scores(rows: DataFrame, metric: str, dim: str | None = None, purpose: str = "snapshot") -> DataFrame:
    """source_file, source_sheet, periods, n_rows, score and rank of each source that has the metric, the best first.

    ``snapshot`` asks for one figure, ``trend`` for a series: only then periods count, and a total row counts less.
    With a wanted dimension only rows that have it take part, if there are any, and sources without it drop. Points
    are SOURCE_POINTS, for up to 60 periods and 100 rows; ties go to the first seen (``line``)."""
    p = SOURCE_POINTS
    has = rows.where(F.col(metric).isNotNull())
    if dim:
        has = has.where(F.col(dim).isNotNull())
    total = F.lit(False)
    for c in ("market", "vehicle_type"):
        if c in rows.columns:
            total = total | is_total(F.col(c))
    agg = has.groupBy("source_file", "source_sheet").agg(
        F.max(total.cast("int")).alias("has_total"),
        F.max((F.col("source_metric_type") == metric).cast("int")).alias("metric_match"),
        F.max((F.col("source_dimension") == dim).cast("int") if dim else F.lit(0)).alias("dim_match"),
        F.max("source_confidence").alias("confidence"),
        F.countDistinct("time_period").alias("periods"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("line").alias("first_line"),
    )
    score = (
        F.col("has_total") * p[f"total_row_{purpose}"] + F.coalesce("metric_match", F.lit(0)) * p["metric"] + F.coalesce("confidence", F.lit(0)) * p["confidence"]
        + (F.when(F.col("dim_match") == 1, p["dimension"]).otherwise(p["dimension_present"]) if dim else F.lit(0.0))
        + (F.least(F.lit(60), "periods") * p["period"] if purpose == "trend" else F.lit(0.0)) + F.least(F.lit(100), "n_rows") * p["row"]
    )
    out = agg.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first_line"))).select("source_file", "source_sheet", "periods", "n_rows", "score", "rank")


def selected(rows: DataFrame, metric: str, dim: str | None = None, purpose: str = "snapshot") -> DataFrame:
    """The rows of the one source that answers for the metric: sources are a few, rows aren't shuffled for it."""
    best = source_scores(rows, metric, dim, purpose).where("rank = 1").select("source_file", "source_sheet")
    return rows.where(F.col(metric).isNotNull()).join(F.broadcast(best), ["source_file", "source_sheet"], "left_semi")  # one row


def widest_source(rows: DataFrame, metric: str, scope: str | None = None) -> DataFrame:
    """The rows of the source that a formula takes the metric from: among those made for it, if any, the one of most
    periods, then of most rows. Rows marked as summaries drop where there are others."""
    has = rows.where(F.col(metric).isNotNull())
    if scope:
        has = has.where(F.lower("source_metric_scope") == scope.lower())
    own = F.coalesce((F.lower("source_metric_type") == metric.lower()).cast("int"), F.lit(0))
    sources = has.groupBy("source_file", "source_sheet", own.alias("own")).agg(F.countDistinct("time_period").alias("n_periods"), F.count(F.lit(1)).alias("n_rows"))
    best = sources.orderBy(F.desc("own"), F.desc("n_periods"), F.desc("n_rows"), "source_file", "source_sheet").limit(1)
    chosen = has.withColumn("own", own).join(F.broadcast(best.select("source_file", "source_sheet", "own")), ["source_file", "source_sheet", "own"], "left_semi").drop("own")
    summary = F.lower(F.coalesce("source_row_kind", F.lit("detail"))).isin("summary", "total", "subtotal")
    any_detail = chosen.agg(F.count_if(~summary).alias("_details"))
    return chosen.crossJoin(any_detail).where(~summary | (F.col("_details") == 0)).drop("_details")  # one row


def pair_share(facts: DataFrame, dim: str, metric: str, part: Column) -> DataFrame:
    """time_period and share of the first row that ``part`` holds for in the first total row; periods that lack
    either, or whose total is zero, drop."""
    first = lambda c: F.min_by(metric, F.when(c & F.col(metric).isNotNull(), F.col("line")))
    rows = facts.groupBy("time_period").agg(first(is_total(F.col(dim))).alias("whole"), first(part).alias("part"))
    return rows.where("whole is not null and part is not null and whole <> 0").select("time_period", (F.col("part") / F.col("whole")).alias("share"))


@dataclass(frozen=True)
class Indicator:
    """A declared indicator: metric, aggregation (sum, average, latest, max, min, count) and filters (dim to values)."""

    name: str
    metric: str
    aggregation: str = "sum"
    filters: dict[str, list[str]] = field(default_factory=dict)

    def problems(self, columns: list[str]) -> list[str]:
        out = [] if self.aggregation in ("sum", "average", "latest", "max", "min", "count") else [f"{self.name}: no aggregation {self.aggregation}"]
        return out + [f"{self.name}: no column {c}" for c in (self.metric, *self.filters) if c not in columns]

    def condition(self) -> Column:
        out = F.lit(True)
        for dim, values in self.filters.items():
            out = out & F.lower(F.trim(F.col(dim))).isin([v.strip().lower() for v in values])
        return out

    def column(self, months: tuple[str, ...]) -> Column:
        """The aggregate over these months. ``latest`` is the sum in the last month that has a row, a map of sums by month."""
        here = F.col("time_period").isin(list(months)) & self.condition()
        value = F.when(here, F.col(self.metric))
        if self.aggregation == "count":
            return F.count(F.when(here, F.lit(1))).cast("double")
        if self.aggregation == "latest":
            by_month = [(m, F.sum(F.when((F.col("time_period") == m) & self.condition(), F.col(self.metric)))) for m in reversed(months)]
            return F.coalesce(*(c for _, c in by_month))
        return {"sum": F.sum, "average": F.avg, "max": F.max, "min": F.min}[self.aggregation](value)


def indicators(facts: DataFrame, specs: list[Indicator], months: tuple[str, ...], compared: tuple[str, ...]) -> DataFrame:
    """indicator, value, previous, yoy and share of every spec from one pass; the share's denominator has no filters.

    All errors of the specs are raised together."""
    wrong = [p for s in specs for p in s.problems(facts.columns)]
    if wrong:
        raise ValueError("; ".join(wrong))
    cells = []
    for i, s in enumerate(specs):
        bare = Indicator(s.name, s.metric, s.aggregation)
        cells += [s.column(months).alias(f"v{i}"), s.column(compared).alias(f"p{i}"), bare.column(months).alias(f"t{i}")]
    one = facts.where(F.col("time_period").isin([*months, *compared])).agg(*cells)
    rows = F.array(*(F.struct(F.lit(s.name).alias("indicator"), F.col(f"v{i}").cast("double").alias("value"), F.col(f"p{i}").cast("double").alias("previous"), F.col(f"t{i}").cast("double").alias("total")) for i, s in enumerate(specs)))
    out = one.select(F.inline(rows))
    return out.select("indicator", "value", "previous", change(F.col("value"), F.col("previous")).alias("yoy"), F.when(F.col("total") != 0, F.col("value") / F.col("total")).alias("share"))


def indicator_matrix(facts: DataFrame, rows: dict[str, Column], metrics: list[str], months: tuple[str, ...]) -> DataFrame:
    """A row for each named condition, a column for each metric: sums over the months, from one pass."""
    here = F.col("time_period").isin(list(months))
    cells = [F.sum(F.when(here & c, F.col(m))).cast("double").alias(f"c{i}_{j}") for i, c in enumerate(rows.values()) for j, m in enumerate(metrics)]
    one = facts.where(here).agg(*cells)
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("segment"), *(F.col(f"c{i}_{j}").alias(m) for j, m in enumerate(metrics))) for i, n in enumerate(rows)))))


def densities(facts: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values, density and is_metric (0.6 or more) for each column, from one pass."""
    one = facts.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.expr(f"try_cast({c} as double)")).alias(f"d_{c}") for c in columns))
    rows = one.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("n_values")) for c in columns))))
    density = F.when(F.col("n") > 0, F.col("n_values") / F.col("n"))
    return rows.select("column", "n_values", density.alias("density"), (density >= 0.6).alias("is_metric"))


#: Texts that stand for nothing, and what power groups are called in filters.
NO_TEXT = ["nan", "none", "null", "<na>"]
GROUP_NAMES = {"新能源车": "new_energy", "燃油车": "fuel", "未分类": "unclassified", "new_energy": "new_energy", "fuel": "fuel", "unclassified": "unclassified"}


def plain_label(label: Column) -> Column:
    """Trimmed, single spaces, lower case; null and what stands for it as empty."""
    text = F.lower(F.regexp_replace(F.trim(F.coalesce(label.cast("string"), F.lit(""))), r"\s+", " "))
    return F.when(text.isin(NO_TEXT), "").otherwise(text)


def _wanted(values: list[str] | str) -> list[str]:
    texts = [" ".join(str(v).split()).lower() for v in (values if isinstance(values, list) else [values]) if v is not None]
    return [t for t in texts if t and t not in NO_TEXT]


def scoped(facts: DataFrame, filters: dict[str, list[str] | str]) -> DataFrame:
    """The rows of a report's section: of each filter those with one of its values; dimensions that aren't there and
    filters without a value leave all."""
    for dim, values in filters.items():
        if dim in facts.columns and _wanted(values):
            facts = facts.where(plain_label(F.col(dim)).isin(_wanted(values)))
    return facts


def filtered(facts: DataFrame, filters: list[tuple[str, list[str]]], overrides: dict[str, str] | None = None) -> DataFrame:
    """The rows of an indicator: as ``scoped``, but a dimension that isn't there leaves none; power_group is one that
    power_type is grouped by."""
    for dim, values in filters:
        if dim == "power_group":
            if "power_type" not in facts.columns:
                return facts.where(F.lit(False))
            groups = {g for name, g in GROUP_NAMES.items() if name in _wanted(values)}
            facts = facts.where(power_group(F.col("power_type"), overrides).isin(sorted(groups)))
        elif dim not in facts.columns:
            return facts.where(F.lit(False))
        elif _wanted(values):
            facts = facts.where(plain_label(F.col(dim)).isin(_wanted(values)))
    return facts


#: What names of markets and kinds of vehicles hold, and the labels of a market that is split by weight.
PASSENGER = ["cars", "car", "sedan", "hatchback", "suv", "mpv", "passenger", "乘用"]
COMMERCIAL = ["commercial", "商用", "medium truck", "heavy truck", "medium trucks", "heavy trucks", "bus", "中型卡车", "重型卡车", "客车"]
LIGHT, HEAVY, US_REGIONS = ["cars", "light trucks"], ["medium trucks", "heavy trucks"], ["usa", "us"]


def market_segments(facts: DataFrame, label: str, region: str = "", overrides: dict[str, str] | None = None) -> DataFrame:
    """``facts`` with is_passenger and is_commercial, by what their label (a market or a kind of vehicle) holds. For the US, where its four
    labels by weight are all there, light ones are passenger's. ``overrides``: a segment for single labels, which counts alone."""
    plain = F.lower(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))))
    name = region.strip().lower()
    by_weight = F.lit(False)
    if "美国" in name or "united states" in name or name in US_REGIONS:
        there = facts.agg(*(F.max(plain == w).alias(f"_w{k}") for k, w in enumerate([*LIGHT, *HEAVY])))  # one row
        facts = facts.crossJoin(there.select(reduce(lambda a, b: a & b, (F.coalesce(F.col(f"_w{k}"), F.lit(False)) for k in range(4))).alias("_by_weight")))
        by_weight = F.col("_by_weight")
    holds = lambda words: reduce(lambda a, b: a | b, (F.contains(plain, F.lit(w)) for w in words))
    own = reduce(lambda out, kv: F.when(plain == kv[0].strip().lower(), kv[1]).otherwise(out), (overrides or {}).items(), F.lit(None).cast("string"))
    flag = lambda segment, words, weights: F.when(own.isNotNull(), own == segment).when(by_weight, plain.isin(weights)).otherwise(holds(words))
    out = facts.withColumns({"is_passenger": flag("passenger_vehicle", PASSENGER, LIGHT), "is_commercial": flag("commercial_vehicle", COMMERCIAL, HEAVY)})
    return out.drop("_by_weight")


def mix_audit(facts: DataFrame, dim: str, group: Column, metric: str, *by: str) -> DataFrame:
    """``by``, value, classified, coverage and unknown (labels without a group, in order) of a split into groups: what its shares leave open."""
    label = F.col(dim)
    rows = facts.where(~is_blank(label) & ~is_total(label)).groupBy(*by, label.alias("label"), (group != "unclassified").alias("known")).agg(F.sum(metric).alias("value"))
    known = F.sum(F.when(F.col("known"), F.col("value")))
    return rows.groupBy(*by).agg(F.sum("value").alias("total"), known.alias("classified"), F.when(F.sum("value") != 0, known / F.sum("value")).alias("coverage"), F.array_sort(F.collect_set(F.when(~F.col("known"), F.col("label")))).alias("unknown"))


def overview(facts: DataFrame, dim: str, metrics: list[str], now: str, year_ago: str, month_ago: str) -> DataFrame:
    """``dim`` and, for each metric, its value in the month with its changes on the year and on the month before; one pass."""
    of = lambda m, period: F.sum(F.when(F.col("time_period") == period, F.col(m)))
    cells = [c for m in metrics for c in (of(m, now).alias(m), change(of(m, now), of(m, year_ago)).alias(f"yoy_{m}"), change(of(m, now), of(m, month_ago)).alias(f"mom_{m}"))]
    return facts.where(F.col("time_period").isin(now, year_ago, month_ago)).groupBy(dim).agg(*cells)
