"""Header cells: registered names of fields, periods in headers, metrics named in a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.arrays import holding
from tidegrid.functions.values import normal_text

#: The registered header names of each field.
FIELD_NAMES = {
    "time_period": ["时间", "月份", "年月", "周期", "日期", "month", "date", "period", "yearmonth"],
    "region": ["国家/地区", "国家地区", "国家", "地区", "区域", "region", "country"],
    "market": ["指标", "市场", "细分市场", "market", "segment"],
    "vehicle_type": ["车种", "车型类别", "车辆类型", "vehicle_type", "vehicletype"],
    "oem": ["集团", "汽车集团", "车企", "主机厂", "整车厂", "厂商", "oem", "manufacturer"],
    "brand": ["整车厂/品牌", "整车厂品牌", "品牌", "brand"],
    "model": ["车型", "车系", "model"],
    "power_type": ["动力总成", "动力类型", "能源类型", "燃料类型", "动力", "能源", "power_type", "powertype", "power"],
    "size_class": ["级别", "车级", "尺寸", "class", "size"],
    "tech_route": ["技术路线", "技术", "路线", "technology", "tech"],
    "production": ["产量", "生产", "生产量", "汽车产量", "整车产量", "总产量", "production", "output"],
    "sales": ["销量", "总销量", "汽车销量", "整车销量", "销售量", "销售", "sales"],
    "retail_sales": ["零售销量", "总零售销量", "零售量", "零售销售", "retail sales", "retailsales"],
    "wholesale": ["批发销量", "总批发销量", "批销量", "批发量", "wholesale"],
    "domestic_sales": ["国内销量", "国内销售", "内销", "内销量", "domestic sales", "domesticsales"],
    "domestic_wholesale": ["国内批发销量", "国内批销量", "国内批发量", "domestic wholesale", "domesticwholesale"],
    "export": ["出口", "出口量", "出口销量", "出口销售", "export", "exports"],
    "inventory": ["库存", "库存量", "期末库存", "inventory", "stock"],
    "yoy_production": ["产量同比", "同比产量", "production yoy"],
    "yoy_sales": ["销量同比", "销售同比", "sales yoy"],
    "yoy_retail_sales": ["零售销量同比", "零售同比", "retail sales yoy"],
    "yoy_wholesale": ["批发销量同比", "批发同比", "wholesale yoy"],
    "yoy_domestic_sales": ["国内销量同比", "内销同比", "domestic sales yoy"],
    "yoy_domestic_wholesale": ["国内批发销量同比", "国内批发同比", "domestic wholesale yoy"],
    "yoy_export": ["出口同比", "出口销量同比", "export yoy"],
}
METRICS = ["production", "sales", "retail_sales", "wholesale", "domestic_sales", "domestic_wholesale", "export", "inventory"]
#: Header names that say nothing about the dimension or value below them, and those to leave out.
GENERIC_DIMENSIONS = ["名称", "对象", "项目", "规格", "类别", "分类", "明细", "项目名称", "对象名称", "name", "item", "entity"]
GENERIC_VALUES = ["数值", "值", "数量", "本期", "当期", "当月", "本月", "数据", "合计值", "总计值", "value", "amount", "volume", "qty", "quantity"]
IGNORED = ["序号", "备注", "说明", "单位", "数据源", "来源", "source", "note", "remark"]
#: Fixed value: how periods are written in headers.
PERIOD_HEADER = r"^(?:20\d{2}(?:0[1-9]|1[0-2])(?:\.0)?|20\d{2}[.\-/年]\d{1,2}(?:月)?|20\d{2}[Qq][1-4]|20\d{2}年[1-4]季度|20\d{2})$"


def token(cell: Column) -> Column:
    """Lower case without white space, full-width parentheses as ASCII; null as empty."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(cell.cast("string"), F.lit("")), "（）", "()")), r"\s+", "")


def _plain(name: str) -> str:
    return "".join(name.lower().split())


def field_of(header: Column) -> Column:
    """The field that a header is a registered name of; null for any other."""
    t = token(header)
    tests = [F.when(t.isin(sorted({_plain(n) for n in names})), field) for field, names in FIELD_NAMES.items()]
    return F.coalesce(*tests)


def dimensions() -> list[str]:
    """The fields that are neither a period nor a number."""
    return [f for f in FIELD_NAMES if f not in METRICS and f != "time_period" and not f.startswith("yoy_")]


def is_period_header(cell: Column) -> Column:
    return F.regexp_replace(normal_text(cell), " ", "").rlike(PERIOD_HEADER)


#: What each metric is called inside sheet and file names, the more specific first.
METRIC_WORDS = {
    "domestic_wholesale": ["国内批发销量", "国内批销量", "国内批发量", "domesticwholesale"],
    "retail_sales": ["总零售销量", "零售销量", "零售量", "零售销售", "retailsales"],
    "wholesale": ["总批发销量", "批发销量", "批销量", "批发量", "wholesale", "wholesalesales"],
    "domestic_sales": ["国内销量", "国内销售", "内销量", "内销", "domesticsales"],
    "production": ["汽车产量", "整车产量", "总产量", "生产量", "产量", "production", "output"],
    "inventory": ["期末库存", "总库存", "库存量", "库存", "inventory", "stock"],
    "export": ["出口销量", "出口销售", "出口量", "出口", "exportsales", "exports", "export"],
    "sales": ["汽车销量", "整车销量", "总销量", "销售量", "销量", "销售", "sales"],
}
#: What a metric's name contains besides itself: a hit of the first leaves out hits of the others.
_COVERS = {
    "domestic_wholesale": ["domestic_sales", "wholesale", "sales"],
    "retail_sales": ["sales"],
    "wholesale": ["sales"],
    "domestic_sales": ["sales"],
}


def metrics_named(text: Column) -> Column:
    """The metrics that a text names, the most specific ones only."""
    return holding(token(text), _metrics_of)


def _metrics_of(t: Column) -> Column:
    hits = F.struct(*(reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words)).alias(m) for m, words in METRIC_WORDS.items()))
    left = lambda hit: {m: reduce(lambda a, b: a & b, (~hit[by] for by, others in _COVERS.items() if m in others), hit[m]) for m in METRIC_WORDS}
    return holding(hits, lambda hit: F.array_compact(F.array(*(F.when(c, m) for m, c in left(hit).items()))))


def metric_named(text: Column) -> Column:
    """The one metric that a text names; null for none and for several."""
    return holding(metrics_named(text), lambda named: F.when(F.size(named) == 1, F.get(named, F.lit(0))))
