"""Chart-ready aggregates in long form; spec-driven by aggregate()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import calendar_bucket, clamped, label, parse_time, to_number
from ..plans.lineage import checkpointed, if_few
from .ranks import cumulated, placed, quantiles_by, thinned


def _measure(y: str | None, agg: str | None) -> Column:
    """count: numeric values if there are any, else rows; sum and mean are 0 without numbers."""
    x = to_number(F.col(y)) if y else F.lit(None).cast("double")
    kind = (agg or "mean").lower()
    if not y or kind == "count":
        return F.when(F.count(x) > 0, F.count(x)).otherwise(F.count(F.lit(1))).cast("double")
    return F.coalesce(F.sum(x) if kind == "sum" else F.avg(x), F.lit(0.0))


def grouped(df: DataFrame, x: str, y: str | None = None, agg: str | None = None, hue: str | None = None) -> DataFrame:
    """series (if hue), x, y: an aggregate by label."""
    keys = ([label(F.col(hue)).alias("series")] if hue else []) + [label(F.col(x)).alias("x")]
    return df.groupBy(*keys).agg(_measure(y, agg).alias("y"))


def grouped_raw(df: DataFrame, x: str, y: str | None = None, agg: str = "count") -> DataFrame:
    """As a data frame library groups: null keys stay null, an unknown aggregate counts rows."""
    known = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(F.col(x).cast("string").alias("x")).agg((known[agg](to_number(F.col(y))) if y and agg in known else F.count(F.lit(1)).cast("double")).alias("y"))


def pivoted(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """sum of hue by y, a column for each x; missing cells are 0."""
    rows = df.select(label(F.col(x)).alias("_x"), label(F.col(y)).alias("y"), to_number(F.col(hue)).alias("_v"))
    return rows.groupBy("y").pivot("_x").agg(F.sum("_v")).na.fill(0)


def _edges(values: DataFrame, bins: int) -> DataFrame:
    return values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null").withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))


def histogram(df: DataFrame, x: str, bins: int = 30, hue: str | None = None) -> DataFrame:
    """bin, lo, hi, count (and series): equal bins over the whole range, empty ones too; the last is closed."""
    bins = int(clamped(bins, 5, 200, 30))
    series = [label(F.col(hue)).alias("series")] if hue else []
    values = df.select(*series, to_number(F.col(x)).alias("v")).where("v is not null")
    edges = _edges(values, bins)
    keys = ["series"] if hue else []
    counts = values.crossJoin(F.broadcast(edges)).groupBy(*keys, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = edges.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if hue:
        spine = values.select("series").distinct().crossJoin(F.broadcast(spine))
    out = spine.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("lo"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"))


def quartiles(df: DataFrame, y: str, by: str | None = None, overall: bool = False) -> DataFrame:
    """min, q1, median, q3, max and n by group; with overall also one row for all, from the same scan."""
    rows = df.select(label(F.col(by)).alias("grp") if by else F.lit("all").alias("grp"), to_number(F.col(y)).alias("v")).where("v is not null")
    if overall:
        rows = rows.select(F.explode(F.array("grp", F.lit("(all)"))).alias("grp"), "v")
    return quantiles_by(rows, ["grp"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, min=F.min("v"), max=F.max("v")).select("grp", "min", "q1", "median", "q3", "max", "n")


def heatmap_numeric(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """x, y (bin centres) and count of the cells that have rows; each axis' range is its own."""
    bins = int(clamped(bins, 5, 40, 20))
    rows = df.select(to_number(F.col(x)).alias("a"), to_number(F.col(y)).alias("b"))
    e = rows.agg(*(f(c).alias(f"{c}_{n}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))))
    for c in "ab":
        e = e.withColumn(f"{c}_w", F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins).otherwise(1.0))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / F.col(f"{c}_w")), F.lit(bins - 1))
    centre = lambda c: F.round(F.col(f"{c}_lo") + (F.col(f"i{c}") + 0.5) * F.col(f"{c}_w"), 6)
    counts = rows.where("a is not null and b is not null").crossJoin(F.broadcast(e)).groupBy(cell("a").alias("ia"), cell("b").alias("ib")).agg(F.count(F.lit(1)).alias("count"))
    return counts.crossJoin(F.broadcast(e)).select(centre("a").alias("x"), centre("b").alias("y"), "count")


def heatmap_labels(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts for every pair of labels; labels, not rows, are paired."""
    counts = df.groupBy(label(F.col(x)).alias("x"), label(F.col(y)).alias("y")).agg(F.count(F.lit(1)).alias("count"))
    counts = checkpointed(counts)
    spine = counts.select("x").distinct().crossJoin(if_few(counts.select("y").distinct()))
    return spine.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("count", F.lit(0)).alias("count"))


def resampled(df: DataFrame, time: str, y: str | None = None, unit: str = "D", agg: str = "mean", parse: bool = False) -> DataFrame:
    """x (calendar bucket), y: aggregate by day, week from Sunday, or month."""
    at = parse_time(F.col(time)) if parse else F.col(time)
    return df.where(at.isNotNull()).groupBy(calendar_bucket(at, unit).alias("x")).agg(_measure(y, agg).alias("y"))


def resampled_filled(df: DataFrame, time: str, y: str, unit: str = "D", agg: str = "sum") -> DataFrame:
    """As resampled by day, or week named by its last day (Sunday), with 0 for empty buckets of sums and counts."""
    day = F.to_date(time)
    bucket = day if unit == "D" else F.date_add(day, F.pmod(8 - F.dayofweek(day), F.lit(7)).cast("int"))
    found = df.where(day.isNotNull()).groupBy(bucket.alias("x")).agg(_measure(y, agg).alias("y"))
    if agg == "mean":
        return found
    step = F.expr("interval 1 day" if unit == "D" else "interval 7 days")
    spine = found.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", step)).alias("x"))
    return spine.join(found, "x", "left").select("x", F.coalesce("y", F.lit(0.0)).alias("y"))


def points(df: DataFrame, x: str, y: str, size: str | None = None, hue: str | None = None, order: list[str] = (), most: int = 1200) -> DataFrame:
    """Scatter or bubble rows with both numbers; the size is 8 unless a column gives it. With an order, so many evenly spaced rows."""
    weight = F.coalesce(to_number(F.col(size)), F.lit(8.0)) if size else F.lit(8.0)
    series = [label(F.col(hue)).alias("series")] if hue else []
    rows = df.select(*series, to_number(F.col(x)).alias("x"), to_number(F.col(y)).alias("y"), weight.alias("size"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))).where("x is not null and y is not null")
    keys = [f"_o{i}" for i in range(len(order))]
    return thinned(rows, keys, most).drop(*keys) if keys else rows


def stacked(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """Sums by x and series with the running top over the series, for areas."""
    sums = grouped(df, x, y, "sum", hue)
    return sums.withColumn("top", F.sum("y").over(Window.partitionBy("x").orderBy("series").rowsBetween(Window.unboundedPreceding, 0)))


def shares(df: DataFrame, x: str, y: str | None = None, agg: str = "count") -> DataFrame:
    """Pie, donut or funnel: aggregate by label and its share; sorted by the consumer."""
    found = grouped(df, x, y, agg)
    total = found.agg(F.sum("y").alias("_t"))
    return found.crossJoin(F.broadcast(total)).select("x", "y", F.try_divide("y", "_t").alias("share"))


def waterfall(df: DataFrame, x: str, y: str, agg: str = "sum") -> DataFrame:
    """Steps by label with where each begins and ends; sums run over ranges of labels."""
    steps = cumulated(grouped(df, x, y, agg), [], "x", "y")
    return steps.select("x", "y", (F.col("upto") - F.col("y")).alias("start"), F.col("upto").alias("end"))


def treemap(df: DataFrame, parent: str, child: str, y: str | None = None) -> DataFrame:
    """parent, child (null for the parent's own row) and value, both levels from one scan."""
    rows = df.select(label(F.col(parent)).alias("parent"), label(F.col(child)).alias("child"), *([F.col(y)] if y else []))
    return rows.groupingSets([["parent"], ["parent", "child"]], "parent", "child").agg(_measure(y, "sum" if y else "count").alias("value"))


def radar(df: DataFrame, axis: str, y: str, series: str, order: str) -> DataFrame:
    """The last value (by order) of each series on each axis; 0 where there is none."""
    rows = df.select(label(F.col(series)).alias("series"), label(F.col(axis)).alias("axis"), to_number(F.col(y)).alias("y"), F.col(order).alias("_o"))
    last = rows.groupBy("series", "axis").agg(F.max_by("y", "_o").alias("y"))
    last = checkpointed(last)
    spine = last.select("series").distinct().crossJoin(if_few(last.select("axis").distinct()))
    return spine.join(last, ["series", "axis"], "left").select("series", "axis", F.coalesce("y", F.lit(0.0)).alias("y"))


def sankey(df: DataFrame, source: str, target: str, value: str | None = None) -> DataFrame:
    """Links between numbered nodes: source, target, their numbers, and the value (1 a row by default)."""
    links = df.groupBy(label(F.col(source)).alias("source"), label(F.col(target)).alias("target")).agg(F.coalesce(F.sum(to_number(F.col(value))) if value else F.count(F.lit(1)).cast("double"), F.lit(0.0)).alias("value"))
    links = checkpointed(links)
    nodes = placed(links.select(F.explode(F.array("source", "target")).alias("node")).distinct(), ["node"])[0].select("node", F.col("place").cast("int").alias("number"))
    for side in ("source", "target"):
        links = links.join(nodes.select(F.col("node").alias(side), F.col("number").alias(f"{side}_number")), side)
    return links.select("source", "target", "source_number", "target_number", "value")


def figure(data: DataFrame, kind: str, title: str = "", most: int = 100_000) -> DataFrame:
    """chunk, data (JSON of a chart trace, a list for each column) and layout: a row for so many points in the order of their columns."""
    rows, n = placed(data, data.columns)
    lists = F.struct(F.lit(kind).alias("type"), *(F.col("_r")[c].alias(c) for c in data.columns))
    found = rows.withColumn("chunk", F.expr(f"cast(place div {most} as int)")).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", *data.columns))).alias("_r"))
    if not n:
        found = data.sparkSession.range(1).select(F.lit(0).alias("chunk"), F.array().cast(found.schema["_r"].dataType).alias("_r"))
    return found.select("chunk", F.to_json(lists).alias("data"), F.to_json(F.struct(F.lit(title).alias("title"))).alias("layout"))


def aggregate(df: DataFrame, type: str, x: str, y: str | None = None, hue: str | None = None, size: str | None = None, agg: str | None = None, bins: int = 30, resample: str | None = None, order: str | None = None) -> DataFrame:
    """The aggregate of a chart specification; any other type is grouped by x. A radar takes the last value by order, or the largest."""
    builders = {
        "histogram": lambda: histogram(df, x, bins, hue),
        "box": lambda: quartiles(df, y or x, x if y else None),
        "violin": lambda: quartiles(df, y or x, x if y else None),
        "heatmap": lambda: heatmap_numeric(df, x, y, bins) if agg == "numeric" else heatmap_labels(df, x, y),
        "line": lambda: (resampled(df, x, y, resample, agg or "mean") if resample else grouped(df, x, y, agg, hue)).orderBy("x"),
        "scatter": lambda: points(df, x, y, None, hue, [order] if order else ()),
        "bubble": lambda: points(df, x, y, size, hue, [order] if order else ()),
        "area": lambda: stacked(df, x, y, hue).orderBy("x", "series") if hue else grouped(df, x, y, agg).orderBy("x"),
        "pie": lambda: shares(df, x, y, agg or "count"),
        "donut": lambda: shares(df, x, y, agg or "count"),
        "funnel": lambda: shares(df, x, y, agg or "count"),
        "waterfall": lambda: waterfall(df, x, y, agg or "sum"),
        "treemap": lambda: treemap(df, hue or x, x, y),
        "sankey": lambda: sankey(df, x, y, size),
        "radar": lambda: radar(df, x, y, hue, order or y),
    }
    return builders.get(type, lambda: grouped(df, x, y, agg, hue))()
