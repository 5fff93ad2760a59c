"""Comparison of named datasets: {name: DataFrame}."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import to_number
from .describe import duplicate_rows
from .profile import column_kinds, top_missing
from .quantiles import quantiles
from .ranks import quantiles_by


def shared_columns(datasets: dict[str, DataFrame], most: int | None = None) -> list[str]:
    """Columns that all datasets have, in the first's order; most limits a report to so many."""
    frames = list(datasets.values())
    return [c for c in frames[0].columns if all(c in f.columns for f in frames)][:most] if frames else []


def stacked(datasets: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """All datasets' rows with a column dataset."""
    out = None
    for name, frame in datasets.items():
        part = (frame.select(*columns) if columns else frame).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def list_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """dataset, rows, columns, shared (how many columns all have)."""
    shared = len(shared_columns(datasets, None))
    out = None
    for name, frame in datasets.items():
        row = frame.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.lit(len(frame.columns)).cast("long").alias("columns"), F.lit(shared).cast("long").alias("shared"))
        out = row if out is None else out.union(row)
    return out


def shared_kinds(datasets: dict[str, DataFrame]) -> DataFrame:
    """column, kind: numeric or dateLike only if so in every dataset, else categorical."""
    columns, out = shared_columns(datasets), None
    for frame in datasets.values():
        part = column_kinds(frame.select(*columns)).select("column", "kind")
        out = part if out is None else out.union(part)
    agreed = F.when(F.count_distinct("kind") == 1, F.min("kind")).otherwise("categorical")
    return out.groupBy("column").agg(agreed.alias("kind"))


def compare_describe(datasets: dict[str, DataFrame]) -> DataFrame:
    """Per dataset: rows, columns, duplicates, the column with most missing, and mean, median, sd of the first shared numeric column."""
    numbers = [c for c in shared_columns(datasets) if all(f.where(to_number(F.col(c).cast("string")).isNotNull()).limit(1).count() for f in datasets.values())]
    out = None
    for name, frame in datasets.items():
        row = duplicate_rows(frame).withColumn("dataset", F.lit(name))
        missing = top_missing(frame, 1).agg(F.first(F.concat("column", F.lit(" ("), F.col("rate").cast("string"), F.lit("%)"))).alias("top_missing"))
        row = row.crossJoin(F.broadcast(missing))
        if numbers:
            x = to_number(F.col(numbers[0]).cast("string"))
            median = quantiles(frame, {"x": x}, [0.5])["x"][0]
            row = row.crossJoin(F.broadcast(frame.agg(F.lit(numbers[0]).alias("measure"), F.round(F.avg(x), 4).alias("mean"), F.round(F.lit(median).cast("double"), 4).alias("median"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("sd"))))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def stat_diff_numeric(datasets: dict[str, DataFrame], top: int = 3) -> DataFrame:
    """Shared numeric columns by how far the datasets' (rounded) means are apart."""
    columns = [r.column for r in shared_kinds(datasets).where("kind = 'numeric'").orderBy("column").collect()]
    return numeric_means(datasets, columns).groupBy("column").agg(F.round(F.max("mean") - F.min("mean"), 4).alias("mean_delta"), F.count(F.lit(1)).alias("datasets")).orderBy(F.desc("mean_delta"), "column").limit(top)


def numeric_means(datasets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """column, dataset, n, mean, median, sd."""
    rows = stacked(datasets, columns).select("dataset", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), to_number(F.col(c).cast("string")).alias("x")) for c in columns)))).where("x is not null")
    x, n = F.col("x"), F.col("n")
    mean = F.sum(x * n) / F.sum(n)
    middle = quantiles_by(rows, ["column", "dataset"], "x", {"median": 0.5}, mean=mean)
    spread = rows.groupBy("column", "dataset").agg(F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    return middle.join(spread, ["column", "dataset"]).select("column", "dataset", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "sd")))


def stat_diff_categorical(datasets: dict[str, DataFrame], columns: list[str] | None = None, top: int = 3) -> DataFrame:
    """Shared categorical columns by the gap between the datasets' commonest labels' shares, as ratios."""
    columns = columns or [r.column for r in shared_kinds(datasets).where("kind = 'categorical'").orderBy("column").collect()]
    rows = stacked(datasets, columns).select("dataset", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns)))).where("v is not null and v <> ''")
    counts = rows.groupBy("column", "dataset", "v").agg(F.count(F.lit(1)).alias("c"))
    shares = counts.groupBy("column", "dataset").agg(F.round(F.max("c") / F.sum("c"), 4).alias("share"))
    return shares.groupBy("column").agg(F.round(F.max("share") - F.min("share"), 4).alias("dominance_gap")).orderBy(F.desc("dominance_gap"), "column").limit(top)


def concrete_test(kinds: dict[str, list[str]], levels: dict[str, int], mode: str = "auto") -> dict | None:
    """The operation and arguments for columns of the kinds numeric, categorical and dateLike; None if the mode fits none.

    Of the modes group, association, correlation, trend and describe, auto takes the first that fits.
    """
    numeric, text, dates = (kinds.get(k, []) for k in ("numeric", "categorical", "dateLike"))
    steps = {
        "group": _of_levels(numeric[0], text[0], levels) if numeric and text else None,
        "association": {"op": "chisq", "args": {"a": text[0], "b": text[1]}} if len(text) > 1 else None,
        "correlation": {"op": "corr", "args": {}} if len(numeric) > 1 else None,
        "trend": {"op": "describe", "args": {}} if dates and numeric else None,
        "describe": {"op": "describe", "args": {}} if numeric or text or dates else None,
    }
    return next((s for s in steps.values() if s), None) if mode == "auto" else steps.get(mode)


def _of_levels(value: str, group: str, levels: dict[str, int]) -> dict | None:
    """Two levels call for a t-test, more for an analysis of variance, fewer for neither."""
    n = levels.get(group, 0)
    return {"op": "ttest" if n == 2 else "anova", "args": {"value": value, "group": group}} if n >= 2 else None


def _kinds(frame: DataFrame) -> tuple[dict[str, list[str]], dict[str, int]]:
    found: dict[str, list[str]] = {}
    for r in column_kinds(frame).select("column", "kind").collect():
        found.setdefault(r.kind, []).append(r.column)
    return found, _levels(frame, found.get("categorical", []))


def _levels(frame: DataFrame, text: list[str], most: int = 20) -> dict[str, int]:
    """The number of levels of each column, counted up to most; what a task sends is as few."""
    if not text:
        return {}
    rows = frame.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("v")) for c in text)))).where("v is not null")
    found = rows.distinct().withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy("v"))).where(F.col("i") <= most)
    return dict.fromkeys(text, 0) | {r.column: r.n for r in found.groupBy("column").agg(F.max("i").alias("n")).collect()}


def _numeric_step(column: str, kinds: dict[str, list[str]], levels: dict[str, int]) -> dict:
    text = kinds.get("categorical", [])
    value = column if column in kinds.get("numeric", []) else (kinds.get("numeric") or [None])[0]
    if value is None:
        return {"op": "describe", "args": {}}
    return (_of_levels(value, text[0], levels) if text else None) or {"op": "ci_mean", "args": {"column": value, "confidence": 0.95}}


def _text_step(column: str, kinds: dict[str, list[str]], levels: dict[str, int]) -> dict:
    numeric, others = kinds.get("numeric", []), [c for c in kinds.get("categorical", []) if c != column]
    step = _of_levels(numeric[0], column, levels) if numeric else None
    return step or ({"op": "chisq", "args": {"a": column, "b": others[0]}} if others else {"op": "describe", "args": {}})


def follow_ups(datasets: dict[str, DataFrame]) -> DataFrame:
    """column, kind, dataset, op, args_json: for each of the largest differences of either kind the test that would look into it."""
    known = {name: _kinds(frame.select(*shared_columns(datasets))) for name, frame in datasets.items()}
    found = [(r.column, "numeric", _numeric_step) for r in stat_diff_numeric(datasets).collect()] + [(r.column, "categorical", _text_step) for r in stat_diff_categorical(datasets).collect()]
    out = []
    for column, kind, step in found:
        for name, (kinds, levels) in known.items():
            made = step(column, kinds, levels)
            out.append((column, kind, name, made["op"], json.dumps(made["args"], sort_keys=True)))
    frame = next(iter(datasets.values()))
    return frame.sparkSession.createDataFrame(out, "column string, kind string, dataset string, op string, args_json string")


def chart_plan(datasets: dict[str, DataFrame]) -> DataFrame:
    """The chart that fits all datasets' shared columns: type, x, y, agg."""
    kinds: dict[str, list[str]] = {}
    by_column = {r.column: r.kind for r in shared_kinds(datasets).collect()}
    for c in shared_columns(datasets):
        kinds.setdefault(by_column[c], []).append(c)
    n, c, t = (kinds.get(k, []) for k in ("numeric", "categorical", "dateLike"))
    plan = (
        ("line", t[0], n[0], "mean") if t and n
        else ("bar", c[0], n[0], "mean") if c and n
        else ("scatter", n[0], n[1], None) if len(n) >= 2
        else ("histogram", n[0], None, None) if n
        else ("bar", (c + t + [None])[0], None, "count")
    )
    frame = next(iter(datasets.values()))
    return frame.sparkSession.createDataFrame([plan], "type string, x string, y string, agg string")


#: Planned comparisons: kind, priority, which kinds of columns it shows, operations; fixed values.
PLANS = (
    ("group", "high", ("numeric", "categorical"), "recommend,ttest,anova,mannwhitney,kruskal"),
    ("correlation", "high", ("numeric", "numeric"), "corr,compare_stat_diff"),
    ("trend", "medium", ("dateLike", "numeric"), "compare_chart_plan,describe"),
    ("association", "medium", ("categorical", "categorical"), "recommend,chisq"),
)
#: Where none of them fits.
LAST_PLAN = ("describe", "medium", (), "compare_describe,compare_chart_plan")
PLANNED = "kind string, columns string, priority string, operations string, missing_share double, least_level string, least_count long, op string, args_json string"


def _plan_facts(frame: DataFrame, columns: list[str], text: list[str]) -> dict[str, tuple]:
    """For each column (largest share of missing values so far, its rarest level, that level's rows)."""
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    shares = frame.agg(*(F.coalesce(F.avg(blank(c).isNull().cast("int")), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns))).first()
    levels = frame.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), blank(c).alias("v")) for c in text)))).where("v is not null") if text else None
    rare = {r.column: (r.v, r.n) for r in levels.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.min(F.struct("n", "v")).alias("m")).select("column", "m.n", "m.v").collect()} if text else {}  # one row a column
    return {c: (shares[k], *rare.get(c, (None, None))) for k, c in enumerate(columns)}


def compare_plan(datasets: dict[str, DataFrame], active: str | None = None) -> DataFrame:
    """Planned comparisons over the shared columns, with what to mind as measured on the active dataset (the first by default).

    kind, columns, priority, operations; missing_share, the larger share of missing values of the columns; least_level and least_count,
    the rarest level of the last categorical column and its rows; op and args_json, the first step.
    """
    shared = shared_columns(datasets)
    by_column = {r.column: r.kind for r in shared_kinds(datasets).collect()}
    kinds = {k: [c for c in shared if by_column[c] == k] for k in ("numeric", "categorical", "dateLike")}
    frame = datasets[active] if active else next(iter(datasets.values()))
    own, levels = _kinds(frame.select(*shared))
    plans = []
    for kind, priority, needs, operations in PLANS:
        places = [(k, needs[:i].count(k)) for i, k in enumerate(needs)]
        if all(len(kinds[k]) > i for k, i in places):
            plans.append((kind, [kinds[k][i] for k, i in places], priority, operations))
    if not plans:
        plans = [(LAST_PLAN[0], shared, LAST_PLAN[1], LAST_PLAN[3])]
    shown = sorted({c for _, columns, _, _ in plans for c in columns})
    facts = _plan_facts(frame, shown, [c for c in shown if by_column[c] == "categorical"]) if shown else {}
    rows = []
    for kind, columns, priority, operations in plans:
        step = concrete_test(own, levels, kind) or {"op": None, "args": {}}
        rare = next((facts[c][1:] for c in reversed(columns) if facts[c][2] is not None), (None, None))
        rows.append((kind, ",".join(columns), priority, operations, max((facts[c][0] for c in columns), default=None), *rare, step["op"], json.dumps(step["args"], sort_keys=True)))
    return frame.sparkSession.createDataFrame(rows, PLANNED)


def rank_datasets(datasets: dict[str, DataFrame], active: str | None = None) -> DataFrame:
    """Which dataset to look at first: score and priority from missingness, duplicates and kinds of columns."""
    out = None
    for name, frame in datasets.items():
        kinds = column_kinds(frame).agg(F.count_if(F.col("kind") == "numeric").alias("numeric"), F.count_if(F.col("kind") == "categorical").alias("text"))
        missing = top_missing(frame, 1).agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("missing"))
        facts = duplicate_rows(frame).crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(missing))
        structure = F.when((F.col("numeric") >= 1) & (F.col("text") >= 1), 2.0).when(F.col("numeric") >= 2, 2.0).when(F.col("text") >= 2, 1.5).when(F.col("numeric") + F.col("text") >= 1, 1.0).otherwise(0.0)
        score = F.lit(0.5 if name == active else 0.0) + F.when(F.col("missing") >= 20, 4.0).otherwise(0.0) + F.when(F.col("duplicates") > 0, 2.0).otherwise(0.0) + structure
        row = facts.select(F.lit(name).alias("dataset"), score.alias("score"))
        out = row if out is None else out.union(row)
    return out.withColumn("priority", F.when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "medium").otherwise("low")).orderBy(F.desc("score"), "dataset")
