"""Which tests fit a table, as ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import numeric_by_rule

#: Other names of goals; fixed values.
GOALS = {"group_compare": "compare_two_groups", "compare_groups": "compare_two_groups", "group_compare_multi": "compare_multi_groups", "paired": "paired_difference", "paired_test": "paired_difference"}

#: Rules: operation, priority, chart, what the facts must be, x and y of the chart, arguments, why; SQL over the facts. Fixed
#: values are operations, priorities, charts and argument names.
RULES = [
    ("describe", 90, "histogram", "true", "value", "null", "'{}'", "a first look at spread and missing values"),
    ("corr", 80, "scatter", "size(numbers) >= 2", "get(numbers, 0)", "get(numbers, 1)", "'{}'", "two numeric columns or more"),
    ("chisq", 30, "bar", "goal in ('auto', 'association', 'categorical_association') and label_b is not null", "label_a", "null", "to_json(struct(label_a as a, label_b as b))", "two categorical columns"),
    ("wilcoxon", 30, "scatter", "goal in ('auto', 'paired_difference') and number_b is not null", "number_a", "number_b", "to_json(struct(number_a as a, number_b as b))", "paired numeric columns"),
    ("ols", 35, "scatter", "goal in ('auto', 'regression', 'prediction') and size(predictors) > 0", "get(predictors, 0)", "outcome", "to_json(struct(predictors as x, outcome as y))", "a numeric target and predictors"),
    ("normality", 40, "histogram", "shape", "outcome", "null", "to_json(struct(outcome as column))", "shape before parametric tests"),
    ("ci_mean", 45, "histogram", "shape", "outcome", "null", "to_json(struct(outcome as column, 0.95D as confidence))", "how sure the mean is"),
    ("ttest", 10, "box", "compared and levels = 2", "label", "value", "to_json(struct(label as group, value))", "two groups, normal values"),
    ("mannwhitney", 15, "box", "compared and levels = 2", "label", "value", "to_json(struct(label as group, value))", "two groups, any distribution"),
    ("anova", 10, "box", "compared and levels > 2", "label", "value", "to_json(struct(label as group, value))", "several groups, normal values"),
    ("kruskal", 15, "box", "compared and levels > 2", "label", "value", "to_json(struct(label as group, value))", "several groups, any distribution"),
    ("tukey", 20, "box", "compared and levels > 2", "label", "value", "to_json(struct(0.05D as alpha, label as group, value))", "which groups differ"),
    ("pairwise_adjusted", 25, "box", "compared and levels > 2", "label", "value", "to_json(struct(label as group, 'holm' as pAdjust, value))", "pairs with correction for their number"),
]


#: What the operations are called in a list.
LABELS = {
    "describe": "Description", "corr": "Correlations", "chisq": "Chi-square test", "wilcoxon": "Signed-rank test", "ols": "Least squares", "normality": "Normality", "ci_mean": "Interval of the mean",
    "ttest": "t-test", "mannwhitney": "Rank-sum test", "anova": "Analysis of variance", "kruskal": "Rank test of several groups", "tukey": "Pairs after Tukey", "pairwise_adjusted": "Adjusted pairs",
}


def _chosen(asked: str, among: str, other: str = "''") -> str:
    """SQL: the asked column if it is among those of a kind and not the other, else the first such."""
    left = f"filter({among}, c -> c <> coalesce({other}, ''))"
    return f"coalesce(if(array_contains({left}, {asked}), {asked}, null), try_element_at({left}, 1))"


def facts(df: DataFrame, goal: str, **asked: str | None) -> DataFrame:
    """One row: the goal, columns by kind, and those that a test would take."""
    goal = GOALS.get(goal.strip().lower(), goal.strip().lower())
    numbers = numeric_by_rule(df, "rows60")
    named = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    row = df.sparkSession.range(1).select(
        F.lit(goal).alias("goal"), named(numbers).alias("numbers"), named([c for c in df.columns if c not in numbers]).alias("labels"), named(df.columns).alias("every"),
        *(F.lit(asked.get(n)).cast("string").alias(f"asked_{n}") for n in ("value", "group", "a", "b")),
    )
    row = row.selectExpr(
        "*", "if(array_contains(every, asked_value), asked_value, try_element_at(numbers, 1)) as value", "if(array_contains(every, asked_group), asked_group, try_element_at(labels, 1)) as label",
        f"{_chosen('asked_a', 'labels')} as label_a", f"{_chosen('asked_a', 'numbers')} as number_a", f"{_chosen('asked_value', 'numbers')} as outcome",
    )
    row = row.selectExpr("*", f"{_chosen('asked_b', 'labels', 'label_a')} as label_b", f"{_chosen('asked_b', 'numbers', 'number_a')} as number_b", "slice(filter(numbers, c -> c <> outcome), 1, 3) as predictors")
    label = row.first().label
    levels = df.agg(F.count_distinct(F.col(f"`{label}`").cast("string")).alias("levels")) if label else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("levels"))
    row = row.crossJoin(F.broadcast(levels))
    return row.selectExpr("*", "goal in ('auto', 'compare_two_groups', 'compare_multi_groups') and value is not null and label is not null as compared", "goal in ('auto', 'distribution', 'quality', 'assumption') and outcome is not null as shape")


def recommend(df: DataFrame, goal: str = "auto", value: str | None = None, group: str | None = None, a: str | None = None, b: str | None = None) -> DataFrame:
    """Operations by priority for a goal: auto, compare_two_groups, association, paired_difference, regression, distribution, ..."""
    rows = F.array(*(F.expr(f"struct({fits} as fits, {priority} as priority, '{op}' as op, '{LABELS[op]}' as label, '{why}' as reason, '{chart}' as chart_type, cast({x} as string) as x_hint, cast({y} as string) as y_hint, {args} as args_json)") for op, priority, chart, fits, x, y, args, why in RULES))
    fitting = facts(df, goal, value=value, group=group, a=a, b=b).select(F.inline(rows)).where("fits")
    first = fitting.withColumn("k", F.row_number().over(Window.partitionBy("op", "args_json").orderBy("priority"))).where("k = 1")
    return first.withColumn("rank", F.row_number().over(Window.orderBy("priority", "op"))).select("rank", "priority", "op", "label", "reason", "chart_type", "x_hint", "y_hint", "args_json")
