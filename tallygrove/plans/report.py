"""Named operations with one calling form, and the report that they return."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_number
from ..operators import chart, describe, ols, quality, recommend, tests_param, tests_rank


class OperationError(ValueError):
    """A request that cannot be met; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Report:
    """The tables of an operation, still lazy, and its warnings."""

    op: str
    tables: dict[str, DataFrame]
    warnings: list[str] = field(default_factory=list)


def _describe(df, **_):
    numeric = describe.numeric_columns(df)
    tables = {"shape": describe.duplicate_rows(df), "missing": describe.null_rates(df)}
    return tables | ({"numeric": describe.numeric_core_stats(df, numeric)} if numeric else {})


def _ols(df, y, x, **options):
    fit = ols.ols(df, y, x, **options)
    return {"coefficients": fit.coefficients(), "summary": fit.summary(), "breusch_pagan": fit.breusch_pagan()} | fit.figures()


def _normality(df, column, **options):
    n = df.where(to_number(F.col(column)).isNotNull()).count()
    bins = min(30, max(8, math.isqrt(n)))
    return {"test": tests_param.normality(df, column, **options), "qq": tests_param.qq_points(df, column), "histogram": chart.histogram(df, column, bins)}


def _quality(df, **options):
    cleaned, summary = quality.quality_process(df, **options)
    return {"cleaned": cleaned, "summary": summary}


OPERATIONS = {
    "describe": _describe,
    "quality": lambda df, **o: {"missing": quality.missing_by_column(df), "pattern": describe.missing_pattern(df), "outliers": quality.outlier_summary(df, **o)},
    "quality_process": _quality,
    "corr": lambda df, **o: {"pairs": tests_param.corr(df, **o)},
    "ttest": lambda df, **o: {"test": tests_param.ttest(df, **o), "groups": tests_param.group_moments(df, o["value"], o["group"])},
    "chisq": lambda df, **o: {"test": tests_param.chisq(df, **o), "contingency": tests_param.contingency(df, o["a"], o["b"])},
    "anova": lambda df, **o: {"test": tests_param.anova(df, **o), "groups": tests_param.group_moments(df, o["value"], o["group"]), "limits": tests_param.eta_squared_limits(df, **o)},
    "normality": _normality,
    "ci_mean": lambda df, **o: {"interval": tests_param.ci_mean(df, **o)},
    "mannwhitney": lambda df, **o: {"test": tests_rank.mannwhitney(df, **o)},
    "wilcoxon": lambda df, **o: {"test": tests_rank.wilcoxon(df, **o)},
    "kruskal": lambda df, **o: {"test": tests_rank.kruskal(df, **o)},
    "tukey": lambda df, **o: {"pairs": tests_param.tukey(df, **o)},
    "pairwise_adjusted": lambda df, **o: {"pairs": tests_param.pairwise_adjusted(df, **o)},
    "ols": _ols,
    "recommend": lambda df, **o: {"recommended": recommend.recommend(df, **o)},
}


def run(df: DataFrame, op: str, args: dict | None = None) -> Report:
    """The report of a named operation; an empty table gives an empty report with a warning."""
    if op not in OPERATIONS:
        raise OperationError("UNSUPPORTED_OP", f"no operation {op!r}")
    if args is not None and not isinstance(args, dict):
        raise OperationError("INVALID_PAYLOAD", "args is a dictionary")
    for c in (v for k, v in (args or {}).items() if k in ("value", "group", "a", "b", "column", "y")):
        if c is not None and c not in df.columns:
            raise OperationError("MISSING_COLUMN", f"no column {c!r}")
    if df.isEmpty():
        return Report(op, {}, ["The table is empty."])
    return Report(op, OPERATIONS[op](df, **(args or {})))
