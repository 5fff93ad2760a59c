"""Ordinary least squares: one scan makes the cross products, the driver solves a small system."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalar import one_hot, to_number
from .describe import NUMERIC
from ..plans.lineage import checkpointed
from .ranks import evenly, placed
from .tests_param import _row, qq_all

COEFFICIENTS = "term string, coef double, se double, t double, p double, low double, high double"


class OLSFit:
    """A fitted model: coefficient table, summary, and row-level diagnostics as column expressions."""

    def __init__(self, rows: DataFrame, y: str, terms: list[str], robust: str | None):
        self.rows, self.y, self.terms = rows, y, terms
        self.x: list[Column] = [F.lit(1.0) if t == "const" else F.col(f"`{t}`") for t in terms]
        k = len(terms)
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        sums = rows.agg(
            F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.var_pop(y).alias("vy"),
            *(F.sum(self.x[i] * self.x[j]).alias(f"g{i}_{j}") for i, j in cells), *(F.sum(self.x[i] * F.col(y)).alias(f"b{i}") for i in range(k)),
        ).first()
        self.n = sums.n
        if self.n <= k:
            raise ValueError("there are fewer rows than coefficients")
        gram = np.zeros((k, k))
        for i, j in cells:
            gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
        scale = np.sqrt(np.diag(gram))
        self.inverse = np.linalg.pinv(gram / np.outer(scale, scale)) / np.outer(scale, scale)
        self.coef = self.inverse @ np.array([sums[f"b{i}"] for i in range(k)])
        e = self.residual()
        more = rows.agg(F.sum(e * e).alias("sse")).first()
        self.sse, self.dof = more.sse, self.n - k
        self.sst = sums.vy * self.n if "const" in terms else sums.yy
        self.s2 = self.sse / self.dof
        self.cov = self.s2 * self.inverse if not robust else self._sandwich(robust.upper())

    def fitted(self) -> Column:
        return sum((float(c) * x for c, x in zip(self.coef, self.x, strict=True)), F.lit(0.0))

    def residual(self) -> Column:
        return F.col(self.y) - self.fitted()

    def leverage(self) -> Column:
        k = len(self.x)
        return sum((float(self.inverse[i, j]) * self.x[i] * self.x[j] for i in range(k) for j in range(k)), F.lit(0.0))

    def _sandwich(self, kind: str) -> np.ndarray:
        e2 = self.residual() ** 2
        weight = {"HC0": e2, "HC1": e2 * (self.n / self.dof), "HC2": e2 / (1 - self.leverage()), "HC3": e2 / (1 - self.leverage()) ** 2}[kind]
        k = len(self.x)
        sums = self.rows.withColumn("_w", weight).agg(*(F.sum(F.col("_w") * self.x[i] * self.x[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
        meat = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                meat[i, j] = meat[j, i] = sums[f"m{i}_{j}"]
        return self.inverse @ meat @ self.inverse

    def coefficients(self) -> DataFrame:
        critical, out = special.t_ppf(0.975, self.dof), []
        for term, c, v in zip(self.terms, self.coef.tolist(), np.diag(self.cov).tolist(), strict=True):
            se = math.sqrt(max(v, 0.0))
            t = c / se if se > 0 else None
            out.append((term, c, se, t, 2 * special.t_sf(abs(t), self.dof) if t is not None else None, c - critical * se, c + critical * se))
        return self.rows.sparkSession.createDataFrame(out, COEFFICIENTS)

    def summary(self) -> DataFrame:
        k = len(self.terms)
        constant = "const" in self.terms
        df_model = k - constant
        r2 = 1 - self.sse / self.sst if self.sst > 0 else math.nan
        f = (self.sst - self.sse) / df_model / self.s2 if df_model and self.s2 > 0 else math.nan
        loglik = -self.n / 2 * (math.log(2 * math.pi * self.sse / self.n) + 1) if self.sse > 0 else math.nan
        found = {"n": self.n, "df_resid": self.dof, "r2": r2, "adj_r2": 1 - (1 - r2) * (self.n - constant) / self.dof, "f": f, "f_p": special.f_sf(f, df_model, self.dof) if f == f else None, "aic": 2 * k - 2 * loglik, "bic": k * math.log(self.n) - 2 * loglik}
        return _row(self.rows, found, "n long, df_resid long, r2 double, adj_r2 double, f double, f_p double, aic double, bic double")

    def breusch_pagan(self) -> DataFrame:
        """LM = n R2 of the squared residuals on the terms, and its F."""
        squared = self.rows.withColumn("_e2", self.residual() ** 2)
        fit = OLSFit(squared, "_e2", self.terms, None)
        q, r2 = len(self.terms) - 1, 1 - fit.sse / fit.sst
        f = r2 / q / ((1 - r2) / fit.dof)
        return _row(self.rows, {"lm": self.n * r2, "lm_p": special.chi2_sf(self.n * r2, q), "f": f, "f_p": special.f_sf(f, q, fit.dof)}, "lm double, lm_p double, f double, f_p double")

    def diagnostics(self) -> DataFrame:
        """The rows with fitted, residual, leverage, standardized residual, its root and Cook's distance."""
        out = self.rows.withColumns({"fitted": self.fitted(), "residual": self.residual(), "leverage": self.leverage()})
        inner = F.col("residual") / F.sqrt(F.lit(self.s2) * F.greatest(1 - F.col("leverage"), F.lit(1e-12)))
        out = out.withColumn("standardized", inner).withColumn("scale_location", F.sqrt(F.abs("standardized")))
        return out.withColumn("cooks_distance", F.col("standardized") ** 2 * F.col("leverage") / ((1 - F.col("leverage")) * len(self.terms)))


    def figures(self, most: int = 1200) -> dict[str, DataFrame]:
        """Residuals and scale by fitted value and Cook's distances by row number, of so many rows evenly spaced in the rows' order; Q-Q of all standardized residuals, from 5 rows.

        The rows' order is that of the columns named as order in ols(), else of fitted value and residual.
        """
        order = [c for c in self.rows.columns if c.startswith("_o")] or ["fitted", "residual"]
        rows = self.diagnostics().select(*dict.fromkeys(["fitted", "residual", "scale_location", "cooks_distance", "standardized", *order]))
        numbered, n = placed(rows, order)
        few = checkpointed(evenly(numbered, n, most))
        found = {"residual_fitted": few.select("fitted", "residual"), "scale_location": few.select("fitted", "scale_location"), "cooks_distance": few.select(F.col("place").alias("row"), "cooks_distance")}
        return found | ({"residual_qq": qq_all(rows, "standardized", most)} if self.n >= 5 else {})


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose values don't vary."""
    spread = df.agg(*((F.min(f"`{c}`") < F.max(f"`{c}`")).alias(f"v{k}") for k, c in enumerate(columns))).first() if columns else ()
    return [c for c, varies in zip(columns, spread, strict=True) if not varies]


def ols(df: DataFrame, y: str, x: list[str], add_intercept: bool = True, dummy: bool = True, drop_first: bool = True, robust: str | None = None, order: list[str] = ()) -> OLSFit:
    """y on x over complete cases; text columns as dummies, constant columns left out. robust: HC0 to HC3. order names columns that say how rows follow one another, for figures."""
    kept = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]
    rows = df.select(y, *x, *kept).na.drop(subset=[y, *x])
    terms = []
    for c in x:
        if isinstance(rows.schema[c].dataType, NUMERIC):
            rows = rows.withColumn(c, F.col(c).cast("double"))
            terms.append(c)
        elif dummy:
            before = set(rows.columns)
            rows = one_hot(rows, c, drop_first)
            terms += [n for n in rows.columns if n not in before]
    rows = rows.withColumn(y, to_number(F.col(y)))
    still = set(constant_columns(rows, terms))
    terms = [c for c in terms if c not in still]
    if not terms:
        raise ValueError("no predictor varies")
    return OLSFit(rows.select(y, *(f"`{t}`" for t in terms), *(f"_o{k}" for k in range(len(order)))), y, ["const", *terms] if add_intercept else terms, robust)
