"""OLS with heteroskedasticity- and autocorrelation-robust errors, from distributed cross products.

The design never comes to the driver: the triangular factor of design and dependent (k + 1 numbers square) and the
weighted sum of lagged score products (k square) of every model are aggregates; only they are solved there. All
models of a panel go through the same two jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.checks import CheckError, require_columns
from tapeline.config import HORIZONS, VOL_WINDOW
from tapeline.session import cut_lineage

SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("horizon", T.IntegerType()), T.StructField("dependent", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("coefficient", T.DoubleType()), T.StructField("std_error", T.DoubleType()), T.StructField("t_value", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("maxlags", T.IntegerType()), T.StructField("formula", T.StringType()),
])


# The models, their dependent variables and regressors in order.
def model_specs(horizon: int, index_column: str, vol_window: int = VOL_WINDOW) -> list[tuple[str, str, list[str]]]:
    """(model, dependent, regressors) of the three models of a horizon."""
    lag, vol = f"spy_lag_log_return_{horizon}d", f"spy_lag_realized_vol_{vol_window}d"
    return [
        ("return", f"spy_fwd_log_return_{horizon}d", [index_column, lag, "vix_level", vol]),
        ("future_volatility", f"spy_fwd_realized_vol_{horizon}d", [index_column, vol, "vix_level"]),
        ("future_drawdown", f"spy_fwd_max_drawdown_{horizon}d", [index_column, lag, "vix_level", vol]),
    ]


@dataclass(frozen=True)
class Model:
    dependent: str
    regressors: tuple[str, ...]
    maxlags: int
    context: str = "regression"

    def complete(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(design with its constant, dependent) of the rows that lack nothing."""
        rows = batch[[self.dependent, *self.regressors]].dropna().to_numpy(float)
        return np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0]


def variables(panel: DataFrame, names: Sequence[str], order: str = "date") -> DataFrame:
    """(order, names...) as doubles; infinite and NaN values count as missing."""
    require_columns(panel, (order, *names), "regression")

    def clean(c: str):
        v = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias(c)

    return panel.select(order, *map(clean, names))


def _factors(rows: DataFrame, models: Sequence[Model]) -> list[tuple[int, np.ndarray]]:
    """(complete rows, R of a QR of design and dependent) of each model: a factor per partition, then one of the stacked ones."""

    def local(batches):
        n, r = [0] * len(models), [np.zeros((0, len(m.regressors) + 2)) for m in models]
        for b in batches:
            for i, m in enumerate(models):
                x, y = m.complete(b)
                n[i] += len(y)
                r[i] = np.linalg.qr(np.vstack([r[i], np.column_stack([x, y])]), mode="r")
        yield pd.DataFrame({"model": range(len(models)), "n": n, "r": [x.ravel().tolist() for x in r]})

    parts = rows.mapInPandas(local, "model int, n long, r array<double>").collect()  # a few numbers per partition and model
    out = []
    for i, m in enumerate(models):
        k, mine = len(m.regressors) + 2, [p for p in parts if p.model == i]
        stacked = np.vstack([np.zeros((0, k)), *(np.array(p.r).reshape(-1, k) for p in mine)])
        out.append((sum(p.n for p in mine), np.linalg.qr(stacked, mode="r") if len(stacked) else stacked))
    return out


def _meats(rows: DataFrame, models: Sequence[Model], betas: Sequence[np.ndarray], order: str) -> list[np.ndarray]:
    """Sums of score products of each model, lagged ones with Bartlett weights, over its complete rows in order.

    A panel has one row per day, so one task reads them all; it streams, holding `maxlags` rows per model besides its batch.
    """

    def add_up(batches):
        total = [np.zeros((len(b), len(b))) for b in betas]
        tail = [np.zeros((0, len(b))) for b in betas]
        for b in batches:
            for i, (m, beta) in enumerate(zip(models, betas)):
                x, y = m.complete(b)
                u = x * (y - x @ beta)[:, None]
                joined = np.vstack([tail[i], u])
                total[i] += u.T @ u
                for lag in range(1, m.maxlags + 1):
                    first = max(len(tail[i]), lag)
                    gamma = joined[first:].T @ joined[first - lag : max(first, len(joined)) - lag]  # none in a batch shorter than the lag
                    total[i] += (1 - lag / (m.maxlags + 1)) * (gamma + gamma.T)
                tail[i] = joined[max(0, len(joined) - m.maxlags) :] if m.maxlags else tail[i]
        yield pd.DataFrame({"model": range(len(models)), "m": [t.ravel().tolist() for t in total]})

    got = {r.model: r.m for r in rows.repartition(1).sortWithinPartitions(order).mapInPandas(add_up, "model int, m array<double>").collect()}
    return [np.array(got[i]).reshape(len(b), len(b)) for i, b in enumerate(betas)]


def fit_all(panel: DataFrame, models: Sequence[Model], order: str = "date") -> list[dict]:
    """Coefficients, HAC errors (Bartlett weights, no small-sample factor) and normal p-values of each model.

    Every design is checked before anything is solved: too few complete rows, or columns that depend on each other,
    are errors that name the model.
    """
    rows = cut_lineage(variables(panel, list(dict.fromkeys(v for m in models for v in (m.dependent, *m.regressors))), order))
    solved = []
    for m, (n, r) in zip(models, _factors(rows, models)):
        k = len(m.regressors) + 1
        if not n:
            raise CheckError(f"{m.context}: no complete rows")
        if n <= k:
            raise CheckError(f"{m.context} is underidentified: {n} complete rows for {k} parameters")
        square = r[:k, :k]
        singular = np.linalg.svd(square, compute_uv=False)
        rank = int((singular > singular.max() * max(n, k) * np.finfo(float).eps).sum())
        if rank < k:
            raise CheckError(f"{m.context} has a rank-deficient design: rank {rank} for {k} parameters")
        inner = np.linalg.inv(square)
        solved.append((n, inner @ r[:k, k], inner @ inner.T))  # the last is (X'X)^-1 without squaring the condition number
    out = []
    for m, (n, beta, bread), meat in zip(models, solved, _meats(rows, models, [b for _, b, _ in solved], order)):
        error = np.sqrt(np.diag(bread @ meat @ bread))
        t = beta / error
        out.append({"terms": ["const", *m.regressors], "coefficient": beta, "std_error": error, "t_value": t, "p_value": np.array([math.erfc(abs(v) / math.sqrt(2)) for v in t]), "n": n, "maxlags": m.maxlags})
    return out


def fit(panel: DataFrame, dependent: str, regressors: Sequence[str], maxlags: int, context: str = "regression", order: str = "date") -> dict:
    """fit_all() of one model."""
    return fit_all(panel, [Model(dependent, tuple(regressors), maxlags, context)], order)[0]


def regression_rows(panel: DataFrame, index_column: str, horizons: Sequence[int] = HORIZONS, vol_window: int = VOL_WINDOW) -> list[tuple]:
    """All models of all horizons, computed before anything is returned."""
    specs = [(h, *spec) for h in horizons for spec in model_specs(h, index_column, vol_window)]
    fits = fit_all(panel, [Model(dependent, tuple(regressors), h - 1, f"{model} regression, horizon {h}") for h, model, dependent, regressors in specs])
    out = []
    for (h, model, dependent, regressors), f in zip(specs, fits):
        formula = f"{dependent} ~ {' + '.join(regressors)}"
        out += [(model, h, dependent, term, *(float(f[c][i]) for c in ("coefficient", "std_error", "t_value", "p_value")), int(f["n"]), h - 1, formula) for i, term in enumerate(f["terms"])]
    return out


def regressions(spark: SparkSession, panel: DataFrame, index_column: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return spark.createDataFrame(regression_rows(panel, index_column, horizons), SCHEMA)
