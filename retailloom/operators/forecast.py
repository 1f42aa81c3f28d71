"""Trend plus yearly seasonality, fitted to many series at once.

The model follows the additive form of Taylor and Letham, "Forecasting at Scale" (2018): a
piecewise linear trend whose slope may change at evenly spaced points, and a Fourier series
over the year. The changes of slope have a Laplace prior, the other coefficients normal ones. For a
given noise the most probable coefficients are found exactly, by an active set of those slope
changes that are not zero; the conditions of optimality are checked. Noise and coefficients take turns
until both rest. Each series holds one row per week, so a fit is small; Spark spreads the series
over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailloom.operators.series import future_weeks

YEAR_DAYS = 365.25
FOURIER_ORDER = 10
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
SLOPE_CHANGE_SCALE = 0.05
SEASON_SCALE = 10.0
TREND_SCALE = 5.0
# The fit has settled when no fitted value moves by more than this share of the largest value.
SETTLED = 1e-6
MAX_ROUNDS = 200
# Steps of the active set, in each of which one slope change enters or leaves.
MAX_STEPS = 1000
# How far the gradient may be from the conditions of optimality, as a share of the prior's weight.
OPTIMAL = 1e-4


def _design(
    days: np.ndarray, first: float, span: float, knots: np.ndarray, order: int
) -> np.ndarray:
    t = (days - first) / span
    angle = 2 * np.pi * np.outer(days / YEAR_DAYS, np.arange(1, order + 1))
    return np.hstack(
        [
            np.ones((len(t), 1)),
            t[:, None],
            np.maximum(t[:, None] - knots[None, :], 0.0),
            np.sin(angle),
            np.cos(angle),
        ]
    )


def most_probable(
    x: np.ndarray, y: np.ndarray, slopes: slice, weight: float, theta: np.ndarray
) -> np.ndarray:
    """Minimum of |x theta - y|^2 / 2 + weight * (sum of the absolute slopes), from ``theta``.

    Slopes that are zero stay out of the system of equations. Of those whose gradient exceeds the
    weight the steepest enters, with the sign that lowers the sum. On the way to the solution of the system a
    slope may reach zero: the lowest point of the line counts, and what is zero there leaves.
    """
    theta = theta.copy()
    penalised = np.zeros(len(theta), bool)
    penalised[slopes] = True
    signs = np.where(penalised, np.sign(theta), 0.0)
    for _ in range(MAX_STEPS):
        used = np.flatnonzero(~penalised | (signs != 0))
        # By orthogonal steps, for the products of columns have twice the digits to lose.
        q, r = np.linalg.qr(x[:, used])
        pull = np.linalg.solve(r.T, weight * signs[used])
        goal = np.zeros(len(theta))
        goal[used] = np.linalg.solve(r, q.T @ y - pull)
        # Where a slope passes zero; the whole way is 1.
        way = goal - theta
        passed = penalised & (theta != 0) & (np.sign(goal) != signs)
        stops = [t for t in (-theta[passed] / way[passed]).tolist() if 0 < t < 1]
        best = min(
            (theta + t * way for t in [*sorted(stops), 1.0]),
            key=lambda at: ((x @ at - y) ** 2).sum() / 2 + weight * np.abs(at[slopes]).sum(),
        )
        theta = np.where(penalised & (np.abs(best) <= 1e-13 * np.abs(best).max(initial=1.0)), 0.0, best)
        if (np.sign(theta) != signs)[penalised].any():
            signs = np.where(penalised, np.sign(theta), 0.0)
            continue
        gradient = x.T @ (x @ theta - y)
        out = np.where(penalised & (signs == 0), np.abs(gradient) - weight, 0.0)
        steepest = int(out.argmax())
        if out[steepest] <= OPTIMAL * weight / 10:
            return theta
        signs[steepest] = -np.sign(gradient[steepest])
    raise RuntimeError(f"no active set found in {MAX_STEPS} steps")


def optimality_gap(x: np.ndarray, y: np.ndarray, slopes: slice, weight: float, theta: np.ndarray) -> float:
    """The largest breach of the conditions that hold at the minimum and nowhere else, as a share of
    the weight: no gradient but for slopes; for these minus the weight and sign, or up to the weight at zero."""
    gradient = x.T @ (x @ theta - y)
    change, slope = theta[slopes], gradient[slopes]
    inside = np.maximum(np.abs(slope) - weight, 0.0)
    gradient[slopes] = np.where(change == 0, inside, slope + weight * np.sign(change))
    return float(np.abs(gradient).max(initial=0.0) / weight)


@dataclass
class AdditiveFit:
    """Coefficients of one series: level, slope, slope changes, sines and cosines, as shares of the
    largest value over the span of the history."""

    theta: np.ndarray
    knots: np.ndarray
    first: float
    span: float
    scale: float
    order: int
    noise: float
    rounds: int
    gap: float

    def predict(self, days: np.ndarray) -> np.ndarray:
        return _design(days, self.first, self.span, self.knots, self.order) @ self.theta * self.scale


def fit_series(
    days: np.ndarray, values: np.ndarray, order: int = FOURIER_ORDER, changepoints: int = CHANGEPOINTS
) -> AdditiveFit:
    """Fit one series of at least two values, not all zero (days since 1970).

    ``order`` is that of the Fourier series. The slope may change ``changepoints`` times, but at
    most once a week of history. A fit that does not settle, or is not optimal, fails.
    """
    in_time = np.argsort(days, kind="stable")
    days, values = days[in_time], values[in_time]
    scale = np.abs(values).max()
    first, span = days[0], max(days[-1] - days[0], 1.0)
    history = int(len(days) * CHANGEPOINT_RANGE)
    n_knots = max(0, min(changepoints, history - 1))
    at = np.linspace(0, max(history - 1, 0), n_knots + 1).round().astype(int)[1:]
    knots = (days[at] - first) / span

    x, y = _design(days, first, span, knots, order), values / scale
    slopes = slice(2, 2 + n_knots)
    ridge = np.full(x.shape[1], 1.0 / SEASON_SCALE**2)
    ridge[:2] = 1.0 / TREND_SCALE**2
    theta, weight = np.zeros(x.shape[1]), 1.0 / SLOPE_CHANGE_SCALE
    # With few weeks several sets of slope changes do equally well; this settles for the smallest.
    ridge[slopes] = 1e-6 * weight
    noise, fitted = y.var() + 1e-9, np.full(len(y), np.inf)
    for rounds in range(1, MAX_ROUNDS + 1):
        # The normal priors are rows of their own.
        rows = np.vstack([x / np.sqrt(noise), np.diag(np.sqrt(ridge))])
        goal = np.r_[y / np.sqrt(noise), np.zeros(len(ridge))]
        theta = most_probable(rows, goal, slopes, weight, theta)
        gap = optimality_gap(rows, goal, slopes, weight, theta)
        before, fitted = fitted, x @ theta
        noise = max(float(np.mean((y - fitted) ** 2)), 1e-9)
        if np.abs(fitted - before).max() <= SETTLED:
            if gap > OPTIMAL:
                raise RuntimeError(f"the fit is not optimal: conditions missed by {gap:.2g}")
            return AdditiveFit(theta, knots, first, span, scale, order, noise, rounds, gap)
    raise RuntimeError(f"the fit has not settled after {MAX_ROUNDS} rounds")


def fit_predict(days: np.ndarray, values: np.ndarray, wanted: np.ndarray, **terms: int) -> np.ndarray:
    """Fit one series and evaluate it on the ``wanted`` days. Without two values and one other than
    zero there is nothing to fit, and the mean is foreseen."""
    if len(values) < 2 or not np.abs(values).max():
        return np.full(len(wanted), values.mean() if len(values) else np.nan)
    return fit_series(days, values, **terms).predict(wanted)


def additive_forecast(
    frame: DataFrame, by: Sequence[str] = (), value: str = "revenue", **terms: int
) -> DataFrame:
    """Add ``prediction`` to every row of every series.

    Rows without a ``value`` take no part in the fit and are predicted all the same. Weeks
    that are absent are gaps in the fit, not zeros. ``terms`` go to ``fit_predict``.
    """
    keys = list(by)
    series = frame.withColumn(value, F.col(value).cast("double"))
    if not keys:
        keys, series = ["_series"], series.withColumn("_series", F.lit(0))
    schema = T.StructType([*series.schema.fields, T.StructField("prediction", T.DoubleType())])

    def one_series(rows: pd.DataFrame) -> pd.DataFrame:
        days = rows["week"].to_numpy().astype("datetime64[D]").astype(float)
        values = rows[value].to_numpy(float)
        known = ~np.isnan(values)
        return rows.assign(prediction=fit_predict(days[known], values[known], days, **terms))

    predicted = series.groupBy(*keys).applyInPandas(one_series, schema)
    return predicted.select(*frame.columns, "prediction")


def forecast_ahead(history: DataFrame, periods: int, by: Sequence[str] = ()) -> DataFrame:
    """Fitted values over the history and predictions for the next ``periods`` Mondays."""
    columns = [*by, "week"]
    ahead = future_weeks(history, periods, by, with_history=False)
    frame = history.select(*columns, F.col("revenue").cast("double")).unionByName(
        ahead.withColumn("revenue", F.lit(None).cast("double"))
    )
    return additive_forecast(frame, by).select(*columns, "prediction")
