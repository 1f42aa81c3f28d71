import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest

from retailloom.operators import forecast
from retailloom.operators.forecast import fit_predict, forecast_ahead
from retailloom.plans import forecasting

MONDAY = datetime(2015, 1, 5)


def signal(days):
    days = np.asarray(days, float)
    return 1000 + 0.2 * (days - days.min()) + 150 * np.sin(2 * np.pi * days / 365.25)


def test_recovers_trend_and_season():
    days = 16440 + 7.0 * np.arange(200)
    truth = signal(days)
    found = fit_predict(days[:187], truth[:187], days)
    assert np.abs(found - truth).max() < 0.01 * truth.mean()


def test_follows_a_change_of_slope():
    days = 7.0 * np.arange(150)
    truth = np.where(days < 500, 100 + days, 600 - 0.5 * (days - 500))
    found = fit_predict(days[:140], truth[:140], days)
    assert np.abs(found[:140] - truth[:140]).mean() < 0.03 * truth.mean()


@pytest.mark.parametrize("values", [[5.0], [0.0, 0.0, 0.0]])
def test_single_and_empty_weeks(values):
    days = 7.0 * np.arange(len(values))
    assert fit_predict(days, np.array(values), np.array([70.0]))[0] == values[0]


def test_no_history():
    assert np.isnan(fit_predict(np.array([]), np.array([]), np.array([70.0]))).all()


def test_two_weeks_are_met():
    """Two weeks say nothing about the year, but the fit must pass through them."""
    days = np.array([0.0, 7.0])
    assert fit_predict(days, np.array([3.0, 3.0]), days) == pytest.approx([3, 3], abs=0.1)


@pytest.fixture(scope="module")
def two_series(spark):
    days = 16440 + 7.0 * np.arange(160)
    rows = [
        (name, MONDAY + timedelta(weeks=i), float(v * k))
        for name, k in (("a", 1.0), ("b", 3.0))
        for i, v in enumerate(signal(days))
        if not (name == "b" and i in (20, 150))
    ]
    return spark.createDataFrame(rows, "Country string, week timestamp_ntz, revenue double")


def test_many_series_at_once(two_series):
    rows = forecast_ahead(two_series, 13, ["Country"]).collect()
    assert sum(r.Country == "a" for r in rows) == 173 and sum(r.Country == "b" for r in rows) == 171
    assert max(r.week for r in rows) == MONDAY + timedelta(weeks=172)


def test_comparison_meets_actual_weeks_by_date(two_series):
    """A week missing from the test span must not shift the predictions."""
    found = forecasting.compare(two_series, ["Country"])
    assert found.count() == 2 * 2 * 13
    scores = {(r.Country, r.model): r["MAPE_%"] for r in forecasting.accuracy(found, ["Country"]).collect()}
    assert scores["a", forecasting.ADDITIVE] < 1.5 and scores["b", forecasting.ADDITIVE] < 1.5
    assert scores["b", forecasting.ADDITIVE] < scores["b", forecasting.NAIVE]


def test_long_gaps_and_unnamed_series_lose_no_rows(spark, two_series):
    """Every fifth week only: the test rows span far more than thirteen weeks."""
    sparse = two_series.where("datediff(week, date'2015-01-05') % 35 = 0").selectExpr(
        "nullif(Country, 'a') AS Country", "week", "revenue"
    )
    rows = forecasting.additive_predictions(sparse, by=["Country"]).collect()
    assert len(rows) == 26 and sum(r.Country is None for r in rows) == 13


def test_one_series_needs_no_key(two_series):
    one = two_series.where("Country = 'a'").drop("Country")
    rows = forecasting.additive_predictions(one).collect()
    assert len(rows) == 13 and {r.model for r in rows} == {forecasting.ADDITIVE}


def test_models_are_scored_on_the_same_weeks(spark):
    rows = [(1, 10.0, "Seasonal naive", None), (1, 10.0, "other", 5.0)]
    rows += [(2, 10.0, "Seasonal naive", 8.0), (2, 10.0, "other", 9.0)]
    rows = [(w, r, forecasting.NAIVE if m.startswith("Seasonal") else m, p) for w, r, m, p in rows]
    got = spark.createDataFrame(rows, "week int, revenue double, model string, prediction double")
    score = {r.model: r for r in forecasting.accuracy(got).collect()}
    assert score[forecasting.NAIVE].MAE == 2.0 and score["other"].MAE == 1.0
    assert score["other"]["MAE_vs_baseline_%"] == 50.0


def test_a_fit_that_does_not_settle_fails(monkeypatch):
    days = np.arange(0, 700, 7.0)
    monkeypatch.setattr(forecast, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        forecast.fit_predict(days, np.sin(days) + 2, days)


def test_a_line_is_found_without_seasons_and_slope_changes():
    days = np.arange(0, 700, 7.0)
    found = forecast.fit_predict(days, 3 + 2 * days, days, order=0, changepoints=0)
    assert np.allclose(found, 3 + 2 * days, rtol=1e-3, atol=1)


def lowest_by_trial(x, y, slopes, weight):
    """Every set of signs solved for itself; the lowest of those that keep their signs."""
    best, found = np.inf, None
    count = slopes.stop - slopes.start
    for signs in itertools.product((-1, 0, 1), repeat=count):
        pull = np.zeros(x.shape[1])
        pull[slopes] = signs
        used = np.ones(x.shape[1], bool)
        used[slopes] = np.array(signs) != 0
        theta = np.zeros(x.shape[1])
        theta[used] = np.linalg.solve(x[:, used].T @ x[:, used], x[:, used].T @ y - weight * pull[used])
        if (np.sign(theta[slopes]) != signs).any():
            continue
        value = ((x @ theta - y) ** 2).sum() / 2 + weight * np.abs(theta[slopes]).sum()
        if value < best:
            best, found = value, theta
    return found


def test_the_active_set_finds_the_minimum():
    rng = np.random.default_rng(6)
    slopes, kept = slice(2, 7), set()
    for trial in range(60):
        x = rng.normal(size=(30, 9)) @ (np.eye(9) + 0.8 * rng.normal(size=(9, 9)))
        truth = rng.normal(size=9) * (rng.random(9) < 0.6)
        y, weight = x @ truth + rng.normal(size=30), 10 ** rng.uniform(-1, 2.5)
        start = rng.normal(size=9) * (rng.random(9) < 0.5)
        theta = forecast.most_probable(x, y, slopes, weight, start)
        assert forecast.optimality_gap(x, y, slopes, weight, theta) < 1e-5
        assert np.allclose(theta, lowest_by_trial(x, y, slopes, weight), atol=1e-6)
        kept.add(int((theta[slopes] != 0).sum()))
    assert {0, 5} <= kept and len(kept) > 3


def test_the_conditions_tell_other_points_from_the_minimum():
    rng = np.random.default_rng(7)
    x, slopes = rng.normal(size=(40, 6)), slice(2, 5)
    y = x @ np.array([1, 2, 0, 3, -1, 0.5]) + rng.normal(size=40)
    theta = forecast.most_probable(x, y, slopes, 8.0, np.zeros(6))
    assert forecast.optimality_gap(x, y, slopes, 8.0, theta) < 1e-6
    for j in range(6):
        for step in (-0.01, 0.01):
            moved = theta + step * np.eye(6)[j]
            assert forecast.optimality_gap(x, y, slopes, 8.0, moved) > 1e-2


@pytest.mark.parametrize("weeks", [5, 30, 89, 104, 330])
def test_a_fit_takes_tens_of_rounds(weeks):
    rng = np.random.default_rng(weeks)
    days = 16440 + 7.0 * np.arange(weeks)
    for values in (
        np.abs(np.cumsum(rng.normal(0, 50, weeks)) + 500), signal(days) + rng.normal(0, 40, weeks),
        np.where(np.arange(weeks) < weeks // 2, days, 2 * days[0] - days) + rng.normal(0, 5, weeks),
    ):
        fit = forecast.fit_series(days, values)
        assert fit.rounds <= 40 and fit.gap <= forecast.OPTIMAL
        shuffled = rng.permutation(weeks)
        again = forecast.fit_series(days[shuffled], values[shuffled])
        assert np.allclose(again.theta, fit.theta)


def test_few_changes_of_slope_are_kept():
    """The prior wants most of them at exactly zero."""
    days = 7.0 * np.arange(150)
    truth = np.where(days < 500, 100 + days, 600 - 0.5 * (days - 500))
    rng = np.random.default_rng(3)
    fit = forecast.fit_series(days, truth + rng.normal(0, 10, 150))
    changes = fit.theta[2 : 2 + len(fit.knots)]
    assert 1 <= (changes != 0).sum() <= 6
    turn = np.abs(changes).argmax()
    assert abs(fit.knots[turn] * fit.span - 500) < 80


def test_a_fit_that_is_not_optimal_fails(monkeypatch):
    days = np.arange(0, 700, 7.0)
    monkeypatch.setattr(forecast, "optimality_gap", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="not optimal"):
        forecast.fit_series(days, np.sin(days) + 2)
    monkeypatch.setattr(forecast, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="no active set"):
        forecast.fit_series(days, np.sin(days) + 0.01 * np.abs(days - 300))


def test_rolling_origins_see_nothing_later(two_series):
    """Each origin scores as if its series had ended there."""
    by = ["Country", "origin"]
    rolled = forecasting.rolling_origins(two_series, 3, 20, ["Country"])
    found = forecasting.compare(rolled, by, strict=False)
    scores = {(r.Country, r.origin, r.model): r.MAE for r in forecasting.accuracy(found, by).collect()}
    assert len(scores) == 2 * 3 * 2
    for origin in range(3):
        for name, weeks in (("a", 160), ("b", 158)):
            rows = sorted(two_series.where(f"Country = '{name}'").collect(), key=lambda r: r.week)
            ended = two_series.sparkSession.createDataFrame(rows[: weeks - 20 * origin], two_series.schema)
            want = forecasting.accuracy(forecasting.compare(ended, ["Country"], strict=False), ["Country"])
            for r in want.collect():
                assert scores[name, origin, r.model] == pytest.approx(r.MAE)
    # Too short a series has no origin so early.
    assert forecasting.rolling_origins(two_series, 9, 20, ["Country"]).where("origin = 8").count() == 0
