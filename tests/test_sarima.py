"""Seasonal ARIMA against a plain recursion in numpy, with dummies for the routes' levels."""

from datetime import date, timedelta

import numpy as np
import pytest

from faretrace.fixtures import FIXTURE
from faretrace.models import sarima
from faretrace.operators.splits import Fold

START = date(2024, 1, 1)
FOLDS = [Fold(1, START, START + timedelta(59), START + timedelta(60), START + timedelta(69)),
         Fold(2, START, START + timedelta(69), START + timedelta(70), START + timedelta(79))]


def made_series():
    rng = np.random.default_rng(8)
    out = {}
    for r, level in (("A-B", 200.0), ("B-A", 320.0), ("C-D", 90.0)):
        e, y = rng.normal(0, 5, 80), np.zeros(80)
        for t in range(80):
            y[t] = level + (0.5 * (y[t - 1] - level) if t else 0) + (0.3 * (y[t - 7] - level) if t > 6 else 0) + e[t] + (0.6 * e[t - 1] if t else 0)
        out[r] = y
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(r, START + timedelta(t), float(v)) for r, y in made_series().items() for t, v in enumerate(y)]
    rows.append(("E-F", START + timedelta(3), 5.0))
    return spark.createDataFrame(rows, "route string, flightDate date, totalFare double").cache()


def plain(all_series, fold, order):
    routes = sorted(all_series)
    flags = {d: float(d in FIXTURE.holidays) for d in (START + timedelta(t) for t in range(80))}
    season = lambda d: float(FIXTURE.season_start <= d <= FIXTURE.season_end)
    weights = np.zeros(max((0, *np.cumsum(order.differences))) + 1)
    weights[0] = 1
    for d in order.differences:
        shifted = np.zeros_like(weights)
        shifted[d:] = weights[:len(weights) - d]
        weights = weights - shifted
    w = {r: np.array([np.nan if t < len(weights) - 1 else sum(c * y[t - k] for k, c in enumerate(weights)) for t in range(80)])
         for r, y in all_series.items()}
    n_train = (fold.train_end - START).days + 1

    def fit(lists):
        x, target, keys = [], [], []
        for i, r in enumerate(routes):
            for t in range(n_train):
                row = [lists(r, t)]
                if not np.isnan(row[0]).any() and not np.isnan(w[r][t]):
                    x.append([*row[0], *(float(i == j) for j in range(len(routes)))])
                    target.append(w[r][t])
        return np.linalg.lstsq(np.array(x), np.array(target), rcond=None)[0]

    day = lambda t: START + timedelta(t)
    regs = lambda t: [flags[day(t)], season(day(t))]
    lag = lambda a, t, k: a[t - k] if t >= k else np.nan
    first = lambda r, t: [*(lag(w[r], t, k) for k in range(1, order.first_stage + 1)), *regs(t)]
    b1 = fit(first)
    n1 = order.first_stage + 2
    e1 = {r: np.array([w[r][t] - np.dot(b1[:n1], first(r, t)) - b1[n1 + i] for t in range(80)]) for i, r in enumerate(routes)}
    second = lambda r, t: [*(lag(w[r], t, k) for k in order.ar), *(lag(e1[r], t, k) for k in order.ma), *regs(t)]
    b2 = fit(second)
    n2 = len(order.ar) + len(order.ma) + 2
    out = {}
    for i, r in enumerate(routes):
        e = np.zeros(80)
        for t in range(80):
            given = [*(lag(w[r], t, k) for k in order.ar), *(e[t - k] if t >= k else 0.0 for k in order.ma), *regs(t)]
            guess = np.dot(b2[:n2], given) + b2[n2 + i]
            e[t] = 0.0 if np.isnan(guess + w[r][t]) else w[r][t] - guess
            if fold.test_start <= day(t) <= fold.test_end:
                out[r, day(t)] = guess + all_series[r][t] - w[r][t]
    return out


@pytest.mark.parametrize("order", [sarima.Order(), sarima.Order(ar=(1,), ma=(1, 2), differences=(7,), first_stage=9)])
def test_equals_plain_recursion(frame, order):
    got = {(r.fold, r.route, r.flightDate): r.forecast for r in sarima.forecasts(frame, FOLDS, order, FIXTURE).collect()}
    want = {(f.index, *k): v for f in FOLDS for k, v in plain(made_series(), f, order).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-5), k


def test_recovers_the_terms_and_beats_the_mean(spark, frame):
    rows = sarima.forecasts(frame, FOLDS, sarima.Order(ar=(1, 7), ma=(1,)), FIXTURE).collect()
    truth = np.array([r.mean_fare for r in rows])
    level = {"A-B": 200.0, "B-A": 320.0, "C-D": 90.0}
    assert np.abs(truth - [r.forecast for r in rows]).mean() < 0.9 * np.abs(truth - [level[r.route] for r in rows]).mean()


def test_differences():
    assert sarima.difference_weights(()) == {0: 1.0}
    assert sarima.difference_weights((1, 7)) == {0: 1.0, 1: -1.0, 7: -1.0, 8: 1.0}
    assert sarima.difference_weights((1, 1)) == {0: 1.0, 1: -2.0, 2: 1.0}


def test_short_history_is_null(spark):
    rows = [("A-B", START + timedelta(t), float(t)) for t in (0, 1, 62)]
    short = spark.createDataFrame(rows, "route string, flightDate date, totalFare double")
    (row,) = sarima.forecasts(short, FOLDS[:1], sarima.Order(), FIXTURE).collect()
    assert row.forecast is None
