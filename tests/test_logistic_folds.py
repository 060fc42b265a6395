"""Logistic models of all folds at once against plain Newton steps per fold, and against models fitted one by one."""

import datetime

import numpy as np
import pytest

from tidemark.operators import direction, logistic
from tidemark.plans import walk_forward

START = datetime.date(2000, 1, 1)


def day(i):
    return START + datetime.timedelta(days=int(i))


def plain(x, y):
    """Ridge logistic regression on scaled features by plain gradient steps with a line search: raw coefficients, intercept."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    scale = np.where(std > 1e-12, 1 / np.where(std > 1e-12, std, 1), 0)
    z = (x - mean) * scale
    w, b = np.zeros(z.shape[1]), 0.0
    rate = 1 / (len(y) * (z.shape[1] + 1) / 4 + 1)
    for _ in range(20_000):
        r = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * (z.T @ r + w), b - rate * r.sum()
    return w * scale, b - (w * scale * mean).sum()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for d in range(40):
        for t in range(12):
            a, b, c = rng.normal(5, 2), rng.normal(), 7.0
            label = None if rng.random() < .1 else int(rng.random() < 1 / (1 + np.exp(-(a - 5 + .5 * b))))
            gap = rng.random() < .1
            out.append((day(d), f"T{t}", float(a), None if gap else float(b), c, label if d < 30 else (None if label is None else 1)))
    return out


SCHEMA = "date date, ticker string, a double, b double, c double, label int"


def models_of(spans, parts=1, without=-1, fills=(0.0, 0.25, 0.0)):
    n = len(spans)
    return logistic.Models(["a", "b", "c"], logistic.day_numbers([day(s) for s, _ in spans]), logistic.day_numbers([day(e) for _, e in spans]),
                           np.full(n, parts), np.full(n, without), np.tile(fills, (n, 1)))


@pytest.mark.parametrize("partitions", [1, 5])
def test_folds_match_plain_descent(spark, rows, partitions):
    spans = [(0, 9), (3, 25), (30, 39), (0, 39), (200, 210)]
    trained = logistic.training_rows(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], partitions=partitions)
    got = logistic.fit(trained, models_of(spans))
    for i, (s, e) in enumerate(spans[:2] + [spans[3]]):
        m = spans.index((s, e))
        own = [r for r in rows if day(s) <= r[0] <= day(e) and r[5] is not None]
        x = np.array([[r[2], .25 if r[3] is None else r[3], r[4]] for r in own])
        w, b = plain(x, np.array([r[5] for r in own], float))
        assert got.coefficients[m] == pytest.approx(w, abs=1e-5) and got.intercept[m] == pytest.approx(b, abs=1e-5)
        assert got.coefficients[m][2] == 0.0
    assert got.intercept[2] == logistic.SURE and not got.coefficients[2].any()  # one class
    assert got.intercept[4] == -logistic.SURE  # no rows
    assert len(logistic.fit(trained, models_of([])).intercept) == 0


def test_parts_left_out_and_their_curves(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    trained = logistic.training_rows(frame, ["a", "b", "c"])
    part = {(r["_day"], r["a"]): r["_draw"] % 3 for r in trained.collect()}
    fitted = logistic.fit(trained, models_of([(0, 29)], 3, 1))
    own = [(r, part[(int(logistic.day_numbers([r[0]])[0]), r[2])]) for r in rows if r[0] <= day(29) and r[5] is not None]
    x = np.array([[r[2], .25 if r[3] is None else r[3], r[4]] for r, _ in own])
    y, p = np.array([r[5] for r, _ in own], float), np.array([q for _, q in own])
    w, b = plain(x[p != 1], y[p != 1])
    assert fitted.coefficients[0] == pytest.approx(w, abs=1e-5)
    (inter, slope), = logistic.fit_curves(trained, fitted)
    s = 1 / (1 + np.exp(-(x[p == 1] @ w + b)))
    value = 1 / (1 + np.exp(-(inter + slope * s)))
    # The score equations of an unpenalised curve.
    assert (value - y[p == 1]).sum() == pytest.approx(0, abs=1e-4) and ((value - y[p == 1]) * s).sum() == pytest.approx(0, abs=1e-4)
    got = {(r["date"], r["ticker"]): r["score"] for r in logistic.score(frame, [day(35)], fitted, "date", np.array([[inter, slope]])).collect()}
    assert len(got) == 12
    for r in rows:
        if r[0] == day(35):
            base = 1 / (1 + np.exp(-(np.array([r[2], .25 if r[3] is None else r[3], r[4]]) @ w + b)))
            assert got[(r[0], r[1])] == pytest.approx(1 / (1 + np.exp(-(inter + slope * base))), abs=1e-5)


def test_walk_forward_agrees_with_one_model_a_fold(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("date", "rebalance_date")
    matrix, labels = frame.drop("label"), frame.select("rebalance_date", "ticker", "label")
    together = walk_forward.walk_forward_scores(matrix, labels, "logistic", 25, 12).toPandas()
    one_by_one = walk_forward.walk_forward_scores(matrix, labels, "logistic", 25, 12, options={"maxIter": 300, "tol": 1e-10}).toPandas()
    both = together.merge(one_by_one, on=["rebalance_date", "ticker"])
    assert len(both) == len(together) == len(one_by_one) == 15 * 12
    # The single models scale by the sample deviation.
    assert (both["score_x"] - both["score_y"]).abs().max() < 2e-3
    empty = walk_forward.walk_forward_scores(matrix, labels, "logistic", 100)
    assert empty.columns == ["rebalance_date", "ticker", "score"] and empty.count() == 0


def test_pooled_dates_agree_with_one_model_a_date(spark):
    rng = np.random.default_rng(5)
    table = []
    for t in range(5):
        for d in range(200):
            x = rng.normal(size=2)
            table.append((f"S{t}", day(d), int(rng.random() < 1 / (1 + np.exp(-2 * x[0]))), float(x[0]), float(x[1])))
    panel = spark.createDataFrame(table, "ticker string, date date, label int, ret_1 double, mom_10 double")
    names = direction.feature_names(panel)
    assert len(names) == 2
    for calibrate in (True, False):
        a = direction.pooled_walk_forward(panel, step=60, min_train=100, calibrate=calibrate).toPandas()
        b = direction.pooled_walk_forward(panel, step=60, min_train=100, calibrate=calibrate, options={"maxIter": 300, "tol": 1e-10}).toPandas()
        both = a.merge(b, on=["ticker", "date"])
        assert len(both) == len(a) == len(b) > 0
        assert (both["prob_up_x"] - both["prob_up_y"]).abs().max() < 2e-3 and (both["actual_x"] == both["actual_y"]).all()
