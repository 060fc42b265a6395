"""The ablation fits both variants in the same passes over the same cells, and its report realises returns once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import by, day
from tidemark import session
from tidemark.operators import asof, evaluation, folds
from tidemark.plans import books, walk_forward

FEATURES = ["a", "b", "mood"]


@pytest.fixture(scope="module")
def panel(spark):
    """Eight dates, 30 tickers; one feature has gaps, one is missing on the first dates, one has ties."""
    rng = np.random.default_rng(4)
    rows = []
    for d in range(8):
        for t in range(30):
            a, b, mood = rng.normal(), float(rng.integers(0, 4)), rng.normal()
            label = int(rng.random() < 1 / (1 + np.exp(-(a + mood))))
            rows.append((day(31 * d), f"T{t}", a if rng.random() > .2 else None, b, mood if d > 1 and rng.random() > .4 else None,
                         label if rng.random() > .1 else None))
    full = session.stage(spark.createDataFrame(rows, "rebalance_date date, ticker string, a double, b double, mood double, label int"), "panel")
    return full.drop("label"), session.stage(full.where("label is not null").select("rebalance_date", "ticker", "label"), "labels")


def _ablation(matrix, labels, **both):
    return books.ablation(matrix, "mood", lambda m: walk_forward.walk_forward_scores(m, labels), **both)


def _same(got, want):
    got, want = (by(x, "variant", "rebalance_date", "ticker") for x in (got, want))
    assert got.keys() == want.keys() and len(got) == 2 * 5 * 30
    for k, r in got.items():
        assert r.score == pytest.approx(want[k].score, abs=1e-9)


def test_both_variants_are_fitted_together(panel, monkeypatch):
    matrix, labels = panel
    want = session.stage(_ablation(matrix, labels), "want")
    names, real = [], session.stage
    monkeypatch.setattr(session, "stage", lambda df, name, *a, **k: names.append(name) or real(df, name, *a, **k))
    got = _ablation(matrix, labels, both=lambda m: walk_forward.ablated_scores(m, labels, "mood"))
    _same(got, want)
    assert names.count("cells") == 1 and names.count("logistic-rows") == 1
    assert "value-counts" not in names  # medians need no table of all values


def test_the_registered_ablation_makes_its_cells_once(spark, monkeypatch):
    from tests.conftest import SF
    from tidemark.plans.catalog import REGISTRY
    names, real = [], session.stage
    monkeypatch.setattr(session, "stage", lambda df, name, *a, **k: names.append(name) or real(df, name, *a, **k))
    got = REGISTRY["sentiment_ablation"](spark, SF)
    assert names.count("cells") == 1 and names.count("logistic-rows") == 1
    assert {r[0] for r in got.select("variant").distinct().collect()} == {"with_sentiment", "without_sentiment"}


@pytest.mark.parametrize("one_in", [1, 3, 10 ** 9])
def test_medians_alone_are_those_of_the_statistics(panel, one_in):
    """Whatever cut points the sample gives, none among them."""
    matrix, labels = panel
    cells = session.stage(matrix.join(labels, ["rebalance_date", "ticker"], "left"), "cells")
    bounds = session.stage(folds.fold_bounds(cells, train_window=3), "folds")
    want = {(r.rebalance_date, r.feature): r.median for r in folds.fold_statistics(cells, FEATURES, bounds).collect() if r.median is not None}
    got = {(r.rebalance_date, r.feature): r.median for r in folds.fold_medians(cells, FEATURES, bounds, 8, one_in).collect()}
    assert got == want and len(got) >= 13


def test_paired_reports_realise_returns_once(spark, monkeypatch):
    dates = [day(0), day(31), day(62), day(93)]
    rng = np.random.default_rng(5)
    bars = spark.createDataFrame([(f"T{t}", day(i), float(100 + t + rng.integers(0, 9))) for t in range(6) for i in range(100)],
                                 "ticker string, date date, close double")
    scores = spark.createDataFrame([(d, f"T{t}", float(rng.normal()), v) for d in dates for t in range(6) for v in ("with_x", "without_x")],
                                   "rebalance_date date, ticker string, score double, variant string")
    labels = spark.createDataFrame([(d, f"T{t}", t % 2) for d in dates for t in range(6)], "rebalance_date date, ticker string, label int")
    config = books.SelectionConfig(top_n=2, market="T0")
    want = {side: by(books.report_table(books.selection_report(scores.where(f"variant = '{side}_x'").drop("variant"), labels, bars, config)),
                     "section", "key", "metric") for side in ("with", "without")}
    calls, real = [], asof.period_returns
    monkeypatch.setattr(asof, "period_returns", lambda *a, **k: calls.append(a) or real(*a, **k))
    got = by(books.paired_reports(scores, "x", labels, bars, config), "section", "key", "metric")
    assert len(calls) == 1
    for k, r in got.items():
        for side in want:
            assert r[f"{side}_value"] == pytest.approx(want[side][k].value, abs=1e-12) if want[side][k].value is not None else r[f"{side}_value"] is None
    # Other dates in one variant: each has periods of its own.
    calls.clear()
    less = scores.where(F.col("rebalance_date").isin(dates[:3]) | (F.col("variant") == "with_x"))
    got = by(books.paired_reports(less, "x", labels, bars, config), "section", "key", "metric")
    assert len(calls) == 4 and evaluation.holding_periods(less).count() == 3
    assert got["metrics", "strategy", "cumulative_return"].with_value == pytest.approx(
        want["with"]["metrics", "strategy", "cumulative_return"].value, abs=1e-12)
