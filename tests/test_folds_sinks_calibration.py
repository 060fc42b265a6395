"""Folds, fold statistics, pooled spans, calibrators, sinks and stream state against plain Python."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import by, calendar, close_bars, day
from tidemark import schemas, session
from tidemark.operators import direction, folds, models, montecarlo
from tidemark.plans import walk_forward
from tidemark.sources import sinks
from tidemark.streaming import positions

DATES = ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30", "2020-05-31", "2020-06-30", "2020-07-31", "2020-08-31", "2020-09-15",
         "2020-11-30"]


def _folds(dates, horizon, window, least):
    dates = [pd.Timestamp(d) for d in dates]
    out = {}
    for i, t in enumerate(dates):
        if i < least:
            continue
        own = dates[0 if window is None else max(0, i - window):i]
        if horizon > 1:
            own = [d for d in own if d + pd.DateOffset(months=horizon) <= t]
        if own:
            out[t.date()] = [d.date() for d in own]
    return out


@pytest.mark.parametrize("horizon,window,least", [(1, 12, 3), (1, None, 3), (3, 4, 3), (3, None, 1), (3, 2, 1), (2, 3, 0), (6, None, 3)])
def test_folds_like_a_loop_over_dates(spark, horizon, window, least):
    want = _folds(DATES, horizon, window, least)
    dates = calendar(spark, *random.Random(1).sample(DATES, len(DATES)))
    bounds = folds.fold_bounds(dates, horizon, window, least)
    got = by(bounds, "rebalance_date")
    assert {t: (d[0], d[-1], len(d)) for t, d in want.items()} == {
        t: (r["train_start"], r["train_end"], r["n_dates"]) for t, r in got.items()}
    pairs = {}
    for r in folds.members(bounds, dates).collect():
        pairs.setdefault(r["fold"], []).append(r["rebalance_date"])
    assert {t: sorted(d) for t, d in pairs.items()} == want


def _cells(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in DATES:
        for k in range(rng.randint(1, 30)):
            rows.append((dt.date.fromisoformat(d), f"T{k}", None if rng.random() < .3 else float(rng.randint(0, 5)),
                         None if d < "2020-03" or rng.random() < .1 else rng.gauss(1e6, 3), None, rng.choice([0, 1, 1, None])))
    return rows, spark.createDataFrame(rows, "rebalance_date date, ticker string, few double, many double, never double, label int")


@pytest.mark.parametrize("slices", [2, 128])
@pytest.mark.parametrize("horizon,window", [(1, 3), (3, None)])
def test_statistics_are_exact(spark, slices, horizon, window):
    rows, cells = _cells(spark)
    bounds = session.stage(folds.fold_bounds(cells, horizon, window, 1), "folds")
    got = by(folds.fold_statistics(cells, ["few", "many", "never"], bounds, slices), "rebalance_date", "feature")
    want = _folds(DATES, horizon, window, 1)
    assert {k[0] for k in got} == {t for t, own in want.items() if any(r[0] in own and r[5] is not None for r in rows)}
    for (t, feature), r in got.items():
        at = {"few": 2, "many": 3, "never": 4}[feature]
        values = [x[at] for x in rows if x[0] in want[t] and x[5] is not None]
        known = [v for v in values if v is not None]
        assert (r["n_rows"], r["n_known"]) == (len(values), len(known))
        if not known:
            assert r["median"] is None and r["mean"] is None and r["std"] is None
            continue
        median = statistics.median(known)
        filled = [median if v is None else v for v in values]
        assert r["median"] == median
        assert r["mean"] == pytest.approx(np.mean(filled), rel=1e-12) and r["std"] == pytest.approx(np.std(filled), rel=1e-6, abs=1e-9)


def test_one_training_set(spark):
    rows, cells = _cells(spark, 5)
    got = folds.column_medians(cells, ["few", "never"])
    assert got == {"few": statistics.median(r[2] for r in rows if r[2] is not None and r[5] is not None), "never": None}


def test_missing_values_are_the_training_median(spark):
    rows = [(dt.date(2020, 1, 1), f"T{k}", None if k % 5 == 0 else float(k), k % 2) for k in range(40)]
    train = spark.createDataFrame(rows, "rebalance_date date, ticker string, x double, label int")
    model = models.Ranker("logistic", {"maxIter": 20}).fit(train, ["x"])
    median = statistics.median(r[2] for r in rows if r[2] is not None)
    two = spark.createDataFrame([("a", None), ("b", median)], "ticker string, x double")
    scores = by(model.score(two), "ticker")
    assert scores["a"]["score"] == scores["b"]["score"] and 0 < scores["a"]["score"] < 1


def test_walk_forward_keeps_to_known_labels(spark):
    rng = random.Random(8)
    rows = [(dt.date.fromisoformat(d), f"T{k}", rng.random(), None if k == 3 else rng.random()) for d in DATES for k in range(12)]
    matrix = spark.createDataFrame(rows, "rebalance_date date, ticker string, mom_1m double, roe double")
    labels = matrix.select("rebalance_date", "ticker", (F.col("mom_1m") > 0.5).cast("int").alias("label"))
    got = walk_forward.walk_forward_scores(matrix, labels, "logistic", 2, 4, 3, {"maxIter": 10})
    assert {r["rebalance_date"] for r in got.select("rebalance_date").distinct().collect()} == set(_folds(DATES, 3, 4, 2))
    assert got.where("score is null").isEmpty()
    spans = by(walk_forward.training_spans(matrix, labels, 2, 4, 3), "rebalance_date")
    for t, own in _folds(DATES, 3, 4, 2).items():
        assert spans[t]["n_train"] == 12 * len(own)
        assert spans[t]["n_positive"] == sum(r[2] > 0.5 for r in rows if r[0] in own)


@pytest.mark.parametrize("years,horizon", [(1, 5), (3, 2)])
def test_pooled_spans_like_a_filter_per_date(spark, years, horizon):
    rng = random.Random(years)
    rows = []
    for ticker in "ABCDE":
        d = dt.date(2018, 1, 1) + dt.timedelta(rng.randint(0, 300))
        for _ in range(rng.randint(0, 200)):
            d += dt.timedelta(rng.choice([1, 1, 2, 3, 40, 500] if ticker == "A" else [1, 3, 9]))
            rows.append((ticker, d, None if rng.random() < .2 else 1.0, 2.0, rng.choice([0, 1, None])))
    panel = spark.createDataFrame(rows, "ticker string, date date, ret_1 double, ret_2 double, label int")
    dates = direction.sampled_dates(panel, 7)
    got = by(folds.pooled_spans(panel, dates, ["ret_1", "ret_2"], horizon, years), "date")
    assert len(got) == dates.count()
    for d, r in got.items():
        low, high = d - dt.timedelta(365 * years), d - dt.timedelta(folds.embargo_days(horizon))
        own = [x for x in rows if low <= x[1] <= high]
        train = [x for x in own if x[2] is not None and x[4] is not None]
        assert (r["train_start"], r["train_end"]) == (low, high)
        assert (r["n_rows"], r["n_incomplete"], r["n_unlabelled"], r["n_train"], r["n_positive"], r["n_tickers"]) == (
            len(own), sum(x[2] is None for x in own), sum(x[4] is None for x in own), len(train), sum(x[4] for x in train),
            len({x[0] for x in train}))


def test_spans_of_an_empty_panel(spark):
    panel = spark.createDataFrame([], "ticker string, date date, ret_1 double, label int")
    assert folds.pooled_spans(panel, direction.sampled_dates(panel), ["ret_1"]).count() == 0


# ---- calibration

def test_isotonic_is_the_max_min_of_means(spark):
    rng = random.Random(2)
    rows = [(k / 20, n := rng.randint(1, 9), rng.randint(0, n)) for k in range(20)]
    levels = spark.createDataFrame([(0, *r) for r in rows], "part int, score double, n long, ones long")
    got = by(models.calibrated_levels(levels, 1, "isotonic"), "score")
    mean = lambda a, b: sum(r[2] for r in rows[a:b + 1]) / sum(r[1] for r in rows[a:b + 1])
    for i, r in enumerate(rows):
        assert got[r[0]]["value"] == pytest.approx(max(min(mean(a, b) for b in range(i, 20)) for a in range(i + 1)), abs=1e-12)


def test_sigmoid_solves_its_score_equations(spark):
    rng = random.Random(4)
    rows = [(0, k / 30, 40, sum(rng.random() < 1 / (1 + math.exp(3 - 6 * k / 30)) for _ in range(40))) for k in range(30)]
    levels = spark.createDataFrame(rows, "part int, score double, n long, ones long")
    got = by(models.calibrated_levels(levels, 1, "sigmoid"), "score")
    off = [r[3] - r[2] * got[r[1]]["value"] for r in rows]
    assert abs(sum(off)) < 1e-2 and abs(sum(o * r[1] for o, r in zip(off, rows))) < 1e-2
    one = spark.createDataFrame([(0, .2, 5, 5), (0, .4, 5, 5)], "part int, score double, n long, ones long")
    assert {r["value"] for r in models.calibrated_levels(one, 1, "sigmoid").collect()} == {.2, .4}


def test_parts_do_not_depend_on_the_layout(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("ticker"), F.current_date().alias("date"))
    parts = [by(models.with_part(rows.repartition(n), ["date", "ticker"], 3), "ticker") for n in (1, 7)]
    assert {k: r["part"] for k, r in parts[0].items()} == {k: r["part"] for k, r in parts[1].items()}
    assert all(60 < sum(r["part"] == p for r in parts[0].values()) < 140 for p in range(3))


@pytest.mark.parametrize("real,place", [(0.1, -1), (0.25, 0), (0.75, 10), (1.0, 15), (1.25, 19), (2.0, 20), (None, None)])
def test_the_real_value_is_located(spark, real, place):
    draws = spark.createDataFrame([(0.25,), (0.26,), (1.25,), (None,), (0.7501,)], "auc double")
    got = by(montecarlo.located_histogram(draws, "auc", spark.createDataFrame([(real,)], "auc double")), "bin")
    assert sum(r["n"] for r in got.values()) == 4 and [b for b, r in got.items() if r["holds_real"]] == ([] if real is None else [place])
    plain = by(montecarlo.histogram(draws, "auc"), "bin")
    assert {b: r["n"] for b, r in got.items() if r["n"]} == {b: r["n"] for b, r in plain.items()}


# ---- sinks

def test_merged_bars_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    old = schemas.conform(close_bars(spark, {"A": range(1, 800), "B": range(1, 800)}), schemas.BARS)
    sinks.write_bars(old, path)
    late = old.where("ticker = 'A' and date >= DATE '2021-06-01'").withColumn("close", F.col("close") * 2)
    new = late.union(schemas.conform(close_bars(spark, {"C": [5, 6]}, dt.date(2021, 3, 1)), schemas.BARS).select(late.columns))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "bars" / "year=2020").iterdir()}
    for _ in range(2):
        sinks.merge_bars(new, path)
    got = by(sinks.read_bars(spark, path, old.schema), "ticker", "date")
    assert sinks.read_bars(spark, path, old.schema).count() == len(got) == old.count() + 2
    assert got["A", day(799 - 1)]["close"] == 2 * 799 and got["B", day(798)]["close"] == 799 and got["A", day(3)]["close"] == 4
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "bars" / "year=2020").iterdir()} == before  # not touched


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    write = sinks.batch_sink(str(tmp_path / "sink"))
    one, two = spark.range(5).toDF("a"), spark.range(5, 8).toDF("a")
    write(one, 0)
    write(two, 1)
    write(two.union(two.limit(0)), 1)
    assert sorted(r["a"] for r in sinks.read_batches(spark, str(tmp_path / "sink"), one.schema).collect()) == list(range(8))


# ---- stream state

def _run(spark, tmp_path, rows, **options):
    """Deliver ``rows`` as one more file and process what is new, from the checkpoint of the runs before."""
    schema = "ticker string, date date, score int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    (positions.held_positions(stream, **options).writeStream.format("parquet").trigger(availableNow=True)
     .option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out")).awaitTermination())
    return by(spark.read.parquet(str(tmp_path / "out")), "ticker", "date")


def test_state_outlives_a_restart_and_ends_when_idle(spark, tmp_path):
    got = _run(spark, tmp_path, [("A", day(0), 4), ("A", day(1), 0), ("B", day(0), 5), ("B", day(2), 0)], idle_days=100)
    assert {k: r["position"] for k, r in got.items()} == {("A", day(0)): 1, ("A", day(1)): 1, ("B", day(0)): 1, ("B", day(2)): 1}
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", positions.STATE).load()
    held = {r["key"]["ticker"]: tuple(r["value"]) for r in state.select("key", "value").collect()}
    assert held == {"A": (1, day(1)), "B": (1, day(2))}
    # a restart: late rows never change a position, new ones go on from the state
    got = _run(spark, tmp_path, [("A", day(0), -5), ("A", day(3), 1), ("B", day(4), -3)], idle_days=100)
    assert got["A", day(0)]["position"] == 1 and got["A", day(3)]["position"] == 1 and got["B", day(4)]["position"] == 0
    # A goes on, B is idle for longer than its state lives
    _run(spark, tmp_path, [("A", day(90), 0)], idle_days=100)
    _run(spark, tmp_path, [("A", day(180), 4)], idle_days=100)
    _run(spark, tmp_path, [("A", day(260), 0)], idle_days=100)
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", positions.STATE).load()
    assert {r["key"]["ticker"] for r in state.select("key").collect()} == {"A"}
    got = _run(spark, tmp_path, [("B", day(261), 0), ("A", day(261), 0)], idle_days=100)
    assert got["B", day(261)]["position"] == 0 and got["A", day(261)]["position"] == 1
