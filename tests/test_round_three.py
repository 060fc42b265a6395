"""Work per task and per pass on larger tables."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.conftest import by, close_bars
from tidemark import schemas
from tidemark.functions import draws
from tidemark.operators import indicators, logistic, montecarlo, ranks
from tidemark.plans import catalog
from tidemark.sources import market_views as views, ticker_files

START = dt.date(1995, 1, 2)


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    """40 suppliers with 50 line items each, and one without a supplier."""
    path = str(tmp_path_factory.mktemp("warehouse"))
    rows = [(i, i % 7, k if k < 40 else None, i % 3, float(1 + i % 5), 100.0 + i, 0.01 * ((i * 7 + k) % 11), 0.02,
             dt.datetime.combine(START + dt.timedelta(days=i), dt.time()))
            for k in range(41) for i in range(50)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_bars_are_dealt_by_the_number_of_rows(spark, warehouse):
    """A task's share of the bars stays the same however small their shuffled bytes are."""
    tasks = views.bar_tasks(spark, warehouse, task_rows=100)
    assert tasks == 21
    bars = views.bars(spark, warehouse, tasks)
    for df in (bars, indicators.direction_panel(bars), indicators.snapshots(bars), indicators.technical_frame(bars)):
        assert df.rdd.getNumPartitions() == tasks
    assert bars.where("ticker is not null").count() == 2000
    assert bars.where("ticker is null").count() == 50


def test_small_tables_take_few_tasks(spark, warehouse):
    assert views.bar_tasks(spark, warehouse) == 1
    assert views.bar_tasks(spark, warehouse, task_rows=5000) <= spark.sparkContext.defaultParallelism


def test_staged_bars_have_a_bucket_per_task(spark, warehouse, monkeypatch):
    monkeypatch.setattr(views, "bar_tasks", lambda *_: 21)
    market = catalog.Market(spark, warehouse)
    assert indicators.add_returns(market.bars).rdd.getNumPartitions() == 21
    want = catalog.tables.load_prices(views.bars(spark, warehouse, 3))
    assert sorted(map(repr, market.bars.collect())) == sorted(map(repr, want.collect()))


def test_repeated_deliveries_are_dealt_by_the_number_of_rows(spark, warehouse, monkeypatch):
    monkeypatch.setattr(views, "bar_tasks", lambda *_: 21)
    frame = catalog.REGISTRY["deduplicated_technical_frame"](spark, warehouse)
    assert frame.rdd.getNumPartitions() == 21


@pytest.fixture(scope="module")
def histories(spark, tmp_path_factory):
    """Seven tickers, one of them NULL, whose 220 days are enough for forecasts of each stock."""
    path = str(tmp_path_factory.mktemp("histories"))
    rows = [(k or None, float(1 + i % 5), 0.01 * ((i * i * 7 + k * i + i // 3) % 11), 0.02, dt.datetime.combine(START + dt.timedelta(days=i), dt.time()))
            for k in range(7) for i in range(220)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("query", ["direction_baseline", "direction_latest", "direction_panel", "per_stock_logistic"])
def test_what_reads_the_panel_keeps_its_tasks(spark, histories, monkeypatch, query):
    """A task holds the bars of so many line items from the panel to the result, and rows do not depend on their number."""
    results = []
    for tasks in (21, 2):
        monkeypatch.setattr(views, "bar_tasks", lambda *_, n=tasks: n)
        got = catalog.REGISTRY[query](spark, histories)
        assert got.rdd.getNumPartitions() == tasks
        results.append(sorted(map(repr, got.collect())))
    assert results[0] == results[1] and len({r.split("date")[0] for r in results[0]}) == 7


def test_draws_are_not_joined_row_by_row(spark):
    """Rows meet the cells looked at once a date, not once for every draw; labels of one class and missing ones included."""
    days = [START + dt.timedelta(days=31 * k) for k in range(3)]
    rows = [(d, f"T{i}", float(i % 17), None if i % 19 == 0 else (int(i % 3 == 0) if k else 1)) for k, d in enumerate(days) for i in range(200)]
    scored = spark.createDataFrame(rows, "rebalance_date date, ticker string, score double, label int")
    draws = montecarlo.permutation_draws(scored, 3, draws=5)
    joins = [line for line in draws._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins
    assert not [line for line in joins if "_cell#" in line]
    import hashlib
    known = [r for r in rows if r[3] is not None]
    got = {r["draw"]: r["mean_auc"] for r in draws.collect()}
    for draw in range(-1, 5):
        aucs = []
        for d in days:
            own = [r for r in known if r[0] == d]
            n1 = sum(r[3] for r in own)
            if not 0 < n1 < len(own):
                continue
            number = lambda r: int(hashlib.md5(f"0|{draw}|{d}|{r[1]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            ones = [r for r in own if r[3] == 1] if draw < 0 else sorted(own, key=number)[:n1]
            scores = [r[2] for r in own]
            rank = {v: sum(x < v for x in scores) + (scores.count(v) + 1) / 2 for v in set(scores)}
            aucs.append((sum(rank[r[2]] for r in ones) - n1 * (n1 + 1) / 2) / (n1 * (len(own) - n1)))
        assert got[draw] == pytest.approx(sum(aucs) / len(aucs), abs=1e-12)


def _folds(fills):
    """Three folds, the last two each without one of two parts."""
    first = logistic.day_numbers([START])[0]
    return logistic.Models(["a", "b", "c"], np.array([first, first + 3, first + 3]), np.array([first + 5, first + 11, first + 11]),
                           np.array([1, 2, 2]), np.array([-1, 0, 1]), np.tile(fills, (3, 1)))


def _fold_rows():
    """Twelve days; ``a`` has NULL and NaN, ``b`` has one value up to the sixth day, ``c`` is never known there."""
    rng = np.random.default_rng(5)
    return [(START + dt.timedelta(days=d), f"T{t}", [None, float("nan"), *rng.normal(3, 2, 10).tolist()][t], .1 if d < 6 else float(rng.normal()),
             None if d < 6 else float(t), int(rng.random() < .4)) for d in range(12) for t in range(12)]


def _terms(z, y, theta):
    """Loss, gradient and curvature of one model."""
    odds = z @ theta
    p = 1 / (1 + np.exp(-odds))
    return np.concatenate([[np.logaddexp(0, odds).sum() - (y * odds).sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def _own_rows(staged, models, m, held=False):
    """Rows of one model, filled, and their labels."""
    rows = [r for r in staged if models.start[m] <= r["_day"] <= models.stop[m]
            and (models.without[m] < 0 or (r["_draw"] % models.parts[m] == models.without[m]) == held)]
    x = np.array([[r[f] for f in "abc"] for r in rows], "float64")
    return np.where(np.isnan(x), models.fills[m], x), np.array([r["label"] for r in rows])


def test_moments_of_all_models_come_from_one_grouped_pass(spark):
    models = _folds([2.5, .1, 1.0])
    rows = logistic.training_rows(spark.createDataFrame(_fold_rows(), "date date, ticker string, a double, b double, c double, label int"), ["a", "b", "c"])
    moments, staged = logistic._Moments(rows, models), rows.collect()
    for m in range(3):
        x, y = _own_rows(staged, models, m)
        mean, std = moments.spread(m)
        assert moments.counts(m) == (len(y), y.sum())
        assert mean == pytest.approx(x.mean(axis=0), abs=1e-12) and std == pytest.approx(x.std(axis=0), abs=1e-12)
        if m:
            assert moments.counts(m, True) == (len(_own_rows(staged, models, m, True)[1]), _own_rows(staged, models, m, True)[1].sum())
    assert (moments.spread(0)[1][1:] <= 1e-12).all()  # no spread: no part in the model


def test_a_step_of_all_models_is_one_product_of_shared_columns(spark):
    models = _folds([2.5, .1, 1.0])
    rows = logistic.training_rows(spark.createDataFrame(_fold_rows(), "date date, ticker string, a double, b double, c double, label int"), ["a", "b", "c"])
    rng = np.random.default_rng(1)
    theta, mean, scale = rng.normal(size=(3, 4)), rng.normal(size=(3, 3)), rng.uniform(.5, 2, (3, 3))
    scale[0, 2] = 0
    got = logistic._sums(rows, models, [0, 1, 2], False, logistic._linear_terms(theta, mean, scale, models.fills))
    staged = rows.collect()
    for m in range(3):
        x, y = _own_rows(staged, models, m)
        z = np.column_stack([np.ones(len(y)), (x - mean[m]) * scale[m]])
        assert got[m] == pytest.approx(_terms(z, y, theta[m]), rel=1e-10, abs=1e-10)


def test_passes_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """A larger table gets more tasks, each of few days."""
    monkeypatch.setattr(logistic, "TASK_ROWS", 4)
    rows = logistic.training_rows(spark.createDataFrame(_fold_rows(), "date date, ticker string, a double, b double, c double, label int"), ["a", "b", "c"])
    assert rows.inputFiles() and len(rows.inputFiles()) > 16


def test_ranks_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """A task's share of the ranked rows does not follow from their shuffled bytes; ranks are those of a plain sort."""
    monkeypatch.setattr(ranks, "TASK_ROWS", 50)
    rows = [(i % 3 or None, f"T{i}", None if i % 41 == 0 else float("nan") if i % 97 == 5 else float(i * 37 % 101) if i % 5 else -0.0) for i in range(600)]
    frame = spark.createDataFrame(rows, "g int, k string, v double")
    for slices in (1, 2, 7, 64):
        got = ranks.ranked(frame, ["g"], "v", ["k"], one_in=2, slices=slices)
        known = [r for r in rows if r[2] is not None]
        assert got.rdd.getNumPartitions() == -(-len(known) // 50)
        order = lambda v: (v != v, v if v == v else 0.0)
        for r in got.collect():
            group = [order(x[2]) for x in known if x[0] == r["g"]]
            assert (r["n"], r["below"], r["ties"]) == (len(group), sum(x < order(r["v"]) for x in group), group.count(order(r["v"])))


def test_slices_are_found_without_a_comparison_per_cut_point(spark):
    cuts = spark.createDataFrame([([1.0, 2.0, 4.0], v) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)] + [(None, 1.0)], "_cuts array<double>, v double")
    sliced = ranks._with_slice(cuts, "v", 5)
    assert "lambda" not in sliced._jdf.queryExecution().optimizedPlan().toString()
    assert [r["_slice"] for r in sliced.collect()] == [0, 1, 2, 3, 4, 5, 6, 0]


def test_ticker_files_are_put_in_their_place_by_the_tasks(spark, tmp_path):
    """No file waits for the driver to move it, all of a ticker's rows share one, and bars dealt by ticker are not shuffled again."""
    names = [None, "", "A", "B/C D", "é=%"]
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40) for t in names]
    bars = schemas.conform(spark.createDataFrame(rows, "ticker string, date date, close double"), schemas.BARS)
    path = str(tmp_path / "files")
    ticker_files.write_ticker_files(bars.repartition(3, "ticker"), path, dealt=True)
    found = sorted(str(p.relative_to(path)) for p in (tmp_path / "files").rglob("*") if p.is_file())
    folders = {"ticker=A": 1, "ticker=B%2FC D": 1, "ticker=__HIVE_DEFAULT_PARTITION__": 2, "ticker=é%3D%25": 1}
    held = [f.split("/bars-")[0] for f in found if f != "_SUCCESS"]  # NULL and the empty string may lie in two tasks
    assert {f: held.count(f) for f in held}.keys() == folders.keys() and all(held.count(f) <= n for f, n in folders.items())
    got = by(ticker_files.price_rows(spark, path).groupBy("ticker").count(), "ticker")
    assert {k: v["count"] for k, v in got.items()} == {"A": 40, "B/C D": 40, "É=%": 40, "__HIVE_DEFAULT_PARTITION__": 80}
    with pytest.raises(Exception, match="is there already"):
        ticker_files.write_ticker_files(bars, path)
    assert sorted(str(p.relative_to(path)) for p in (tmp_path / "files").rglob("*") if p.is_file()) == found


def test_cells_are_found_from_digests(spark):
    """The first bits from a cell's start up to the next one's are those whose number falls into the cell, at any number of cells."""
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("d"), (1 + F.col("id") % 97 * (F.col("id") % 5) * 7919).alias("cells"))
    number = draws.digest_number("d")
    old = F.shiftright(F.shiftright(number, draws.BITS - 31) * F.col("cells"), 31)
    got = df.select("d", (montecarlo._cell_of("d", "cells") == old).alias("same"), "cells", old.alias("cell")).select(
        "same", "cell", montecarlo._first_bits("d").alias("bits"),
        montecarlo._cell_start("cell", "cells").alias("a"), montecarlo._cell_start("cell + 1", "cells").alias("b")).collect()
    assert all(r.same and r.a <= r.bits < r.b for r in got) and len({r.cell for r in got}) > 1000


def test_a_second_draw_is_digested_once(spark):
    """Rows outside the cell looked at have their digest made once, not for each side of a comparison, and no whole number read."""
    scored = spark.range(400).select(F.lit("2020-01-31").cast("date").alias("rebalance_date"), F.col("id").cast("string").alias("ticker"),
                                     (F.col("id") * 7 % 400).cast("double").alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    plan = montecarlo.permutation_draws(scored, 3, draws=5)._jdf.queryExecution().optimizedPlan().toString()
    wanted = [line for line in plan.split("\n") if "Filter" in line and "_from" in line and "md5(" in line]
    assert wanted and all(line.count("md5(") == 1 and ", 1, 15)" not in line for line in wanted)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 21, 252])
def test_trailing_maximum_in_steps(spark, n):
    bars = close_bars(spark, {t: [(i * k * 37) % 101 for i in range(300)] for t, k in (("A", 1), ("B", 5))})
    bars = bars.withColumn("close", F.when(F.col("close") % 3 != 0, F.col("close")))
    got = indicators.with_trailing_max(bars, "close", n, "high").withColumn("slid", F.max("close").over(indicators._trailing(n)))
    assert got.where("not high <=> slid").count() == 0 and got.columns[:3] == bars.columns


def test_the_high_of_a_year_needs_no_sliding_frame(spark):
    bars = close_bars(spark, {"A": [1, 2, 3]})
    plan = indicators.technical_frame(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(close" not in plan
