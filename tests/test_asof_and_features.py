import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, calendar, close_bars, day
from tidemark import schemas
from tidemark.operators import asof, features, fundamentals as fund

D = dt.date.fromisoformat


def test_asof_modes(spark):
    bars = spark.createDataFrame([("A", D("2020-01-10"), 1.0), ("A", D("2020-01-31"), 2.0), ("A", D("2020-04-15"), 3.0)],
                                 "ticker string, date date, close double")
    cal = calendar(spark, "2020-01-09", "2020-01-31", "2020-02-29", "2020-04-15", "2020-04-30")
    last = by(asof.on_calendar(asof.with_next(bars), cal), "rebalance_date")
    assert {k: v.close for k, v in last.items()} == {
        D("2020-01-31"): 2.0, D("2020-02-29"): 2.0, D("2020-04-15"): 3.0, D("2020-04-30"): 3.0}
    lag0 = by(asof.price_at(bars, cal, 0), "rebalance_date")
    assert {k: v.price for k, v in lag0.items()} == {D("2020-01-31"): 2.0, D("2020-02-29"): 2.0, D("2020-04-15"): 3.0}
    lag1 = by(asof.price_at(bars, cal, 1), "rebalance_date")
    assert {k: v.price for k, v in lag1.items()} == {D("2020-01-31"): 3.0, D("2020-02-29"): 3.0}


def test_filings_are_used_from_their_available_date(spark):
    rows = [("A", D("2019-12-31"), D("2020-03-01"), .10), ("A", D("2020-06-30"), D("2020-09-01"), .20)]
    f = spark.createDataFrame(rows, "ticker string, period_end date, available_date date, roe double")
    f = schemas.conform(f, schemas.FUNDAMENTALS)
    bars = close_bars(spark, {"A": [120.0] * 400})
    cal = calendar(spark, "2020-02-15", "2020-03-15", "2020-08-31", "2020-09-01")
    got = by(features.feature_matrix(bars, f, cal), "rebalance_date")
    assert [got[D(d)].roe for d in ("2020-02-15", "2020-03-15", "2020-08-31", "2020-09-01")] == [None, .10, .10, .20]


def test_flat_series_valuation(spark):
    rows = [("A", dt.date(2019, m, 28), "quarterly", 10.0, 100.0, 200.0, 100.0, 1000.0) for m in (3, 6, 9, 12)]
    tidy = fund.tidy(spark.createDataFrame(rows, schemas.STATEMENTS))
    got = features.feature_matrix(close_bars(spark, {"A": [120.0] * 200}), tidy, calendar(spark, "2020-06-30")).first()
    assert got.pe == pytest.approx(3000) and got.pb == pytest.approx(600) and got.roe == pytest.approx(.2)


def test_no_leakage_into_the_matrix(spark):
    closes = [100 + (i % 7) for i in range(75)]
    f = schemas.conform(spark.createDataFrame(
        [("A", D("2019-12-31"), D("2020-02-01"), .1)],
        "ticker string, period_end date, available_date date, roe double"), schemas.FUNDAMENTALS)
    late = schemas.conform(spark.createDataFrame(
        [("A", D("2019-12-31"), D("2020-02-01"), .1), ("A", D("2020-03-31"), D("2020-05-30"), .9)],
        "ticker string, period_end date, available_date date, roe double"), schemas.FUNDAMENTALS)
    cal = calendar(spark, "2020-02-10", "2020-03-15")
    one = features.feature_matrix(close_bars(spark, {"A": closes}), f, cal)
    two = features.feature_matrix(close_bars(spark, {"A": closes + [10_000.0] * 30}), late, cal)
    key = lambda r: r.rebalance_date
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)


def _toy(spark):
    rows = [("2020-01-31", "A", 1.0), ("2020-01-31", "B", 2.0), ("2020-01-31", "C", 3.0), ("2020-01-31", "D", None),
            ("2020-02-29", "A", 10.0), ("2020-02-29", "B", 20.0), ("2020-02-29", "C", 30.0)]
    return spark.createDataFrame(rows, "rebalance_date string, ticker string, mom_1m double").withColumn(
        "rebalance_date", F.col("rebalance_date").cast("date"))


def test_rank_and_zscore_inside_each_date(spark):
    r = by(features.normalise(_toy(spark)), "rebalance_date", "ticker")
    assert r[D("2020-01-31"), "A"].mom_1m == pytest.approx(1 / 3 - .5)
    assert r[D("2020-01-31"), "C"].mom_1m == pytest.approx(.5) and r[D("2020-01-31"), "D"].mom_1m is None
    z = by(features.normalise(_toy(spark), "zscore"), "rebalance_date", "ticker")
    assert z[D("2020-02-29"), "C"].mom_1m == pytest.approx(1.0) and z[D("2020-02-29"), "B"].mom_1m == pytest.approx(0)
    alone = by(features.normalise(_toy(spark).where("rebalance_date = '2020-01-31'")), "rebalance_date", "ticker")
    assert all(alone[k] == r[k] for k in alone)
    with pytest.raises(ValueError):
        features.normalise(_toy(spark), "minmax")


def test_sector_neutral_rank_and_unknown_bucket(spark):
    m = spark.createDataFrame([(D("2020-01-31"), t, v) for t, v in zip("ABCDEF", (1., 2., 10., 20., 5., 6.))],
                              "rebalance_date date, ticker string, x double")
    s = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "Y"), ("D", "Y")], schemas.SECTORS)
    got = by(features.normalise(m, sectors=s), "ticker")
    assert {t: got[t].x for t in "ABCDEF"} == {"A": 0., "B": .5, "C": 0., "D": .5, "E": 0., "F": .5}


def test_labels_beat_the_median_strictly(spark):
    step = lambda a, b: [a] * 40 + [b] * 40
    bars = close_bars(spark, {"A": step(100, 150), "B": step(100, 110), "C": step(100, 80)})
    ret = features.forward_returns(bars, calendar(spark, "2020-01-31"))
    assert {t: r.label for t, r in by(features.relative_labels(ret), "ticker").items()} == {"A": 1, "B": 0, "C": 0}
    with pytest.raises(ValueError):
        features.relative_labels(ret, "mode")


def test_mean_label_is_a_higher_bar_than_the_median(spark):
    bars = close_bars(spark, {t: [100 * (1 + g) ** i for i in range(90)]
                              for t, g in zip("ABCD", (.0005, .001, .002, .010))})
    ret = features.forward_returns(bars, calendar(spark, "2020-01-31"))
    count = lambda b: features.relative_labels(ret, b).agg(F.sum("label")).first()[0]
    assert count("median") == 2 and count("mean") == 1


def test_execution_lag_avoids_a_one_day_spike(spark):
    bars = close_bars(spark, {"A": [100] * 20 + [1000] + [100] * 9 + [130] * 40})
    cal = calendar(spark, str(day(20)))
    assert features.forward_returns(bars, cal, lag=0).first().fwd_ret == pytest.approx(130 / 1000 - 1)
    assert features.forward_returns(bars, cal, lag=1).first().fwd_ret == pytest.approx(.30)


def test_incomplete_forward_windows_are_dropped(spark):
    bars = close_bars(spark, {"A": [100] * 45})
    assert features.forward_returns(bars, calendar(spark, "2020-01-31")).count() == 0
    assert features.forward_returns(bars, calendar(spark, "2019-12-31")).count() == 0


def test_calendar_counts_live_names(spark):
    early = {f"T{i}": [1.0] * 200 for i in range(3)}
    bars = close_bars(spark, early).unionByName(close_bars(spark, {"L": [1.0] * 30}, dt.date(2020, 5, 15)))
    all4 = [r[0] for r in features.rebalance_calendar(bars, 4).orderBy("rebalance_date").collect()]
    any3 = [r[0] for r in features.rebalance_calendar(bars, 3).orderBy("rebalance_date").collect()]
    assert all4 == [D("2020-05-31")] and any3[0] == D("2020-01-31") and any3[-1] == D("2020-06-30")


def test_statement_ratios_and_lag(spark):
    q = [("A", dt.date(2023, 3, 31), 10.), ("A", dt.date(2023, 6, 30), 10.), ("A", dt.date(2023, 9, 30), 10.),
         ("A", dt.date(2023, 12, 31), 10.), ("A", dt.date(2024, 3, 31), 20.)]
    raw = spark.createDataFrame([(t, d, n, 100., 200., 100., 1000.) for t, d, n in q],
                                "ticker string, period_end date, net_income double, total_revenue double, "
                                "total_equity double, total_debt double, shares_outstanding double")
    got = by(fund.tidy(raw), "period_end")
    assert got[D("2023-09-30")].roe is None and got[D("2023-12-31")].roe == pytest.approx(.2)
    last = got[D("2024-03-31")]
    assert last.earnings_growth_yoy == pytest.approx(1.0) and last.net_margin == pytest.approx(.2)
    assert last.debt_to_equity == pytest.approx(.5) and last.available_date == D("2024-05-30")


def test_annual_rows_extend_history_and_quarterly_wins(spark):
    rows = [("A", dt.date(y, 12, 31), "annual", n) for y, n in ((2021, 20.), (2022, 40.), (2023, 40.), (2024, 40.))]
    rows += [("A", dt.date(2024, m, d), "quarterly", 10.) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    raw = spark.createDataFrame(rows, "ticker string, period_end date, freq string, net_income double")
    got = by(fund.tidy(raw.withColumn("total_equity", F.lit(0.0))), "period_end")
    assert len(got) == 7 and got[D("2022-12-31")].earnings_growth_yoy == pytest.approx(1.0)
    assert got[D("2024-12-31")].net_income == 10 and got[D("2024-12-31")].ttm_net_income == 40
    assert all(r.roe is None for r in got.values())


def test_text_numbers_become_null(spark):
    raw = spark.createDataFrame([("A", dt.date(2024, 3, 31), "n/a")], "ticker string, period_end date, net_income string")
    assert fund.coerced(raw).first().net_income is None


def test_label_choice_in_statements(spark):
    d = dt.date(2024, 3, 31)
    items = spark.createDataFrame([
        ("A", d, "quarterly", "Net Income Common Stockholders", 9.), ("A", d, "quarterly", "Net Income", 10.),
        ("A", d, "quarterly", "Net Debt", 5.), ("B", d, "quarterly", "Total Revenue", 7.)], schemas.STATEMENT_ITEMS)
    got = by(fund.pick_items(items), "ticker")
    assert set(got) == {"A"} and got["A"].net_income == 10 and got["A"].total_debt == 5 and got["A"].total_equity is None


def test_ttm_fallback_only_where_missing(spark):
    rows = [("A", day(90 * i), 10.0, None if i else 77.0) for i in range(5)]
    f = spark.createDataFrame(rows, "ticker string, period_end date, net_income double, ttm_net_income double")
    got = by(fund.with_ttm(f), "period_end")
    assert [got[day(90 * i)].ttm_net_income for i in range(5)] == [77, None, None, 40, 40]
