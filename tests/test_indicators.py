import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import by, close_bars, day, range_bars
from tidemark.functions import ewm
from tidemark.operators import indicators as ind


def test_moving_averages_and_returns(spark):
    bars = close_bars(spark, {"A": range(1, 251)})
    got = by(ind.add_returns(ind.add_moving_averages(bars)), "date")
    last = got[day(249)]
    assert last.sma20 == pytest.approx(240.5) and last.sma200 == pytest.approx(150.5)
    assert got[day(18)].sma20 is None and got[day(19)].sma20 == pytest.approx(10.5)
    assert got[day(0)].ret is None and got[day(10)].ret == pytest.approx(0.1)


def test_flat_series_has_zero_macd(spark):
    rows = ind.add_macd(close_bars(spark, {"A": [100.0] * 60})).collect()
    assert all(r.macd == 0.0 and r.macd_signal == 0.0 and r.macd_hist == 0.0 for r in rows)


def _pandas_adx(h, lo, c):
    e = lambda x: x.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    up, down = h.diff(), -lo.diff()
    p = 100 * e(up.where((up > down) & (up > 0), 0.0)) / e(tr)
    m = 100 * e(down.where((down > up) & (down > 0), 0.0)) / e(tr)
    return e(100 * (p - m).abs() / (p + m).replace(0.0, np.nan))


def test_macd_and_adx_match_the_recursion(spark):
    rng = np.random.default_rng(3)
    closes = (100 * np.exp(np.cumsum(rng.normal(0, .02, 1500)))).round(3)
    bars = range_bars(spark, {"A": closes.tolist()})
    got = ind.add_macd_adx(bars).toPandas().sort_values("date").reset_index(drop=True)
    c = pd.Series(closes)
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(got.macd, line, atol=1e-9)
    assert np.allclose(got.macd_signal, line.ewm(span=9, adjust=False).mean(), atol=1e-9)
    want = _pandas_adx(c + .5, c - .5, c)
    assert got.adx14.first_valid_index() == want.first_valid_index() == 26
    assert np.allclose(got.adx14[26:], want[26:], atol=1e-9)


def test_blocks_carry_over(spark):
    """Blocks far shorter than the history give the same means."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 400)
    df = close_bars(spark, {"A": x.tolist(), "B": (x * 2).tolist()})
    got = ewm.smooth(ewm.with_blocks(df, ewm.block_length([0.5])), [ewm.Ewm("y", "close", 0.5)])
    pdf = got.where("ticker = 'B'").toPandas().sort_values("date")
    assert ewm.block_length([0.5]) < 100
    assert np.allclose(pdf.y, pd.Series(x * 2).ewm(alpha=.5, adjust=False).mean(), atol=1e-12)


def test_adx_of_a_clean_trend(spark):
    last = by(ind.add_adx(range_bars(spark, {"A": range(50, 170)})), "date")[day(119)]
    assert 25 < last.adx14 <= 100 and last.plus_di > last.minus_di


def test_no_range_gives_no_adx(spark):
    assert ind.add_adx(close_bars(spark, {"A": range(1, 60)})).where("adx14 is not null").count() == 0
    assert "adx_14" not in ind.direction_features(close_bars(spark, {"A": range(1, 60)})).columns


def test_missing_close_is_refused(spark):
    with pytest.raises(ValueError):
        ind.add_macd(spark.createDataFrame([("A", 1)], "ticker string, x int"))


def test_cross_events(spark):
    up = [100 - 0.1 * i for i in range(260)] + [74 + 2.0 * i for i in range(80)]
    df = ind.add_cross_event(ind.add_moving_averages(close_bars(spark, {"A": up, "B": range(1, 101)})))
    kinds = {(r.ticker, r.cross_event) for r in df.select("ticker", "cross_event").distinct().collect()}
    assert ("A", "golden_cross") in kinds and ("A", "death_cross") not in kinds
    assert {k for t, k in kinds if t == "B"} == {"not_enough_data"}


def test_technicals_are_causal(spark):
    rng = np.random.default_rng(0)
    closes = (100 * np.exp(np.cumsum(rng.normal(0, .01, 300)))).round(3).tolist()
    base = ind.technical_frame(close_bars(spark, {"A": closes}))
    more = ind.technical_frame(close_bars(spark, {"A": closes + [10_000.0] * 30}))
    cut = F.col("date") <= F.lit(day(299))
    assert sorted(base.collect(), key=lambda r: r.date) == sorted(more.where(cut).collect(), key=lambda r: r.date)


def test_momentum_skips_a_month_and_volatility_needs_21_returns(spark):
    closes = [100 * 1.001 ** i for i in range(300)]
    got = by(ind.technical_frame(close_bars(spark, {"A": closes})), "date")
    assert got[day(252)].mom_12m == pytest.approx(1.001 ** 231 - 1) and got[day(251)].mom_12m is None
    assert got[day(20)].volatility is None and got[day(21)].volatility is not None
    assert got[day(0)].high_52w == 1.0


def test_direction_label_tail(spark):
    got = by(ind.direction_panel(close_bars(spark, {"A": [1, 2, 3, 2, 1, 5, 6]}), 2), "date")
    assert [got[day(i)].label for i in range(7)] == [1, 0, 0, 1, 1, None, None]
    with pytest.raises(ValueError):
        ind.direction_label(0)


def test_intraday_stats_and_quote(spark):
    import datetime as dt
    t0 = dt.datetime(2020, 1, 2, 14, 30)
    px = [100, 101, 99, 102]
    five = spark.createDataFrame([("A", t0 + dt.timedelta(minutes=5 * i), float(p)) for i, p in enumerate(px)],
                                 "ticker string, bar_start timestamp, close double")
    s = ind.intraday_stats(five).first()
    r = np.diff(px) / np.array(px[:-1])
    assert s.intraday_return_percent == pytest.approx(2.0)
    assert s.intraday_volatility_percent == pytest.approx(100 * r.std(ddof=1))
    q = ind.latest_quotes(five, close_bars(spark, {"A": [90, 100, 105]})).first()
    assert q.previous_close == 100 and q.change_percent == pytest.approx(2.0)
    only = ind.latest_quotes(five, close_bars(spark, {"A": [51]})).first()
    assert only.previous_close == 51 and math.isclose(only.change, 51)


def test_snapshot_basic_has_no_momentum_fields(spark):
    row = ind.latest_snapshot(range_bars(spark, {"A": range(1, 260)}), basic=True).first()
    assert row.macd_line is None and row.adx is None and row.sma_gap_percent is None and row.close_above_sma200
