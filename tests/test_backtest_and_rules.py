import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, close_bars, day, range_bars
from tidemark import session
from tidemark.operators import backtest, indicators, metrics, rules


def _returns(spark, values, group="A"):
    return spark.createDataFrame([(group, day(i), float(v)) for i, v in enumerate(values)],
                                 "g string, date date, ret double")


def test_metrics_by_hand(spark):
    m = lambda v: metrics.metric_bundle(_returns(spark, v), ["g"], "date").first()
    assert m([.10, .10]).cumulative_return == pytest.approx(.21)
    assert m([.001] * 252).annualised_return == pytest.approx(1.001 ** 252 - 1)
    assert m([1.0, -.5]).max_drawdown == pytest.approx(-.5)
    assert m([0, 0, .01, -.01, .01]).hit_rate == pytest.approx(2 / 3)
    flat = m([.001] * 50)
    assert flat.sharpe_ratio == 0 and flat.n_days == 50
    assert m([-1.0, .5]).annualised_return == -1.0
    assert m([.02]).annualised_volatility == 0 and m([0.0, 0.0]).hit_rate == 0


def test_metrics_group_and_side_by_side(spark):
    df = _returns(spark, [.1, .1]).unionByName(_returns(spark, [.2, -.1], "B")).withColumn("other", F.lit(0.0))
    got = by(metrics.metric_bundle(df, ["g"], "date", {"a": "ret", "b": "other"}), "g")
    assert got["B"].a_cumulative_return == pytest.approx(1.2 * .9 - 1) and got["A"].b_cumulative_return == 0


def test_costs_on_turnover_without_look_ahead(spark):
    df = _returns(spark, [0, 0, 0]).withColumn("position", F.when(F.col("date") > F.lit(day(0)), 1.0).otherwise(0.0))
    net = by(metrics.net_of_cost(df.withColumn("market_ret", F.lit(0.0)), ["g"], "date"), "date")
    assert [net[day(i)].net_ret for i in range(3)] == [0, -.001, 0]
    held = metrics.net_of_cost(df.withColumn("position", F.lit(1.0)).withColumn("market_ret", F.lit(.1)), ["g"],
                               "date", cost=0.0)
    assert [by(held, "date")[day(i)].net_ret for i in range(3)] == pytest.approx([0, .1, .1])


def test_positions_are_carried_onto_market_dates(spark):
    market = _returns(spark, [0] * 5)
    pos = spark.createDataFrame([("A", day(1), 1.0), ("A", day(3), 0.0)], "g string, date date, position double")
    got = by(metrics.align_positions(market, pos, ["g"]), "date")
    assert [got[day(i)].position for i in range(5)] == [0, 1, 1, 0, 0]


def test_score_arithmetic_rounds_half_to_even(spark):
    rows = [(day(0), 5.0, 4., 4., 4., 1., 0., adx) for adx in (19.0, 22.0, 25.0, 40.0, None)]
    df = spark.createDataFrame([(f"T{i}", *r) for i, r in enumerate(rows)],
                               "ticker string, date date, close double, sma20 double, sma50 double, sma200 double, "
                               "macd double, macd_signal double, adx14 double")
    got = by(rules.add_rule_score(df), "ticker")
    assert [got[f"T{i}"].score for i in range(5)] == [2, 4, 5, 6, 4]
    odd = df.withColumn("sma20", F.lit(None).cast("double")).withColumn("sma50", F.lit(9.0))
    assert by(rules.add_rule_score(odd.where("ticker = 'T0'")), "ticker")["T0"].score == 0  # 1 / 2 -> 0


def test_position_is_held_between_signals(spark):
    df = spark.createDataFrame([("A", day(i), s) for i, s in enumerate([0, 3, 1, -1, -3, 2, 4])],
                               "ticker string, date date, score int")
    got = by(rules.add_position(df), "date")
    assert [got[day(i)].position for i in range(7)] == [0, 1, 1, 1, 0, 0, 1]


def _snapshot(spark, **over):
    base = dict(ticker="T", date=day(0), latest_close=100.0, previous_close=100.0, sma20=90.0, sma50=90.0,
                sma200=90.0, close_above_sma20=True, close_above_sma50=True, close_above_sma200=True,
                cross_event="none", sma_gap_percent=3.0, macd_line=1.0, macd_signal=.5, macd_hist=.5,
                macd_bullish=True, adx=22.0, plus_di=25.0, minus_di=15.0, adx_trending=False, adx_ranging=False,
                change_percent=0.0, intraday_return_percent=.2, intraday_volatility_percent=.1)
    base.update(over)
    kinds = {str: "string", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} " + ("date" if k == "date" else "string" if k in ("ticker", "cross_event") else
                                  kinds.get(type(v), "double")) for k, v in base.items())
    return rules.recommendations(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_cross_strength_scales_the_score(spark):
    strong = _snapshot(spark, cross_event="golden_cross", sma_gap_percent=8.0)
    marginal = _snapshot(spark, cross_event="golden_cross", sma_gap_percent=.5)
    assert strong.score - marginal.score == 2
    assert any("strong Golden Cross" in r for r in strong.reasons)
    assert any("marginal Golden Cross" in r for r in marginal.reasons)


def test_trend_amplifies_and_conflicts_warn(spark):
    plain, strong, very = (_snapshot(spark, adx=a) for a in (22.0, 30.0, 45.0))
    assert (strong.score - plain.score, very.score - plain.score) == (1, 2)
    assert very.trend_strength == "very strong" and any("amplifying the bullish signal" in r for r in strong.reasons)
    against = _snapshot(spark, adx=30.0, plus_di=10.0, minus_di=30.0)
    assert any("disagrees" in w for w in against.warnings)
    weak = _snapshot(spark, adx=15.0, adx_ranging=True)
    assert weak.trend_strength == "weak" and any("range-bound" in w for w in weak.warnings)


def test_balanced_strong_trend_is_described_as_high(spark):
    r = _snapshot(spark, adx=45.0, close_above_sma200=False, macd_bullish=False, close_above_sma20=True,
                  macd_hist=-.5)
    assert r.score == 0 and any("ADX is high" in s and "balanced" in s for s in r.reasons)


def test_high_risk_turns_buy_into_caution(spark):
    calm = _snapshot(spark)
    risky = _snapshot(spark, change_percent=5.0, intraday_volatility_percent=1.0)
    assert (calm.signal, calm.risk_level) == ("Watch / Buy", "Low")
    assert (risky.signal, risky.risk_level) == ("Watch with caution", "High")
    down = _snapshot(spark, macd_line=-1.0, macd_signal=-.5, macd_hist=-.5, macd_bullish=False)
    assert any("bearish momentum" in s for s in down.reasons) and down.disclaimer


def test_every_sentence_of_the_audit_holds(spark):
    closes = [100 + 20 * math.sin(i / 35) + .03 * i for i in range(700)]
    rec = rules.recommendations(rules.month_end_snapshots(range_bars(spark, {"A": closes, "B": closes[:230]})))
    s = session.stage(rules.audited_sentences(rec), "audited")
    t = rules.audit_totals(s).first()
    assert t.n_sentences == t.n_checkable == t.n_correct > 0 and t.coverage == t.accuracy == 1.0
    assert rules.audit_violations(s).count() == 0 and rules.unmatched_examples(s).count() == 0


def test_audit_catches_false_and_vague_sentences(spark):
    closes = [100 + 20 * math.sin(i / 35) for i in range(300)]
    rec = rules.recommendations(rules.month_end_snapshots(range_bars(spark, {"A": closes}), 1))
    lies = rec.withColumn("reasons", F.array(
        F.lit("MACD is above its signal line with a positive histogram, confirming bullish momentum."),
        F.lit("MACD is below its signal line with a negative histogram, confirming bearish momentum."),
        F.lit("ADX is high at about 99 (very strong trend), amplifying the bullish signal"),
        F.lit("Everybody likes this one.")))
    s = rules.audited_sentences(lies)
    assert [r.ok for r in s.orderBy("position").collect()][2:] == [False, False]
    assert rules.audit_totals(s).first().n_correct == 1
    assert rules.unmatched_examples(s).first()["sentence"] == "Everybody likes this one."


def test_trades_close_on_exit_or_at_the_end(spark):
    pos = [0, 1, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([("A", day(i), float(100 + 10 * i), p) for i, p in enumerate(pos)],
                               "ticker string, date date, close double, position int")
    got = backtest.trades(df).orderBy("trade").collect()
    assert [(r.entry_price, r.exit_price, r.closed) for r in got] == [(110, 130, True), (150, 160, False)]


def test_summary_reports_short_histories(spark):
    bars = range_bars(spark, {"A": [100 + 10 * math.sin(i / 20) + .1 * i for i in range(320)], "B": [5.0] * 50})
    got = by(backtest.summary(bars), "ticker")
    assert got["A"].status == "OK" and got["A"].final_buy_hold_value > 0
    assert got["B"].status.startswith("ERROR") and got["B"].final_strategy_value is None


def test_fold_windows(spark):
    n = lambda **k: [tuple(r) for r in (
        backtest.fold_rows(close_bars(spark, {"A": range(1, 11)}), **k).groupBy("fold")
        .agg(F.min("_i"), F.max("_i")).orderBy("fold").collect())]
    assert n(train=4, test=2) == [(0, 4, 5), (1, 6, 7), (2, 8, 9)]
    assert n(train=4, test=3, step=1) == [(0, 4, 6), (1, 5, 7), (2, 6, 8), (3, 7, 9)]
    assert n(train=4, test=2, step=4) == [(0, 4, 5), (1, 8, 9)]
    assert n(train=9, test=2) == []
    with pytest.raises(ValueError):
        backtest.fold_rows(close_bars(spark, {"A": [1.0]}), train=0)


def test_each_fold_pays_for_its_own_entry(spark):
    always = lambda d: d.withColumn("position", F.lit(1))
    daily = backtest.walk_forward_daily(close_bars(spark, {"A": [100.0] * 20}), 4, 4, position=always)
    folds = backtest.walk_forward_folds(daily).orderBy("fold").collect()
    assert len(folds) == 4 and all(f.strategy_cumulative_return == pytest.approx(-.001) for f in folds)
    assert all(f.n_trades == 1 for f in folds)
    assert folds[0].train_start == day(0) and folds[0].train_end == day(3) and folds[0].test_start == day(4)
    whole = backtest.walk_forward_overall(daily).first()
    assert whole.n_days == 16 and whole.strategy_cumulative_return == pytest.approx(.999 ** 4 - 1)
