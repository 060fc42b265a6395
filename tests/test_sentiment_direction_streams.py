import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import by, calendar, close_bars, day
from tidemark.operators import direction, evaluation, indicators, models, rules, sentiment
from tidemark.plans.catalog import _as_stream, _drain
from tidemark.streaming.bars import closed_bars
from tidemark.streaming.positions import held_positions
from tidemark.streaming.sentiment import trailing_sentiment

GOOD, BAD = ("bright", "sunny", "warm"), ("gloomy", "rainy", "cold")


def _heads(spark, rows):
    return spark.createDataFrame([(t, dt.datetime.fromisoformat(at), x, "s", "", i) for i, (t, at, x) in enumerate(rows)],
                                 "ticker string, published_at timestamp, text string, source string, url string, seq int")


def test_signed_score_and_softmax(spark):
    df = spark.range(1).select(
        F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("score"))
                  for k, v in (("Positive", .7), ("NEGATIVE", .2), ("other", .1))]).alias("distribution"),
        F.array(F.lit(1000.0), F.lit(1001.0)).alias("logits"))
    assert df.select(sentiment.signed_score()).first()[0] == pytest.approx(.5)
    out = df.select(sentiment.softmax_distribution("logits", {0: "positive"}).alias("d")).first().d
    assert [e.label for e in out] == ["positive", "1"] and out[1].score == pytest.approx(1 / (1 + math.exp(-1)))


def test_window_is_open_then_closed(spark):
    h = _heads(spark, [("A", "2020-01-24T00:00:00", "x"), ("A", "2020-01-24T00:00:01", "x"),
                       ("A", "2020-01-31T00:00:00", "x"), ("A", "2020-01-31T00:00:01", "x")])
    got = sentiment.headlines_in_window(h, calendar(spark, "2020-01-31", "2020-02-29"), 7)
    assert sorted(r.seq for r in got.collect()) == [1, 2]


def test_feature_averages_and_ignores_the_future(spark):
    rows = [("A", "2020-01-30T10:00:00", "A bright day"), ("A", "2020-01-29T10:00:00", "Rainy noon, cold night"),
            ("A", "2020-01-28T10:00:00", "  "), ("B", "2020-01-30T10:00:00", " "), ("C", "2020-02-20T10:00:00", "warm")]
    s = sentiment.scored_headlines(_heads(spark, rows), sentiment.lexicon_column(GOOD, BAD))
    got = by(sentiment.sentiment_feature(s, calendar(spark, "2020-01-31")), "ticker")
    assert got["A"].sentiment == pytest.approx(0.0) and got["B"].sentiment == 0.0 and "C" not in got
    more = sentiment.scored_headlines(_heads(spark, rows + [("A", "2020-02-01T00:00:00", "sunny")]),
                                      sentiment.lexicon_column(GOOD, BAD))
    assert by(sentiment.sentiment_feature(more, calendar(spark, "2020-01-31")), "ticker") == got


def test_injected_classifier(spark):
    def make():
        def classify(texts):
            return [[{"label": "positive", "score": .9 if "bright" in t else .1}, {"label": "negative", "score": .1}]
                    for t in texts]
        return classify
    h = _heads(spark, [("A", "2020-01-30T10:00:00", "a bright one"), ("A", "2020-01-30T11:00:00", "calm")])
    s = sentiment.scored_headlines(h, sentiment.scorer(make)("text")).agg(sentiment.mean_score()).first()[0]
    assert s == pytest.approx(.4)


def test_ticker_view_and_bands(spark):
    rows = [("A", f"2020-01-{d:02d}T10:00:00", "bright") for d in range(1, 20)] + [("B", "2020-01-05T10:00:00", "cold")]
    s = sentiment.scored_headlines(_heads(spark, rows), sentiment.lexicon_column(GOOD, BAD))
    view = by(sentiment.ticker_sentiment(s, "2020-01-31"), "ticker")
    assert view["A"].band == "Strongly positive" and view["A"].n_total == 19 and view["B"].label == "negative"
    new = sentiment.newest_headlines(s, "2020-01-31", n=3).where("ticker = 'A'").orderBy("recency").collect()
    assert [r.published_at.day for r in new] == [19, 18, 17]
    mood = sentiment.market_mood(sentiment.ticker_sentiment(s, "2020-01-31")).first()
    assert mood.mood == pytest.approx(0) and mood.n_tickers == 2 and mood.label == "neutral"
    edges = spark.createDataFrame([(x,) for x in (.5, .15, .1499, -.15, -.5, None)], "aggregate double")
    assert [r[0] for r in edges.select(sentiment.band()).collect()] == [
        "Strongly positive", "Positive", "Neutral", "Negative", "Strongly negative", "Unknown"]


# ---- direction ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(1)
    t = np.arange(420)
    series = {f"S{i}": (100 + 12 * np.sin(2 * np.pi * t / 40 + .7 * i) + .05 * rng.normal(0, 1, 420)).tolist()
              for i in range(4)}
    return indicators.direction_panel(close_bars(spark, series, dt.date(2015, 1, 1)), 5).cache()


def test_baseline_and_embargo_counts(waves):
    n = by(direction.per_stock_baseline(waves).groupBy("ticker").count(), "ticker")["S0"]["count"]
    rows = 420 - 49
    assert n == len([i for i in range(120, rows, 5) if i < rows - 5])
    learned = by(direction.per_stock_logistic(waves).groupBy("ticker").count(), "ticker")["S0"]["count"]
    assert learned == len([i for i in range(120, rows, 5) if i < rows - 5 and i - 5 >= 120])


def test_a_learnable_wave_is_learned(waves):
    s = evaluation.prediction_summary(direction.per_stock_logistic(waves)).first()
    assert s.accuracy > .8 and s.edge > .2 and s.n_stocks == 4


def test_per_stock_forecast_matches_plain_descent(waves):
    names = direction.feature_names(waves)
    pdf = direction.complete_rows(waves).where("ticker = 'S1'").toPandas().sort_values("date")
    x, y = pdf[names].to_numpy(), pdf["label"].to_numpy("float64")
    i, horizon, train = 200, 5, 150
    xs, ys = x[i - horizon - train:i - horizon], y[i - horizon - train:i - horizon]
    z = (xs - xs.mean(axis=0)) / xs.std(axis=0)
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(60_000):
        r = 1 / (1 + np.exp(-(z @ w + b))) - ys
        w, b = w - .005 * (z.T @ r + w), b - .005 * r.sum()
    want = 1 / (1 + math.exp(-(((x[i] - xs.mean(axis=0)) / xs.std(axis=0)) @ w + b)))
    got = direction.per_stock_logistic(waves.where("ticker = 'S1'"), horizon, train, step=1).toPandas()
    assert got.set_index("date").prob_up[pdf["date"].iat[i]] == pytest.approx(want, abs=1e-4)


def test_pooled_walk_forward_is_calibrated(waves):
    got = direction.pooled_walk_forward(waves, "logistic", step=120, years=1, options={"maxIter": 30}).cache()
    s = evaluation.prediction_summary(got).first()
    assert s.n_predictions > 0 and 0 <= s.brier <= 1
    assert got.where("prob_up < 0 or prob_up > 1").count() == 0
    none = direction.pooled_walk_forward(waves, "logistic", step=400, min_train=10**6)
    assert none.count() == 0


def test_latest_forecast_per_ticker(waves):
    base = direction.forecast_latest(waves).collect()
    assert len(base) == 4 and all(r.as_of == day(419, dt.date(2015, 1, 1)) for r in base)
    model = direction.forecast_latest(waves, "logistic", options={"maxIter": 30}).collect()
    assert all(0 <= r.prob_up <= 1 and r.direction == ("up" if r.prob_up >= .5 else "down") for r in model)


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrated_ranker(waves, method):
    names = direction.feature_names(waves)
    train = waves.dropna(subset=[*names, "label"])
    fit = models.CalibratedRanker("logistic", method, {"maxIter": 20}).fit(train, names)
    got = fit.score(train)
    assert set(got.columns) == {*train.columns, "score"}
    lo, hi, up = got.agg(F.min("score"), F.max("score"), F.corr("score", "label")).first()
    assert 0 <= lo < hi <= 1 and up > .3


# ---- streams -----------------------------------------------------------------------------------

def test_stream_bars_equal_batch_up_to_the_watermark(spark):
    t0 = dt.datetime(2020, 1, 2, 14, 30)
    ticks = spark.createDataFrame([("A", t0 + dt.timedelta(minutes=2 * i), 100.0 + i % 5, i) for i in range(30)],
                                  "ticker string, ts timestamp, price double, seq long")
    got = by(_drain(closed_bars(_as_stream(ticks, "ticks", "ts"))), "bar_start")
    assert got[t0].open == 100 and got[t0].close == 102 and got[t0].n_ticks == 3
    last = t0 + dt.timedelta(minutes=58)
    assert max(r.bar_end for r in got.values()) <= last - dt.timedelta(minutes=10)


def test_stream_sentiment_windows(spark):
    rows = [("A", "2020-01-10T00:00:00", "bright"), ("A", "2020-01-12T12:00:00", "cold"),
            ("A", "2020-02-20T00:00:00", "calm")]
    s = sentiment.scored_headlines(_heads(spark, rows), sentiment.lexicon_column(GOOD, BAD))
    got = by(_drain(trailing_sentiment(_as_stream(s, "heads", "published_at"))), "as_of")
    assert got[dt.date(2020, 1, 10)].n_headlines == 1 and got[dt.date(2020, 1, 13)].n_headlines == 2
    assert got[dt.date(2020, 1, 17)].n_headlines == 1 and dt.date(2020, 1, 20) not in got


def test_stream_positions_equal_batch(spark):
    df = spark.createDataFrame([(t, day(i), s) for t in "AB" for i, s in enumerate([0, 3, 1, -1, -3, 2, 4])],
                               "ticker string, date date, score int")
    got = by(_drain(held_positions(_as_stream(df, "scores", "date"))), "ticker", "date")
    want = by(rules.add_position(df), "ticker", "date")
    assert {k: v.position for k, v in got.items()} == {k: v.position for k, v in want.items()}


def test_late_scores_do_not_change_positions(spark, tmp_path):
    schema = "ticker string, date date, score int"
    for rows in ([("A", day(0), 3), ("A", day(2), 0)], [("A", day(1), -4), ("A", day(3), 1)], [("A", day(4), -3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["date"]: r["position"] for r in _drain(held_positions(stream)).collect()}
    assert got == {day(0): 1, day(2): 1, day(3): 1, day(4): 0}


def test_streams_come_in_batches(spark):
    df = spark.createDataFrame([(day(i % 50), i) for i in range(500)], "date date, i int")
    stream = _as_stream(df, "batches", "date")
    seen = []
    stream.writeStream.foreachBatch(lambda b, k: seen.append([r[0] for r in b.agg(F.min("date"), F.max("date")).collect()])) \
        .trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 5 and seen == sorted(seen)
