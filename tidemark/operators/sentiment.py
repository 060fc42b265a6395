"""Headline scoring, the point-in-time sentiment feature and its summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark import schemas
from tidemark.operators.features import KEYS

# A classifier turns a list of texts into one label/score distribution per text.
Classifier = Callable[[list[str]], list[list[dict]]]

# Sign of each label, and the bands of a signed score.
LABEL_SIGN = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}
BANDS = [(0.5, "Strongly positive"), (0.15, "Positive")]
LOW_BANDS = [(-0.15, "Neutral"), (-0.5, "Negative")]


def scorer(make_classifier: Callable[[], Classifier]):
    """A column function text -> distribution. ``make_classifier`` runs once per Python worker
    task, so a model is loaded once and fed Arrow batches."""

    @F.pandas_udf(T.ArrayType(schemas.DISTRIBUTION))
    def distributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classify = make_classifier()
        for texts in batches:
            yield pd.Series(classify(texts.tolist()))

    return distributions


def lexicon_column(positive, negative, text: str = "text", sure: float = 0.9, rest: float = 0.05,
                   neutral: tuple[float, float, float] = (0.1, 0.1, 0.8)) -> Column:
    """Word-list classifier as a plain column: no Python involved. ``sure`` is the weight of the
    side whose word occurs, ``rest`` that of the other labels."""
    words = F.split(F.lower(F.trim(text)), r"\W+")
    has = lambda wanted: F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))
    dist = lambda p, n, z: F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
        for label, score in (("positive", p), ("negative", n), ("neutral", z))])
    return (F.when(has(positive), dist(sure, rest, rest)).when(has(negative), dist(rest, sure, rest))
            .otherwise(dist(*neutral)))


def signed_score(distribution="distribution") -> Column:
    """P(positive) - P(negative) of a distribution column; unknown labels count 0."""
    d = F.col(distribution) if isinstance(distribution, str) else distribution
    sign = lambda e: F.when(F.lower(e["label"]) == "positive", 1.0).when(
        F.lower(e["label"]) == "negative", -1.0).otherwise(0.0)
    return F.aggregate(d, F.lit(0.0), lambda acc, e: acc + sign(e) * F.coalesce(e["score"], F.lit(0.0)))


def softmax_distribution(logits="logits", id2label: dict[int, str] | None = None) -> Column:
    """Stable softmax of a logit array, labelled by position (or by its number)."""
    x = F.col(logits) if isinstance(logits, str) else logits
    exps = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    names = id2label or {}

    def entry(v, i):
        label = F.lit(None).cast("string")
        for j, name in names.items():
            label = F.when(i == j, name).otherwise(label)
        return F.struct(F.coalesce(label, i.cast("string")).alias("label"), (v / total).alias("score"))

    return F.transform(exps, entry)


def has_text(text: str = "text") -> Column:
    return F.col(text).isNotNull() & (F.trim(text) != "")


def scored_headlines(headlines: DataFrame, distribution: Column) -> DataFrame:
    """Add ``signed``; blank headlines keep NULL and do not count in means."""
    return headlines.withColumn("signed", F.when(has_text(), signed_score(distribution)))


def mean_score() -> Column:
    """Batch score: mean over non-blank texts, 0 when there is none."""
    return F.coalesce(F.avg("signed"), F.lit(0.0))


def headlines_in_window(headlines: DataFrame, calendar: DataFrame, lookback_days: int = 7) -> DataFrame:
    """Headlines with every rebalance date that sees them: published in
    ``(date - lookback, date]``.

    A headline covers a known span of dates; the calendar is matched by month inside that span.
    Only the calendar (bounded by the date range) is broadcast.
    """
    until = F.col("published_at") + F.make_dt_interval(F.lit(lookback_days))
    months = F.sequence(F.trunc("published_at", "month"), F.trunc(until, "month"), F.expr("INTERVAL 1 MONTH"))
    dates = F.broadcast(calendar.select("rebalance_date").distinct().select(
        "rebalance_date", F.trunc("rebalance_date", "month").alias("_month")))
    at = F.col("rebalance_date").cast("timestamp")
    return (headlines.withColumn("_month", F.explode(months)).join(dates, "_month")
            .where((F.col("published_at") <= at) & (at < until)).drop("_month"))


def sentiment_feature(scored: DataFrame, calendar: DataFrame, lookback_days: int = 7) -> DataFrame:
    """Mean signed score per (rebalance date, ticker); cells without headlines are absent."""
    return headlines_in_window(scored, calendar, lookback_days).groupBy(*KEYS).agg(
        mean_score().alias("sentiment"))


def window_at(scored: DataFrame, as_of, lookback_days: int = 30) -> DataFrame:
    at = F.lit(str(as_of)).cast("timestamp")
    return scored.where((F.col("published_at") <= at)
                        & (F.col("published_at") > at - F.make_dt_interval(F.lit(lookback_days))))


def band(score="aggregate") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    out = F.when(s.isNull(), "Unknown")
    for edge, name in BANDS:
        out = out.when(s >= edge, name)
    for edge, name in LOW_BANDS:
        out = out.when(s > edge, name)
    return out.otherwise("Strongly negative")


def simple_label(score="aggregate") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > 0.15, "positive").when(s < -0.15, "negative").otherwise("neutral")


def ticker_sentiment(scored: DataFrame, as_of, lookback_days: int = 30) -> DataFrame:
    rows = window_at(scored, as_of, lookback_days)
    return (rows.groupBy("ticker").agg(mean_score().alias("aggregate"), F.count("*").alias("n_total"))
            .withColumn("band", band()).withColumn("label", simple_label()))


def newest_headlines(scored: DataFrame, as_of, lookback_days: int = 30, n: int = 10, tie: str = "seq") -> DataFrame:
    """The newest ``n`` headlines per ticker; map tasks keep at most ``n`` per ticker before the
    shuffle, so a ticker with very much news stays small."""
    w = Window.partitionBy("ticker").orderBy(F.col("published_at").desc(), F.col(tie).desc())
    return (window_at(scored, as_of, lookback_days).withColumn("recency", F.row_number().over(w))
            .where(F.col("recency") <= n))


def market_mood(per_ticker: DataFrame, score: str = "aggregate") -> DataFrame:
    """Mean of the tickers' scores over tickers with news."""
    return per_ticker.agg(F.avg(score).alias("mood"), F.count(score).alias("n_tickers")).withColumn(
        "label", simple_label("mood"))
