"""Trailing sentiment per ticker from a stream of scored headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.sentiment import mean_score


def trailing_sentiment(scored: DataFrame, lookback_days: int = 7, lateness: str = "1 day") -> DataFrame:
    """Mean signed score at every midnight over ``(midnight - lookback, midnight]``.

    Spark windows include their start and exclude their end; the rule is the other way round, so
    times are moved back by one microsecond before they are windowed.
    """
    shifted = scored.withColumn("_at", F.col("published_at") - F.expr("INTERVAL 0.000001 SECONDS"))
    return (
        shifted.withWatermark("_at", lateness)
        .groupBy("ticker", F.window("_at", f"{lookback_days} days", "1 day").alias("w"))
        .agg(mean_score().alias("sentiment"), F.count("*").alias("n_headlines"))
        .select("ticker", F.col("w.end").cast("date").alias("as_of"), "sentiment", "n_headlines")
    )
