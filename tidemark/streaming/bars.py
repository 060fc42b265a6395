"""Closed intraday bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def closed_bars(ticks: DataFrame, minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """OHLC per ticker and tumbling window. In append mode a bar comes out once the watermark has
    passed its end; later ticks are dropped. Ticks fold on the map side, and the state holds one
    row per open bar."""
    order = F.struct("ts", "seq")
    return (
        ticks.where(F.col("price").isNotNull()).withWatermark("ts", lateness)
        .groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), F.max_by("price", order).alias("close"),
             F.count("*").alias("n_ticks"))
        .select("ticker", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"),
                "open", "high", "low", "close", "n_ticks")
    )
