"""The held rule position per ticker on a stream of daily scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps each state variable as a table of its own, with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "position"


class HeldPosition(StatefulProcessor):
    """A ticker's position and the last day it stands for, with a timer that ends it when the ticker has been idle."""

    def __init__(self, buy: int, sell: int, idle_days: int):
        self.buy, self.sell, self.idle = buy, sell, idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState(STATE, "held int, last date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last = self.position.get() if self.position.exists() else (0, None)
        own = pd.concat(list(rows)).sort_values("date")
        if last is not None:
            own = own[own["date"] > last]
        if own.empty:
            return
        signal = np.where(own["score"] >= self.buy, 1.0, np.where(own["score"] <= self.sell, 0.0, np.nan))
        position = pd.Series(signal, index=own.index).ffill().fillna(held).astype("int32")
        last = own["date"].iloc[-1]
        self.position.update((int(position.iloc[-1]), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        midnight = dt.datetime(last.year, last.month, last.day, tzinfo=dt.timezone.utc)
        self.handle.registerTimer(int(midnight.timestamp() * 1000) + self.idle)
        yield pd.DataFrame({"ticker": key[0], "date": own["date"], "score": own["score"], "position": position})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.position.clear()
        return iter(())

    def close(self) -> None:
        pass


def held_positions(scores: DataFrame, buy: int = 3, sell: int = -3, late_days: int = 30, idle_days: int = 400) -> DataFrame:
    """1 after a score of at least ``buy``, 0 after one of at most ``sell``, else unchanged.

    The state is a ticker's position and the last day it stands for. Within a micro-batch scores are put in
    date order; a score that comes after one of a later day or of its own was decided on is late and is dropped, so
    the order of arrival never changes a position. Scores ``late_days`` behind the newest ones are dropped before. A ticker without a
    score for ``idle_days`` loses its state and starts anew, flat, when it comes back: state is bounded by the tickers that trade.
    """
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = scores.select("ticker", "date", "score", F.col("date").cast("timestamp").alias("at")).withWatermark("at", f"{late_days} days")
    return timed.groupBy("ticker").transformWithStateInPandas(
        HeldPosition(buy, sell, idle_days), "ticker string, date date, score int, position int", "append", "EventTime")
