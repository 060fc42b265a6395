"""As-of sampling of a per-ticker history on a calendar.

A row of a history is the current one from its own date until the next row's date. With that
interval attached (one ``lead`` in the window that the indicators use anyway), an as-of join is:
list the months an interval touches, equi-join the calendar on month, keep the dates inside the
interval. The history is never multiplied by the calendar, nothing is sorted again, and the
calendar is the only broadcast: its size is bounded by the number of days in the DATE range it
covers, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LAST = "last"        # the newest row stays current for ever
GUARDED = "guarded"  # a date after a ticker's newest row has no current row
NEXT = "next"        # the first row strictly after the date


def with_next(history: DataFrame, order="date", tie: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """Attach ``_next`` (date of the following row) and ``_next_<c>`` for the carried columns."""
    w = Window.partitionBy("ticker").orderBy(order, *tie)
    return history.select("*", F.lead(order).over(w).alias("_next"),
                          *[F.lead(c).over(w).alias(f"_next_{c}") for c in carry])


def _until(order: str, mode: str, calendar: DataFrame, on: str) -> Column:
    if mode == LAST:
        end = calendar.agg(F.max(on)).scalar()
        return F.coalesce(F.col("_next"), F.greatest(F.date_add(end, 1), F.col(order)))
    if mode == GUARDED:
        return F.coalesce(F.col("_next"), F.date_add(F.col(order), 1))
    return F.col("_next")


def on_calendar(history: DataFrame, calendar: DataFrame, mode: str = LAST,
                order: str = "date", on: str = "rebalance_date") -> DataFrame:
    """Rows of ``history`` (from :func:`with_next`) repeated for each calendar date they are
    current on. ``calendar`` may carry more columns and repeat a date; all its rows come back."""
    until = _until(order, mode, calendar, on)
    months = F.sequence(F.trunc(order, "month"), F.trunc(F.date_sub("_until", 1), "month"),
                        F.expr("INTERVAL 1 MONTH"))
    spans = (
        history.withColumn("_until", until)
        .where(F.col("_until") > F.col(order))
        .withColumn("_month", F.explode(months))
    )
    dates = F.broadcast(calendar.withColumn("_month", F.trunc(on, "month")))
    return (
        spans.join(dates, "_month")
        .where((F.col(order) <= F.col(on)) & (F.col(on) < F.col("_until")))
        .drop("_month", "_until", "_next")
    )


def price_at(bars: DataFrame, calendar: DataFrame, lag: int = 0, on: str = "rebalance_date") -> DataFrame:
    """Execution price per (ticker, calendar row): the last close on or before the date (lag 0,
    none after the ticker's last bar) or the first close strictly after it (lag 1)."""
    slim = bars.where(F.col("close").isNotNull()).select("ticker", "date", "close")
    valid = with_next(slim, carry=["close"])
    if lag <= 0:
        out = on_calendar(valid, calendar, GUARDED, on=on).withColumn("price", F.col("close"))
    else:
        out = on_calendar(valid, calendar, NEXT, on=on).withColumn("price", F.col("_next_close"))
    return out.drop("date", "close", "_next_close")


def period_returns(bars: DataFrame, periods: DataFrame, lag: int = 0) -> DataFrame:
    """Return of every ticker over every ``(entry_date, exit_date)`` period.

    Entry and exit are two rows of one calendar, so both prices come from the same single pass and
    meet in a group per (ticker, period). Periods without both prices are absent.
    """
    ends = F.array(F.struct(F.col("entry_date").alias("at"), F.lit(True).alias("is_entry")),
                   F.struct(F.col("exit_date").alias("at"), F.lit(False).alias("is_entry")))
    calendar = periods.select("entry_date", "exit_date", F.inline(ends))
    priced = price_at(bars, calendar, lag, on="at")
    both = priced.groupBy("ticker", "entry_date", "exit_date").agg(
        F.max(F.when(F.col("is_entry"), F.col("price"))).alias("entry_price"),
        F.max(F.when(~F.col("is_entry"), F.col("price"))).alias("exit_price"))
    return (
        both.where(F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull()
                   & (F.col("entry_price") != 0))
        .withColumn("ret", F.col("exit_price") / F.col("entry_price") - 1)
    )
