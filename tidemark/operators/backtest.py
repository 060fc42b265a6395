"""Rule backtest and walk-forward evaluation for all tickers at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import session
from tidemark.functions.numeric import safe_div
from tidemark.operators import metrics, rules
from tidemark.operators.indicators import by_date, change

PositionFunction = Callable[[DataFrame], DataFrame]


def daily_strategy(signals: DataFrame, cash: float = 10_000.0) -> DataFrame:
    """Bars with a 200-day mean, their market and strategy returns and both equity curves."""
    w = by_date()
    df = signals.where(F.col("sma200").isNotNull())
    df = df.withColumn("market_return", F.coalesce(change(), F.lit(0.0)))
    df = df.withColumn("strategy_return", F.coalesce(F.lag("position").over(w), F.lit(0)) * F.col("market_return"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("strategy_equity", cash * metrics.growth("strategy_return").over(run))
    df = df.withColumn("buy_hold_equity", cash * metrics.growth("market_return").over(run))
    return df.withColumn("drawdown", F.try_divide(
        F.col("strategy_equity"), F.max("strategy_equity").over(run)) - 1)


def trades(daily: DataFrame) -> DataFrame:
    """Entries 0 -> 1, each closed by the first later 1 -> 0 or else by the last bar."""
    w = by_date()
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    flags = daily.select("ticker", "date", "close",
                         ((before == 0) & (F.col("position") == 1)).cast("int").alias("_in"),
                         ((before == 1) & (F.col("position") == 0)).cast("int").alias("_out"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = flags.withColumn("trade", F.sum("_in").over(run)).where(F.col("trade") > 0)
    out = F.when(F.col("_out") == 1, F.col("date"))
    got = numbered.groupBy("ticker", "trade").agg(
        F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"),
        F.coalesce(F.min(out), F.max("date")).alias("exit_date"),
        F.coalesce(F.min_by("close", out), F.max_by("close", "date")).alias("exit_price"),
        (F.max("_out") == 1).alias("closed"))
    return got.where(F.col("entry_price") > 0).withColumn(
        "return_percent", 100 * (F.col("exit_price") / F.col("entry_price") - 1))


def summary(bars: DataFrame, cash: float = 10_000.0, position: PositionFunction = rules.rule_signals) -> DataFrame:
    """One row per ticker; tickers without enough history get a status instead of numbers."""
    signals = position(bars.where(F.col("close").isNotNull()))
    daily = session.stage(daily_strategy(signals, cash).select(
        "ticker", "date", "close", "position", "strategy_equity", "buy_hold_equity", "drawdown"), "daily")
    totals = daily.groupBy("ticker").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("_n"),
        F.max_by("strategy_equity", "date").alias("final_strategy_value"),
        F.max_by("buy_hold_equity", "date").alias("final_buy_hold_value"),
        (100 * F.min("drawdown")).alias("max_drawdown_percent"))
    closed = trades(daily).groupBy("ticker").agg(
        F.count("*").alias("number_of_trades"),
        (100 * F.avg((F.col("return_percent") > 0).cast("double"))).alias("win_rate_percent"))
    ok = F.col("_n") >= 2
    figures = (totals.join(closed, "ticker", "left")
               .withColumn("strategy_return_percent", 100 * (F.col("final_strategy_value") / cash - 1))
               .withColumn("buy_hold_return_percent", 100 * (F.col("final_buy_hold_value") / cash - 1))
               .withColumn("difference_percent",
                           F.col("strategy_return_percent") - F.col("buy_hold_return_percent"))
               .withColumn("number_of_trades", F.coalesce("number_of_trades", F.lit(0).cast("bigint")))
               .withColumn("win_rate_percent", F.coalesce("win_rate_percent", F.lit(0.0))))
    names = ["start_date", "end_date", "final_strategy_value", "final_buy_hold_value", "strategy_return_percent",
             "buy_hold_return_percent", "difference_percent", "max_drawdown_percent", "number_of_trades",
             "win_rate_percent"]
    failed = "ERROR: Not enough data for backtesting. At least 200 trading days are required."
    return (bars.select("ticker").distinct().join(figures, "ticker", "left")
            .select("ticker", *[F.when(ok, F.col(n)).alias(n) for n in names],
                    F.lit(cash).alias("initial_cash"),
                    F.when(ok, "OK").otherwise(failed).alias("status")))


# ---- walk-forward ------------------------------------------------------------------------------

def fold_rows(df: DataFrame, train: int = 252, test: int = 63, step: int | None = None) -> DataFrame:
    """Every bar once per fold that tests on it, with the fold's first and last row numbers.

    Fold ``k`` (from 0) tests rows ``k*step+train .. +test`` of its ticker and exists only when the
    ticker's history covers it completely.
    """
    if train <= 0 or test <= 0 or (step is not None and step <= 0):
        raise ValueError("train, test and step must be positive")
    step = step or test
    w = by_date()
    rows = (df.withColumn("_i", F.row_number().over(w) - 1)
            .withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))))
    offset = F.col("_i") - train
    # Folds k with k*step <= offset < k*step + test that fit into the history.
    first = F.greatest(F.lit(0), F.ceil((offset - test + 1) / F.lit(step)))
    last = F.least(F.floor(offset / F.lit(step)), F.floor((F.col("_n") - train - test) / F.lit(step)))
    return (rows.where((offset >= 0) & (F.col("_n") >= train + test) & (last >= first))
            .withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int")))))


def walk_forward_daily(bars: DataFrame, train: int = 252, test: int = 63, step: int | None = None,
                       cost: float = 0.001, position: PositionFunction = rules.rule_signals) -> DataFrame:
    """Net strategy and market return of every (ticker, fold, date). Each fold starts in cash and
    pays for its own entry."""
    clean = bars.where(F.col("close").isNotNull())
    held = position(clean).withColumn("market_ret", F.coalesce(safe_div(
        "close", F.lag("close").over(by_date())) - 1, F.lit(0.0)))
    dates = held.withColumn("_train_start", F.lag("date", train).over(by_date())).withColumn(
        "_train_end", F.lag("date", 1).over(by_date()))
    folds = fold_rows(dates.select("ticker", "date", "position", "market_ret", "_train_start", "_train_end"),
                      train, test, step)
    net = metrics.net_of_cost(folds, ["ticker", "fold"], "date", cost=cost)
    entered = ((F.coalesce(F.lag("position").over(Window.partitionBy("ticker", "fold").orderBy("date")),
                           F.lit(0)) == 0) & (F.col("position") == 1)).cast("int")
    return net.withColumn("entered", entered)


SIDES = {"strategy": "net_ret", "benchmark": "market_ret"}


def walk_forward_folds(daily: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Metrics of strategy and buy-and-hold per (ticker, fold)."""
    return metrics.metric_bundle(daily, ["ticker", "fold"], "date", SIDES, risk_free, extra=[
        F.min_by("_train_start", "date").alias("train_start"), F.min_by("_train_end", "date").alias("train_end"),
        F.min("date").alias("test_start"), F.max("date").alias("test_end"),
        F.sum("entered").alias("n_trades")])


def walk_forward_overall(daily: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Metrics of the stitched test windows per ticker (repeated days stay when step < test)."""
    stitched = daily.withColumn("_at", F.struct("fold", "date"))
    return metrics.metric_bundle(stitched, ["ticker"], "_at", SIDES, risk_free)


def walk_forward_means(folds: DataFrame) -> DataFrame:
    """Mean over folds per ticker, strategy and benchmark side by side."""
    return folds.groupBy("ticker").agg(
        *[F.avg(f"{side}_{m}").alias(f"{side}_mean_{m}") for side in ("strategy", "benchmark")
          for m in metrics.METRICS],
        F.count("*").alias("n_folds"))
