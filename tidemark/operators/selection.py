"""From scores to a portfolio: top-N picks, weights, turnover, net returns, benchmarks.

Everything is keyed by ``keys`` (for example a model, a configuration or a random draw), so many
portfolios are evaluated in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numeric import safe_div
from tidemark.operators import asof, features
from tidemark.operators.metrics import nonzero_std

DATE = "rebalance_date"
DEFAULT_COST = 0.001
MARKET_TICKER = "SPY"


def top_n(scores: DataFrame, n: int | str = 3, keys=()) -> DataFrame:
    """The ``n`` best scores per date; ties go to the smaller ticker, NULL scores come last.

    ``n`` may name a column. Spark trims every map task's dates to the limit before the shuffle
    when ``n`` is a number, so a large cross-section never meets in one task.
    """
    w = Window.partitionBy(*keys, DATE).orderBy(F.col("score").desc_nulls_last(), "ticker")
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    return scores.withColumn("pick_rank", F.row_number().over(w)).where(F.col("pick_rank") <= limit)


def equal_weights(picks: DataFrame, keys=()) -> DataFrame:
    size = F.count("*").over(Window.partitionBy(*keys, DATE))
    return picks.select(*keys, DATE, "ticker", (F.lit(1.0) / size).alias("weight"))


def schedule(weights: DataFrame, keys=()) -> DataFrame:
    """Consecutive weight dates of each portfolio as periods; the last date opens none."""
    w = Window.partitionBy(*keys).orderBy("entry_date")
    dates = weights.select(*keys, F.col(DATE).alias("entry_date")).distinct()
    return dates.select(*keys, "entry_date", F.lead("entry_date").over(w).alias("exit_date"),
                        (F.row_number().over(w) - 1).alias("_k"))


def turnover(weights: DataFrame, keys=()) -> DataFrame:
    """Sum of absolute weight changes between adjacent books; the first is bought from cash.

    Each book is listed twice, once as itself and once (negated) at the next date; the change of a
    name is the sum of the two, so no outer join of books is needed.
    """
    dates = schedule(weights, keys)
    mine = weights.withColumnRenamed(DATE, "entry_date")
    old = (mine.join(F.broadcast(dates) if not keys else dates, [*keys, "entry_date"])
           .where(F.col("exit_date").isNotNull())
           .select(*keys, F.col("exit_date").alias("entry_date"), "ticker", (-F.col("weight")).alias("weight")))
    change = (mine.select(*keys, "entry_date", "ticker", "weight").unionByName(old)
              .groupBy(*keys, "entry_date", "ticker").agg(F.sum("weight").alias("change")))
    return change.groupBy(*keys, F.col("entry_date").alias(DATE)).agg(F.sum(F.abs("change")).alias("turnover"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, keys=(), cost: float | str = DEFAULT_COST) -> DataFrame:
    """Gross and net return per holding period.

    ``returns`` are (ticker, entry_date, exit_date, ret); a pick without a price is left out and
    the rest renormalised, a period without any priced pick is dropped. ``cost`` may name a key.
    """
    periods = schedule(weights, keys).where(F.col("exit_date").isNotNull()).drop("_k")
    held = (weights.withColumnRenamed(DATE, "entry_date")
            .join(periods, [*keys, "entry_date"])
            .join(returns, ["ticker", "entry_date", "exit_date"]))
    gross = held.groupBy(*keys, "entry_date", "exit_date").agg(
        safe_div(F.sum(F.col("weight") * F.col("ret")), F.sum("weight")).alias("gross"))
    churn = turnover(weights, keys).withColumnRenamed(DATE, "entry_date")
    rate = F.col(cost) if isinstance(cost, str) else F.lit(float(cost))
    return (gross.join(churn, [*keys, "entry_date"])
            .withColumn("net", F.col("gross") - F.col("turnover") * rate))


def universe_returns(returns: DataFrame, market: str = MARKET_TICKER) -> DataFrame:
    """Equal-weight return of every priced ticker except the market, and the market's own return."""
    other = F.when(F.col("ticker") != market, F.col("ret"))
    return returns.groupBy("entry_date", "exit_date").agg(
        F.coalesce(F.avg(other), F.lit(0.0)).alias("benchmark"),
        F.max(F.when(F.col("ticker") == market, F.col("ret"))).alias("market"))


def evaluate_portfolio(weights: DataFrame, bars: DataFrame, cost: float = DEFAULT_COST, lag: int = 0,
                       market: str = MARKET_TICKER, returns: DataFrame | None = None) -> DataFrame:
    """Strategy, universe and market streams of one portfolio, one row per holding period. ``returns``: what ``asof.period_returns`` gives
    for these periods, where known."""
    periods = schedule(weights).where(F.col("exit_date").isNotNull()).select("entry_date", "exit_date")
    if returns is None:
        returns = asof.period_returns(bars, periods, lag).select("ticker", "entry_date", "exit_date", "ret")
    mine = portfolio_returns(weights, returns, cost=cost).drop("exit_date")
    base = universe_returns(returns, market)
    return periods.join(base, ["entry_date", "exit_date"], "left").join(mine, "entry_date", "left").select(
        "entry_date", "exit_date", "gross", "turnover", "net",
        F.coalesce("benchmark", F.lit(0.0)).alias("benchmark"), "market")


def latest_picks(weights: DataFrame) -> DataFrame:
    last = weights.agg(F.max(DATE)).scalar()
    return weights.where((F.col(DATE) == last) & (F.col("weight") > 0))


def candidates(matrix: DataFrame, min_train_dates: int = 3) -> DataFrame:
    """The cross-sections a selector could trade: all cells after the first ``min_train_dates``."""
    dates = features.numbered(matrix).where(F.col("_k") >= min_train_dates).select(DATE)
    return matrix.select(DATE, "ticker").join(F.broadcast(dates), DATE)


def average_turnover(streams: DataFrame) -> DataFrame:
    return streams.where(F.col("net").isNotNull()).agg(
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"))


def sharpe_per_period(returns: DataFrame, by, ret: str = "net") -> DataFrame:
    mean, std = F.avg(ret), F.stddev_samp(ret)
    return returns.groupBy(*by).agg(F.count(ret).alias("n"),
                                    F.coalesce(mean / nonzero_std(std, mean), F.lit(0.0)).alias("sharpe"))
