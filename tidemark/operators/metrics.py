"""Performance metrics of return series, grouped by any keys.

A return series is one row per period; a group's rows are bounded by its calendar, which is what
the running product of the drawdown relies on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TRADING_DAYS = 252
MONTHS = 12
METRICS = ["cumulative_return", "annualised_return", "annualised_volatility", "sharpe_ratio",
           "max_drawdown", "hit_rate"]


def growth(r: str) -> Column:
    return F.product(1 + F.coalesce(F.col(r), F.lit(0.0)))


def annualised(total: Column, n: Column, periods: int) -> Column:
    return F.when(n == 0, 0.0).when(total <= 0, -1.0).otherwise(F.pow(total, periods / n) - 1)


def nonzero_std(std: Column, mean: Column) -> Column:
    """NULL where the deviation is zero up to rounding."""
    return F.when(std > 1e-12 * F.greatest(F.abs(mean), F.lit(1e-4)), std)


def equity_curves(returns: DataFrame, by, order: str, ret: str = "ret", cash: float = 1.0) -> DataFrame:
    """Compounded value and drawdown after each period."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("equity", cash * growth(ret).over(w))
    return curve.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def metric_bundle(returns: DataFrame, by, order: str, ret: str | dict[str, str] = "ret", risk_free: float = 0.0,
                  periods: int = TRADING_DAYS, count: str = "n_days", extra=()) -> DataFrame:
    """All metrics per group in one pass. ``ret`` may name several series as ``{prefix: column}``;
    their metrics come out side by side as ``<prefix>_<metric>``. ``extra`` are further aggregates.
    """
    by = list(by)
    series = {"": ret} if isinstance(ret, str) else {f"{k}_": v for k, v in ret.items()}
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    zeroed = returns.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"_r{p}") for p, c in series.items()])
    grown = zeroed.select("*", *[growth(f"_r{p}").over(w).alias(f"_e{p}") for p in series])
    falls = grown.select("*", *[(F.try_divide(F.col(f"_e{p}"), F.max(f"_e{p}").over(w)) - 1).alias(f"_d{p}") for p in series])
    n = F.count("*")
    aggs = []
    for p in series:
        r = f"_r{p}"
        mean, std, total = F.avg(r), F.stddev_samp(r), growth(r)
        active = F.when(F.col(r) != 0, (F.col(r) > 0).cast("double"))
        aggs += [
            (total - 1).alias(f"{p}cumulative_return"),
            annualised(total, n, periods).alias(f"{p}annualised_return"),
            F.coalesce(std * (periods ** 0.5), F.lit(0.0)).alias(f"{p}annualised_volatility"),
            F.coalesce((mean - risk_free / periods) / nonzero_std(std, mean) * (periods ** 0.5),
                       F.lit(0.0)).alias(f"{p}sharpe_ratio"),
            F.min(f"_d{p}").alias(f"{p}max_drawdown"),
            F.coalesce(F.avg(active), F.lit(0.0)).alias(f"{p}hit_rate"),
        ]
    return falls.groupBy(*by).agg(*aggs, n.alias(count), *extra)


def fold_means(folds: DataFrame, by) -> DataFrame:
    """Unweighted mean of every metric over the folds of a group."""
    return folds.groupBy(*by).agg(*[F.avg(m).alias(f"mean_{m}") for m in METRICS],
                                  F.count("*").alias("n_folds"))


def net_of_cost(df: DataFrame, by, order: str, position: str = "position", market: str = "market_ret",
                cost: float = 0.001) -> DataFrame:
    """Previous position times market return, minus cost on the change of position. The first row
    of a group earns nothing and pays for its opening position."""
    w = Window.partitionBy(*by).orderBy(order)
    held = F.coalesce(F.lag(position).over(w), F.lit(0.0))
    traded = F.abs(F.col(position) - held)
    return df.withColumn("net_ret", held * F.coalesce(F.col(market), F.lit(0.0)) - traded * F.lit(cost))


def align_positions(market: DataFrame, positions: DataFrame, by, order: str = "date") -> DataFrame:
    """Positions carried forward onto the market's dates, 0 before the first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = market.join(positions.select(*by, order, F.col("position").cast("double")), [*by, order], "left")
    return joined.withColumn("position", F.coalesce(F.last("position", ignorenulls=True).over(w), F.lit(0.0)))
