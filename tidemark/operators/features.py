"""Calendar, feature matrix, cross-sectional normalisation and forward-return labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import schemas, session
from tidemark.functions.numeric import null_safe_join, safe_div
from tidemark.operators import asof, fundamentals as fund, indicators, ranks

MIN_NAMES = 10
UNKNOWN_SECTOR = "_UNKNOWN"
KEYS = ["rebalance_date", "ticker"]


def rebalance_calendar(bars: DataFrame, min_names: int = MIN_NAMES) -> DataFrame:
    """Month-ends on which at least ``min_names`` tickers (or all, if fewer) are live.

    A ticker adds +1 at its first month-end and -1 after its last one; the running sum of these
    changes over the months is the number of live tickers, so no ticker is paired with every month.
    """
    spans = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    # The first month-end on or after `first`, and the first month-end after `last`.
    born = F.last_day("first")
    gone = F.when(F.last_day("last") == F.col("last"), F.last_day(F.add_months("last", 1))
                  ).otherwise(F.last_day("last"))
    changes = F.array(F.struct(born.alias("month_end"), F.lit(1).alias("step")),
                      F.struct(gone.alias("month_end"), F.lit(-1).alias("step")))
    steps = (spans.select(F.inline(changes)).groupBy("month_end").agg(F.sum("step").alias("step")))
    bounds = spans.agg(F.last_day(F.min("first")).alias("lo"), F.max("last").alias("hi"),
                       F.count("*").alias("n"))
    every = bounds.select("n", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("m"), "hi")
    months = (every.select("n", F.last_day("m").alias("rebalance_date"), "hi")
              .where(F.col("rebalance_date") <= F.col("hi")))
    running = (F.sum(F.coalesce("step", F.lit(0))).over(
        _calendar_order("rebalance_date")))
    live = (months.join(F.broadcast(steps), F.col("rebalance_date") == F.col("month_end"), "left")
            .withColumn("live", running))
    need = F.greatest(F.lit(1), F.least(F.lit(min_names), F.col("n")))
    return live.where(F.col("live") >= need).select("rebalance_date")


def _calendar_order(on: str):
    """Order over calendar rows only (one per month); the constant key keeps it explicit."""
    return Window.partitionBy(F.lit(0)).orderBy(on)


def numbered(calendar: DataFrame, on: str = "rebalance_date", out: str = "_k") -> DataFrame:
    """Distinct calendar dates with their position (0, 1, ...)."""
    return calendar.select(on).distinct().withColumn(
        out, F.row_number().over(_calendar_order(on)) - 1)


def feature_matrix(bars: DataFrame, fundamentals: DataFrame | None, calendar: DataFrame,
                   sentiment: DataFrame | None = None) -> DataFrame:
    """One row per (rebalance date, ticker) with a price on or before the date.

    Technicals are the values at the ticker's current bar, fundamentals those of the newest filing
    already available; values still warming up stay NULL.
    """
    tech = asof.with_next(indicators.technical_frame(bars))
    cells = asof.on_calendar(tech, calendar).drop("date")
    if fundamentals is None:
        none = F.lit(None).cast("double")
        cells = cells.select(*KEYS, *schemas.TECHNICAL_FEATURES,
                             *[none.alias(c) for c in schemas.FUNDAMENTAL_FEATURES])
    else:
        filings = fund.with_ttm(fundamentals).select(
            "ticker", "period_end", "available_date", "shares_outstanding", "ttm_net_income", "total_equity",
            "roe", "net_margin", "debt_to_equity", "earnings_growth_yoy")
        current = asof.on_calendar(
            asof.with_next(filings, "available_date", tie=["period_end"]), calendar, order="available_date")
        wide = cells.join(current, KEYS, "left")
        cells = wide.select(*KEYS, *schemas.TECHNICAL_FEATURES,
                            *[v.alias(k) for k, v in fund.valuation_columns().items()])
    return cells if sentiment is None else with_sentiment(cells, sentiment)


def with_sentiment(matrix: DataFrame, sentiment: DataFrame) -> DataFrame:
    return matrix.join(sentiment.select(*KEYS, "sentiment"), KEYS, "left")


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in KEYS]


# ---- cross-sectional normalisation -------------------------------------------------------------

def _with_group(matrix: DataFrame, sectors: DataFrame | None) -> tuple[DataFrame, list[str]]:
    if sectors is None:
        return matrix, ["rebalance_date"]
    named = matrix.join(sectors.select("ticker", F.col("sector").alias("_sector")), "ticker", "left")
    return named.withColumn("_sector", F.coalesce("_sector", F.lit(UNKNOWN_SECTOR))), ["rebalance_date", "_sector"]


def normalise(matrix: DataFrame, method: str = "rank", columns=None, sectors: DataFrame | None = None) -> DataFrame:
    """Standardise each column inside each date's cross-section (or date and sector).

    ``rank``: percentile rank minus one half, ties averaged, NULLs kept out and kept.
    ``zscore``: deviations from the mean. ``matrix`` is read several times: stage it first.
    """
    if method not in ("rank", "zscore"):
        raise ValueError(f"method must be 'rank' or 'zscore', got {method!r}")
    every = feature_columns(matrix)
    cols = every if columns is None else [c for c in columns if c in every]
    grouped, by = _with_group(matrix, sectors)
    if method == "zscore":
        return _zscores(grouped, by, cols).select(*matrix.columns)
    long = grouped.select(*by, "ticker", F.inline(F.array(*[
        F.struct(F.lit(c).alias("_feature"), F.col(c).alias("_value")) for c in cols])))
    pct = ranks.ranked(long, [*by, "_feature"], "_value", ["ticker"]).withColumn(
        "_pct", F.col("avg_rank") / F.col("n") - 0.5)
    wide = pct.groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("_feature") == c, F.col("_pct"))).alias(c) for c in cols])
    return (matrix.select(*KEYS, *[c for c in every if c not in cols])
            .join(wide, KEYS, "left").select(*matrix.columns))


def _zscores(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Means and deviations per date (and sector) are partial aggregates, staged so that Spark sees
    their size when it chooses the join."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    z = {c: F.when(F.col(f"_s_{c}") > 1e-15 * F.abs(f"_m_{c}"),
                   safe_div(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}")) for c in cols}
    return null_safe_join(df, session.stage(stats, "zscore_stats"), by).select(
        *[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


# ---- forward returns and labels ----------------------------------------------------------------

def forward_returns(bars: DataFrame, calendar: DataFrame, horizon_months: int = 1, lag: int = 0) -> DataFrame:
    periods = calendar.select(F.col("rebalance_date").alias("entry_date"),
                              F.add_months("rebalance_date", horizon_months).alias("exit_date"))
    return asof.period_returns(bars, periods, lag).select(
        F.col("entry_date").alias("rebalance_date"), "ticker", F.col("ret").alias("fwd_ret"))


def relative_labels(returns: DataFrame, benchmark: str = "median") -> DataFrame:
    """1 if the forward return is strictly above the date's median (or mean), else 0.

    ``returns`` is read several times: stage it first.
    """
    if benchmark not in ("median", "mean"):
        raise ValueError(f"benchmark must be 'median' or 'mean', got {benchmark!r}")
    if benchmark == "mean":
        bar = returns.groupBy("rebalance_date").agg(F.avg("fwd_ret").alias("_bar"))
    else:
        bar = ranks.group_quantiles(
            ranks.ranked(returns, ["rebalance_date"], "fwd_ret", ["ticker"]),
            ["rebalance_date"], "fwd_ret", {"_bar": 0.5}).drop("n")
    return returns.join(F.broadcast(bar), "rebalance_date").select(
        *KEYS, (F.col("fwd_ret") > F.col("_bar")).cast("int").alias("label"))


def with_labels(matrix: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    return matrix.join(labels, KEYS, how)


def drop_features(matrix: DataFrame, *names: str) -> DataFrame:
    return matrix.drop(*names)
