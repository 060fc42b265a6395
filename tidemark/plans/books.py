"""Composed plans: from bars to a scored, traded and evaluated book."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark import session
from tidemark.operators import asof, evaluation, features, indicators, metrics, montecarlo, selection
from tidemark.operators.selection import DATE


@dataclass(frozen=True)
class SelectionConfig:
    top_n: int = 3
    cost: float = selection.DEFAULT_COST
    lag: int = 0
    periods: int = metrics.MONTHS
    market: str = selection.MARKET_TICKER
    min_train_dates: int = 3


def momentum_scores(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """12-1 momentum of every cell that has one, as a score."""
    mom = bars.where(F.col("close").isNotNull()).select(
        "ticker", "date", indicators.change(*indicators.MOMENTUM_WINDOWS["mom_12m"]).alias("score"))
    return (asof.on_calendar(asof.with_next(mom), calendar)
            .where(F.col("score").isNotNull()).select(DATE, "ticker", "score"))


def book_streams(scores: DataFrame, bars: DataFrame, config: SelectionConfig = SelectionConfig(), returns: DataFrame | None = None) -> DataFrame:
    """Top-n equal-weight book of the scores, net of costs, next to both benchmarks. ``returns``: those of ``bars`` over its periods, where known."""
    weights = session.stage(selection.equal_weights(selection.top_n(scores, config.top_n)), "weights")
    return selection.evaluate_portfolio(weights, bars, config.cost, config.lag, config.market, returns)


def book_metrics(streams: DataFrame, periods: int = metrics.MONTHS) -> DataFrame:
    """Metrics of strategy, equal-weight universe and market, one row each."""
    long = streams.select("entry_date", F.inline(F.array(*[
        F.struct(F.lit(name).alias("series"), F.col(c).alias("ret"))
        for name, c in (("strategy", "net"), ("benchmark", "benchmark"), ("market", "market"))])))
    return metrics.metric_bundle(long.where(F.col("ret").isNotNull()), ["series"], "entry_date",
                                 periods=periods, count="n_periods")


def selection_report(scores: DataFrame, labels: DataFrame, bars: DataFrame,
                     config: SelectionConfig = SelectionConfig(), returns: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything reported about one set of scores. Scores, streams and realised returns are staged
    once and read by all tables. ``returns``: those of ``bars`` over the holding periods (without lag), where known."""
    scores = session.stage(scores, "scores")
    streams = session.stage(book_streams(scores, bars, config, returns), "streams")
    pairs = session.stage(evaluation.scored_returns(scores, bars, returns=returns), "pairs")
    scored = session.stage(evaluation.scored_labels(scores, labels), "scored")
    spread = evaluation.long_short(pairs).select(DATE, F.col("spread").alias("ret"), F.lit("long_short").alias("series"))
    return {
        "weights": selection.equal_weights(selection.top_n(scores, config.top_n)),
        "streams": streams,
        "metrics": book_metrics(streams, config.periods),
        "avg_turnover": selection.average_turnover(streams),
        "ranking": evaluation.ranking_metrics(scored, config.top_n),
        "win_rate": evaluation.win_rate(streams),
        "yearly": evaluation.yearly_breakdown(streams),
        "information": evaluation.information_summary(evaluation.information_by_date(pairs)),
        "long_short": metrics.metric_bundle(spread, ["series"], DATE, periods=config.periods, count="n_periods"),
    }


def _long(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
    """The number columns of a small table as rows: section, key, metric, value."""
    columns = [c for c in df.columns if c != key]
    named = F.col(key).cast("string") if key else F.lit("all")
    return (df.select(F.lit(section).alias("section"), named.alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["section", "key"], columns, "metric", "value"))


def report_table(report: dict[str, DataFrame]) -> DataFrame:
    """Every figure of a ``selection_report`` as one table: section, key (series, year or ``all``), metric, value."""
    parts = [
        _long(report["metrics"], "metrics", "series"),
        _long(report["long_short"], "metrics", "series"),
        report["ranking"].select(F.lit("ranking").alias("section"), F.lit("all").alias("key"), "metric", F.col("value").cast("double")),
        _long(report["yearly"], "yearly", "year"),
        *[_long(report[name], name) for name in ("avg_turnover", "win_rate", "information")],
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def paired_reports(variants: DataFrame, drop: str, labels: DataFrame, bars: DataFrame,
                   config: SelectionConfig = SelectionConfig()) -> DataFrame:
    """The reports of both variants of ``ablation`` side by side: section, key, metric, ``with_value``, ``without_value`` and
    their ``difference`` (with minus without). A figure that only one variant has is NULL in the other."""
    variants = session.stage(variants, "variants")
    dates = variants.groupBy("variant").agg(F.collect_set(DATE).alias("dates")).collect()
    returns = None
    if len({frozenset(r["dates"]) for r in dates}) == 1 and config.lag == 0:  # one calendar, so returns are realised over the same periods
        returns = session.stage(asof.period_returns(bars, evaluation.holding_periods(variants)).select(
            "ticker", "entry_date", "exit_date", "ret"), "returns")
    sides = {}
    for side in ("with", "without"):
        scores = variants.where(F.col("variant") == f"{side}_{drop}").drop("variant")
        sides[side] = report_table(selection_report(scores, labels, bars, config, returns)).withColumnRenamed("value", f"{side}_value")
    return (sides["with"].join(sides["without"], ["section", "key", "metric"], "full")
            .withColumn("difference", F.col("with_value") - F.col("without_value")))


def ablation(matrix: DataFrame, drop: str, score, both=None) -> DataFrame:
    """Run ``score`` (matrix -> scores) with and without one column, tagged by ``variant``. ``both`` (matrix -> scores tagged like that), where
    given, does so in one go if the matrix has the column."""
    if both is not None and drop in matrix.columns:
        return both(matrix)
    without = score(features.drop_features(matrix, drop)).withColumn("variant", F.lit(f"without_{drop}"))
    if drop not in matrix.columns:
        return without
    return score(matrix).withColumn("variant", F.lit(f"with_{drop}")).unionByName(without)


def robustness(scores: DataFrame, labels: DataFrame, bars: DataFrame, trial_counts=(10, 30, 50, 80),
               primary_n: int = 3, lag: int = 0) -> dict[str, DataFrame]:
    """Sensitivity grid, deflated Sharpe ladder and block bootstrap of the primary book."""
    scores = session.stage(scores, "scores")
    periods = evaluation.holding_periods(scores)
    returns = session.stage(asof.period_returns(bars, periods, lag).select(
        "ticker", "entry_date", "exit_date", "ret"), "returns")
    weights = session.stage(montecarlo.grid_weights(scores), "grid_weights")
    streams = session.stage(montecarlo.grid_returns(weights, returns), "grid")
    grid = metrics.metric_bundle(streams, ["top_n", "cost"], "entry_date", "net", periods=metrics.MONTHS,
                                 count="n_periods")
    scored = session.stage(evaluation.scored_labels(scores, labels), "scored")
    best = selection.top_n(scored, max(montecarlo.GRID_SIZES)).withColumn(
        "top_n", F.explode(F.array(*[F.lit(s) for s in montecarlo.GRID_SIZES]))).where(
        (F.col("pick_rank") <= F.col("top_n")) & F.col("label").isNotNull())
    precision = (best.groupBy("top_n", DATE).agg(F.avg(F.col("label").cast("double")).alias("p"))
                 .groupBy("top_n").agg(F.avg("p").alias("precision")))
    primary = streams.where((F.col("top_n") == primary_n) & (F.col("cost") == 0.001))
    trials = selection.sharpe_per_period(streams, ["top_n", "cost"])
    return {
        "grid": grid.join(F.broadcast(precision), "top_n"),
        "deflated": montecarlo.deflated_sharpe(primary, trials, trial_counts),
        "bootstrap": montecarlo.block_bootstrap(primary, "net", "entry_date"),
        "streams": streams,
    }
