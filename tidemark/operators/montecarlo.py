"""Permutation tests, bootstraps, random-selection nulls and deflated Sharpe ratios.

A draw is a key, never a loop. Draws come from md5 (see functions.draws), so a retried task
repeats the same draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import session
from tidemark.functions.draws import digest_number, draw_digest, uniform_int
from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.operators import ranks, selection
from tidemark.operators.metrics import annualised, growth, nonzero_std
from tidemark.operators.selection import DATE

EULER_MASCHERONI = 0.5772156649015329  # fixed value
ROWS_PER_CELL = 64


def _draws(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _first_bits(digest: str) -> Column:
    """The first 32 bits of a ``draw_digest``."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _cell_of(digest: str, cells: str) -> Column:
    """The cell, of so many equal ones, that a random number falls into: its first 31 bits tell."""
    return F.shiftright(F.shiftright(_first_bits(digest), 1) * F.col(cells), 31)


def _cell_start(cell: str, cells: str) -> Column:
    """The first 32 bits from which digests belong to the cell."""
    return F.expr(f"2 * ((({cell}) * 2147483648L + {cells} - 1) div {cells})")


# ---- label permutation -------------------------------------------------------------------------

def permutation_draws(scored: DataFrame, n: int = 3, draws: int = 100, seed: int = 0) -> DataFrame:
    """Mean AUC and precision@n per draw; draw -1 holds the real labels.

    Shuffling 0/1 labels inside a date is choosing which ``n1`` rows carry the ones, so a draw takes
    the ``n1`` rows with the smallest random numbers. The scores' ranks are the same in every draw
    and computed once. Rows are not sorted or shuffled per draw: random numbers are counted in
    cells, whole cells are taken by their sums, and only the cell the n1-th number falls into is
    looked at row by row.
    """
    rows = scored.where(F.col("label").isNotNull())
    picks = selection.top_n(scored, n).select(DATE, "ticker", F.lit(1).alias("_pick"))
    base = ranks.ranked(rows, [DATE], "score", ["ticker"]).select(DATE, "ticker", "label", "avg_rank")
    base = session.stage(
        base.join(picks, [DATE, "ticker"], "left").withColumn("_pick", F.coalesce("_pick", F.lit(0))),
        "permutation")
    dates = base.groupBy(DATE).agg(
        F.count("*").alias("n"), F.sum("label").alias("n1"), F.sum("_pick").alias("n_picks"))
    dates = dates.withColumn("_cells", F.ceil(F.col("n") / ROWS_PER_CELL))
    # One row per date.
    known = session.spread(base).join(F.broadcast(dates.select(DATE, "n1", "_cells")), DATE).withColumn(
        "_name", F.concat_ws("|", F.col(DATE).cast("string"), "ticker"))  # the same in all draws
    digest = draw_digest(F.lit(seed), F.col("draw"), F.col("_name"))
    drawn = _draws(known.drop("ticker"), draws).withColumn("_u", digest).withColumn("_cell", _cell_of("_u", "_cells"))
    cells = drawn.groupBy("draw", DATE, "n1", "_cells", "_cell").agg(
        F.count("*").alias("_held"), F.sum("avg_rank").alias("_ranks"), F.sum("_pick").alias("_picks"))
    before = F.coalesce(F.sum("_held").over(
        Window.partitionBy("draw", DATE).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = session.stage(cells.withColumn("_before", before).where(F.col("_before") < F.col("n1")), "cells")
    whole = cells.where(F.col("_before") + F.col("_held") <= F.col("n1")).select("draw", DATE, "_ranks", "_picks")
    # One row per date: the cell looked at in each draw, so the rows of a date are matched with it before they are drawn again.
    edge = cells.where(F.col("_before") + F.col("_held") > F.col("n1")).groupBy(DATE).agg(
        F.collect_list(F.struct("draw", _cell_start("_cell", "_cells").alias("_from"), (
            _cell_start("_cell + 1", "_cells") - _cell_start("_cell", "_cells")).alias("_width"), "_before")).alias("_edges"))
    again = known.join(F.broadcast(edge), DATE).select(
        DATE, "ticker", "_name", "avg_rank", "_pick", "n1", F.inline("_edges")).withColumn("_digest", digest)
    # A digest below the cell is a long way above it, modulo 32 bits: one comparison, as the filter makes a digest for each.
    behind = F.pmod(_first_bits("_digest") - F.col("_from"), F.lit(1 << 32))
    inside = again.where(behind < F.col("_width")).withColumn("_u", digest_number("_digest"))
    place = F.row_number().over(Window.partitionBy("draw", DATE).orderBy("_u", "ticker"))
    part = (inside.withColumn("_place", place).where(F.col("_before") + F.col("_place") <= F.col("n1"))
            .select("draw", DATE, F.col("avg_rank").alias("_ranks"), F.col("_pick").cast("bigint").alias("_picks")))
    real = base.where(F.col("label") == 1).select(
        F.lit(-1).alias("draw"), DATE, F.col("avg_rank").alias("_ranks"), F.col("_pick").cast("bigint").alias("_picks"))
    sums = (whole.unionByName(part).unionByName(real)
            .groupBy("draw", DATE).agg(F.sum("_ranks").alias("_ranks"), F.sum("_picks").alias("_picks")))
    every = dates.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    full = every.join(sums, ["draw", DATE], "left")
    neg = F.col("n") - F.col("n1")
    auc = F.when((F.col("n1") > 0) & (neg > 0),
                 (F.col("_ranks") - F.col("n1") * (F.col("n1") + 1) / 2) / F.nullif(F.col("n1") * neg, F.lit(0)))
    precision = F.when(F.col("n_picks") > 0, F.coalesce("_picks", F.lit(0)) / F.nullif(F.col("n_picks"), F.lit(0)))
    return full.groupBy("draw").agg(F.avg(auc).alias("mean_auc"), F.avg(precision).alias("precision"))


def permutation_test(draw_table: DataFrame) -> DataFrame:
    """Real statistics and their one-sided p-values ``(1 + #{null >= real}) / (1 + draws)``."""
    real = F.col("draw") < 0
    cols = ["mean_auc", "precision"]
    tagged = draw_table
    for c in cols:
        truth = F.max(F.when(real, F.col(c))).over(Window.partitionBy(F.lit(0)))
        tagged = tagged.withColumn(f"_real_{c}", truth)
    n = F.count_if(~real)
    return tagged.agg(
        n.alias("n_permutations"),
        *[F.max(f"_real_{c}").alias(f"real_{c}") for c in cols],
        *[((1 + F.count_if(~real & (F.round(c, 12) >= F.round(f"_real_{c}", 12)))) / (1 + n)).alias(f"p_{c}")
          for c in cols],
        *[F.avg(F.when(~real, F.col(c))).alias(f"null_{c}") for c in cols])


# ---- bootstraps --------------------------------------------------------------------------------

def _indexed(values: DataFrame, by, order: str, value: str) -> DataFrame:
    """Non-NULL values of each series with position and count. A series is one row per period."""
    w = Window.partitionBy(*by)
    return (values.where(F.col(value).isNotNull())
            .select(*by, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(order)) - 1).alias("_pos"),
                    F.count("*").over(w).alias("_n")))


def _resampled(indexed: DataFrame, by, index, draws: int) -> DataFrame:
    """Every position of every draw, with the value found at its drawn index."""
    slots = _draws(indexed.drop("_v"), draws).withColumn("_at", index)
    source = indexed.select(*by, F.col("_pos").alias("_at"), "_v")
    return slots.join(source, [*by, "_at"])


def _interval(c: str, alpha: float) -> list:
    return [F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.percentile(c, F.lit(alpha / 2)).alias(f"{c}_lo"),
            F.percentile(c, F.lit(1 - alpha / 2)).alias(f"{c}_hi")]


def bootstrap_mean(values: DataFrame, value: str, order: str, by=(), draws: int = 2000, alpha: float = 0.05,
                   seed: int = 0) -> DataFrame:
    """Median and interval of the mean under resampling with replacement."""
    by = list(by) or ["_all"]
    ix = _indexed(values.withColumn("_all", F.lit(1)), by, order, value)
    at = uniform_int(F.lit(seed), F.col("draw"), F.col("_pos")) % F.col("_n")
    means = _resampled(ix, by, at, draws).groupBy(*by, "draw").agg(F.avg("_v").alias("mean"))
    return means.groupBy(*by).agg(*_interval("mean", alpha)).drop("_all")


def block_bootstrap(returns: DataFrame, ret: str, order: str, by=(), periods: int = 12, draws: int = 2000,
                    alpha: float = 0.05, seed: int = 0, block: int | None = None) -> DataFrame:
    """Intervals of annualised return and Sharpe under a circular moving-block bootstrap.

    The default block is ``n ** (1/3)`` rounded (at least 2, and 1 for fewer than 4 periods);
    ``block=1`` is the plain bootstrap. Series with fewer than two periods come out NULL.
    """
    by = list(by) or ["_all"]
    ix = _indexed(returns.withColumn("_all", F.lit(1)), by, order, ret)
    rule = F.when(F.col("_n") < 4, 1).otherwise(F.greatest(
        F.lit(2), F.bround(F.pow(F.col("_n").cast("double"), F.lit(1.0 / 3.0))).cast("int")))
    size = rule if block is None else F.greatest(F.lit(1), F.least(F.lit(int(block)), F.col("_n")))
    ix = ix.withColumn("_size", size.cast("int"))
    start = uniform_int(F.lit(seed), F.col("draw"), F.floor(F.col("_pos") / F.col("_size"))) % F.col("_n")
    at = (start + F.col("_pos") % F.col("_size")) % F.col("_n")
    sample = _resampled(ix, by, at, draws)
    mean, std, n = F.avg("_v"), F.stddev_samp("_v"), F.count("*")
    per_draw = sample.groupBy(*by, "draw").agg(
        F.when(n >= 2, F.pow(growth("_v"), periods / n) - 1).alias("ann_return"),
        F.when(n >= 2, F.coalesce(mean / nonzero_std(std, mean) * math.sqrt(periods), F.lit(0.0))).alias("ann_sharpe"),
        F.max("_size").alias("_size"))
    return per_draw.groupBy(*by).agg(F.max("_size").alias("block_size"), *_interval("ann_return", alpha),
                                     *_interval("ann_sharpe", alpha)).drop("_all")


# ---- Sharpe statistics -------------------------------------------------------------------------

def sharpe_moments(returns: DataFrame, ret: str = "net", by=()) -> DataFrame:
    """Length, per-period Sharpe, skewness and (non-excess) kurtosis from population moments."""
    r = F.col(ret)
    mean, std = F.avg(r), F.stddev_samp(r)
    flat = F.col("_std").isNull() | (F.col("n") < 3)
    return (returns.groupBy(*by).agg(
        F.count(r).alias("n"), F.coalesce(mean / nonzero_std(std, mean), F.lit(0.0)).alias("sharpe"),
        nonzero_std(std, mean).alias("_std"), F.skewness(r).alias("_skew"), F.kurtosis(r).alias("_kurt"))
        .withColumn("skew", F.when(flat, 0.0).otherwise(F.col("_skew")))
        .withColumn("kurtosis", F.when(flat, 3.0).otherwise(F.col("_kurt") + 3))
        .drop("_std", "_skew", "_kurt"))


def with_psr(moments: DataFrame, benchmark="benchmark_sharpe") -> DataFrame:
    """``z`` and the probability that the true Sharpe exceeds the benchmark; NULL below 3 periods."""
    sr, k = F.col("sharpe"), F.col("kurtosis")
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * sr + (k - 1) / 4 * sr * sr))
    bench = F.col(benchmark) if isinstance(benchmark, str) else F.lit(float(benchmark))
    z = F.when(F.col("n") >= 3, (sr - bench) * F.sqrt(F.col("n") - 1) / spread)
    return moments.withColumn("z", z).withColumn("psr", normal_cdf(F.col("z")))


def with_expected_max(df: DataFrame, variance: str = "trial_variance", trials: str = "n_trials") -> DataFrame:
    """Expected best per-period Sharpe of ``trials`` tries without skill."""
    n, var = F.col(trials).cast("double"), F.col(variance)
    far = normal_quantile(F.when(n >= 2, 1 - 1 / F.nullif(n, F.lit(0.0))))
    farther = normal_quantile(F.when(n >= 2, 1 - 1 / (F.nullif(n, F.lit(0.0)) * math.e)))
    blend = (1 - EULER_MASCHERONI) * far + EULER_MASCHERONI * farther
    return df.withColumn("expected_max_sharpe", F.when((n >= 2) & (var > 0), F.sqrt(var) * blend).otherwise(0.0))


def deflated_sharpe(returns: DataFrame, trial_sharpes: DataFrame | None, trial_counts, ret: str = "net") -> DataFrame:
    """Probability that the true Sharpe beats the best of several tries, one row per assumed count.

    ``trial_sharpes`` has a ``sharpe`` column, one row per configuration tried; without at least
    two of them the variance is ``1 / (n - 1)``.
    """
    m = sharpe_moments(returns, ret)
    null_var = 1 / F.greatest(F.lit(1), F.col("n") - 1)
    if trial_sharpes is None:
        m = m.withColumn("trial_variance", null_var)
    else:
        var = trial_sharpes.agg(F.when(F.count("sharpe") >= 2, F.var_samp("sharpe"))).scalar()
        m = m.withColumn("trial_variance", F.coalesce(var, null_var))
    rungs = m.withColumn("n_trials", F.explode(F.array(*[F.lit(int(t)) for t in trial_counts])))
    out = with_psr(with_expected_max(rungs), "expected_max_sharpe")
    return out.select("n_trials", "n", F.col("sharpe").alias("sr"), "skew", "kurtosis", "trial_variance",
                      F.col("expected_max_sharpe").alias("sr0"), "z", F.col("psr").alias("dsr"))


# ---- sensitivity grid --------------------------------------------------------------------------

GRID_SIZES, GRID_COSTS = (3, 5, 10), (0.0, 0.001, 0.002)  # fixed values


def grid_weights(scores: DataFrame, sizes=GRID_SIZES) -> DataFrame:
    """Equal weights of every book size; all sizes come from one ranking to the largest."""
    best = selection.top_n(scores, max(sizes))
    sized = best.withColumn("top_n", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(
        F.col("pick_rank") <= F.col("top_n"))
    return selection.equal_weights(sized, ["top_n"])


def grid_returns(weights: DataFrame, returns: DataFrame, costs=GRID_COSTS) -> DataFrame:
    """Net returns of every (size, cost); gross returns and turnover are computed once per size."""
    base = selection.portfolio_returns(weights, returns, ["top_n"], 0.0)
    return base.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn(
        "net", F.col("gross") - F.col("turnover") * F.col("cost"))


# ---- random-selection null ---------------------------------------------------------------------

def random_picks(candidates: DataFrame, n: int = 3, draws: int = 500, seed: int = 0) -> DataFrame:
    """``n`` distinct candidates per (draw, date), uniformly at random (all, if fewer).

    Candidates are numbered once per date. A draw then needs only ``n`` positions (Floyd's sampling
    of distinct positions), so its cost does not depend on the number of candidates.
    """
    numbered = session.stage(ranks.hash_positions(candidates.select(DATE, "ticker"), [DATE]), "candidates")
    dates = numbered.groupBy(DATE).agg(F.max("n").alias("_n"))
    slots = _draws(dates.repartition(dates.sparkSession.sparkContext.defaultParallelism, DATE), draws)
    for j in range(n):
        top = F.col("_n") - n + j
        pick = uniform_int(F.lit(seed), F.col("draw"), F.col(DATE), F.lit(j)) % (top + 1)
        slots = slots.withColumn(f"_p{j}", F.when(top >= 0, F.when(
            F.array_contains(F.array(*[F.col(f"_p{i}") for i in range(j)]), pick), top).otherwise(pick))
            if j else F.when(top >= 0, pick))
    some = F.array(*[F.col(f"_p{j}") for j in range(n)])
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    chosen = F.when(F.col("_n") <= n, every).otherwise(some)
    wanted = slots.select("draw", DATE, F.explode(chosen).alias("position"))
    return wanted.join(numbered.select(DATE, "position", "ticker"), [DATE, "position"]).select("draw", DATE, "ticker")


def null_statistics(net_returns: DataFrame, by=("draw",), periods: int = 12, ret: str = "net") -> DataFrame:
    """Annualised return and Sharpe per draw; draws with fewer than two periods are left out."""
    mean, std, n = F.avg(ret), F.stddev_samp(ret), F.count(ret)
    return (net_returns.where(F.col(ret).isNotNull()).groupBy(*by).agg(
        n.alias("_n"), (F.pow(growth(ret), periods / n) - 1).alias("ann_return"),
        F.coalesce(mean / nonzero_std(std, mean) * math.sqrt(periods), F.lit(0.0)).alias("sharpe"))
        .where(F.col("_n") >= 2).drop("_n"))


def random_null(candidates: DataFrame, returns: DataFrame, n: int = 3, draws: int = 500, cost: float = 0.001,
                seed: int = 0, periods: int = 12) -> DataFrame:
    """Null distribution of "n names at random", costs and dates as in the real run. The returns of
    the universe are computed once and joined by all draws."""
    weights = session.stage(selection.equal_weights(random_picks(candidates, n, draws, seed), ["draw"]), "null_weights")
    return null_statistics(selection.portfolio_returns(weights, returns, ["draw"], cost), periods=periods)


def quantile_summary(values: DataFrame, columns) -> DataFrame:
    rows = values.select(F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value"))
                                            for c in columns])))
    return rows.groupBy("statistic").agg(
        F.count("value").alias("n"), F.percentile("value", F.lit(0.05)).alias("p5"),
        F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"),
        F.avg("value").alias("mean"))


def locate_in_null(null: DataFrame, real: DataFrame, columns) -> DataFrame:
    """Percentile of the real value among the draws and its one-sided p-value; both NULL without a real
    value or without draws. ``real`` is one row."""
    pair = lambda df, name: df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("statistic"), F.col(c).alias(name)) for c in columns])))
    both = pair(null, "value").join(F.broadcast(pair(real, "real")), "statistic")
    n = F.count("value")
    return both.groupBy("statistic").agg(
        F.max("real").alias("real"), n.alias("n"),
        (100 * F.avg((F.col("value") < F.col("real")).cast("double"))).alias("percentile"),
        F.when((n > 0) & F.max("real").isNotNull(),
               (F.count_if(F.col("value") >= F.col("real")) + 1) / (n + 1)).alias("p_value"))


def histogram(values: DataFrame, column: str, real: float | None = None, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value; empty bins are absent."""
    lo, hi = values.agg(F.min(column)).scalar(), values.agg(F.max(column)).scalar()
    v = F.col(column)
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = values.where(v.isNotNull()).select(v.alias("_v"), lo.alias("_lo"), hi.alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor(
        (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins))).otherwise(0)
    counts = rows.groupBy(b.cast("int").alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    out = counts.select("bin", (F.col("_lo") + F.col("bin") * width).alias("lower"),
                        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), "n")
    if real is None:
        return out
    return out.withColumn("holds_real", (F.col("lower") <= real) & (F.lit(real) < F.col("upper")))


def located_histogram(values: DataFrame, column: str, real: DataFrame, bins: int = 20) -> DataFrame:
    """``histogram`` with the real value (``real``: one row with ``column``) located in it: ``holds_real`` marks its bin, which is
    there even without draws. A value below all draws is in bin -1, one above them in bin ``bins``, both without draws."""
    known = values.where(F.col(column).isNotNull())
    ends = known.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    rows = known.select(F.col(column).alias("_v"), F.lit(0).alias("_real")).union(real.select(F.col(column), F.lit(1)).where(F.col(column).isNotNull()))
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    inner = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins))).otherwise(0)
    place = F.when(v < lo, -1).when(v > hi, bins).otherwise(inner).cast("int")
    counts = rows.join(F.broadcast(ends)).groupBy(place.alias("bin"), "_lo", "_hi").agg(
        F.sum(1 - F.col("_real")).cast("long").alias("n"), (F.max("_real") == 1).alias("holds_real"))
    width = (hi - lo) / bins
    return counts.select("bin", F.when(F.col("bin") >= 0, lo + F.col("bin") * width).alias("lower"),
                         F.when(F.col("bin") < bins, lo + (F.col("bin") + 1) * width).alias("upper"), "n", "holds_real")
