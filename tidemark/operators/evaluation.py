"""Quality of scores and predictions: ranking, information, calibration, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import session
from tidemark.functions.numeric import null_safe_join, safe_div
from tidemark.operators import asof, ranks
from tidemark.operators.selection import DATE, top_n

KEY = [DATE, "ticker"]


# ---- ranking -----------------------------------------------------------------------------------

def scored_labels(scores: DataFrame, labels: DataFrame) -> DataFrame:
    return scores.join(labels, KEY, "left")


def auc_by_date(scored: DataFrame, keys=(), score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney AUC per date from average ranks; NULL where only one class is present.

    ``scored`` is read several times: stage it first.
    """
    by = [*keys, DATE]
    rows = scored.where(F.col(label).isNotNull())
    return _auc(ranks.ranked(rows, by, score, ["ticker"]), by, label)


def _auc(ranked_rows: DataFrame, by, label: str) -> DataFrame:
    pos = F.sum(F.col(label).cast("double"))
    neg = F.count(label) - pos
    area = F.sum(F.when(F.col(label) == 1, F.col("avg_rank"))) - pos * (pos + 1) / 2
    return ranked_rows.groupBy(*by).agg(
        F.when((pos > 0) & (neg > 0), area / F.nullif(pos * neg, F.lit(0.0))).alias("auc"))


def precision_by_date(scored: DataFrame, n: int = 3, keys=()) -> DataFrame:
    """Share of label 1 among the labelled top-n picks."""
    picks = top_n(scored, n, keys)
    return (picks.where(F.col("label").isNotNull()).groupBy(*keys, DATE)
            .agg(F.avg(F.col("label").cast("double")).alias("precision")))


def ranking_metrics(scored: DataFrame, n: int = 3) -> DataFrame:
    """Precision@n, mean AUC, base rate and number of scored dates, as one row per figure."""
    figures = (
        precision_by_date(scored, n).agg(F.avg("precision").alias("value")).withColumn("metric", F.lit("precision_at_n"))
        .unionByName(auc_by_date(scored).agg(F.avg("auc").alias("value")).withColumn("metric", F.lit("mean_auc")))
        .unionByName(scored.agg(F.avg(F.col("label").cast("double")).alias("value")).withColumn("metric", F.lit("base_rate")))
        .unionByName(scored.agg(F.countDistinct(DATE).cast("double").alias("value")).withColumn("metric", F.lit("n_folds"))))
    return figures.select("metric", "value")


def win_rate(streams: DataFrame) -> DataFrame:
    both = F.col("net").isNotNull() & F.col("benchmark").isNotNull()
    return streams.where(both).agg(F.coalesce(
        F.avg((F.col("net") > F.col("benchmark")).cast("double")), F.lit(0.0)).alias("win_rate"))


def yearly_breakdown(streams: DataFrame) -> DataFrame:
    both = streams.where(F.col("net").isNotNull() & F.col("benchmark").isNotNull())
    return both.groupBy(F.year("entry_date").alias("year")).agg(
        (F.product(1 + F.col("net")) - 1).alias("strategy_return"),
        (F.product(1 + F.col("benchmark")) - 1).alias("benchmark_return"),
        F.count("*").alias("periods"),
        F.avg((F.col("net") > F.col("benchmark")).cast("double")).alias("win_rate"))


# ---- information coefficient and long-short ----------------------------------------------------

def holding_periods(scores: DataFrame) -> DataFrame:
    """Adjacent scored dates as periods; the last has no exit and is dropped."""
    dates = scores.select(F.col(DATE).alias("entry_date")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("entry_date")
    return dates.withColumn("exit_date", F.lead("entry_date").over(w)).where(F.col("exit_date").isNotNull())


def scored_returns(scores: DataFrame, bars: DataFrame, lag: int = 0, returns: DataFrame | None = None) -> DataFrame:
    """Scores with the return realised until the next scored date (NULL when there is none). ``returns``: what ``asof.period_returns`` gives
    for these periods, where known."""
    periods = holding_periods(scores)
    rets = (asof.period_returns(bars, periods, lag) if returns is None else returns).select(
        F.col("entry_date").alias(DATE), "ticker", "ret")
    inside = F.broadcast(periods.select(F.col("entry_date").alias(DATE)))
    return scores.join(inside, DATE).join(rets, KEY, "left")


def information_by_date(pairs: DataFrame) -> DataFrame:
    """Spearman correlation of score and return per date, for dates with at least three pairs and
    more than one distinct value on both sides. ``pairs`` is read several times: stage it first."""
    both = pairs.where(F.col("score").isNotNull() & F.col("ret").isNotNull())
    long = both.select(*KEY, F.inline(F.array(
        F.struct(F.lit("s").alias("_side"), F.col("score").alias("_value")),
        F.struct(F.lit("r").alias("_side"), F.col("ret").alias("_value")))))
    got = ranks.ranked(long, [DATE, "_side"], "_value", ["ticker"])
    side = lambda x: F.max(F.when(F.col("_side") == x, F.col("avg_rank"))).alias(x)
    wide = got.groupBy(*KEY).agg(side("s"), side("r"))
    spread = lambda x: F.max(x) > F.min(x)
    n = F.count("*")
    return wide.groupBy(DATE).agg(
        n.alias("n_pairs"),
        F.when((n >= 3) & spread("s") & spread("r"), F.corr("s", "r")).alias("ic"),
    ).where(F.col("ic").isNotNull())


def information_summary(by_date: DataFrame) -> DataFrame:
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    icir = F.when(std > 0, mean / F.nullif(std, F.lit(0.0)))
    return by_date.agg(mean.alias("mean_ic"), std.alias("ic_std"), icir.alias("icir"),
                       (icir * F.sqrt(n)).alias("ic_t_stat"), n.alias("n_periods"))


def long_short(pairs: DataFrame, quantile: float = 0.1) -> DataFrame:
    """Equal-weight return of the top share of scores minus that of the bottom share, per date.

    Dates on which no name has a return are left out. Equal scores are ordered by md5 of the ticker; only names tied with the score at an edge are
    ordered at all. ``pairs`` is read several times: stage it first.
    """
    scored = pairs.where(F.col("score").isNotNull())
    r = ranks.ranked(scored, [DATE], "score", ["ticker"]).where(F.col("n") >= 2)
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(quantile)))
    sides = F.array(
        F.struct(F.lit("long").alias("side"), (F.col("n") - F.col("below") - F.col("ties")).alias("before")),
        F.struct(F.lit("short").alias("side"), F.col("below").alias("before")))
    ends = (r.select(DATE, "ticker", "ret", "ties", k.alias("k"), F.inline(sides))
            .where(F.col("before") < F.col("k")))
    whole = ends.where(F.col("before") + F.col("ties") <= F.col("k"))
    edge = ranks.hash_positions(ends.where(F.col("before") + F.col("ties") > F.col("k")), [DATE, "side"])
    place = F.when(F.col("side") == "long", F.col("position")).otherwise(F.col("n") - 1 - F.col("position"))
    part = edge.where(F.col("before") + place < F.col("k"))
    cols = [DATE, "side", "ticker", "ret"]
    leg = lambda side: F.coalesce(F.avg(F.when(F.col("side") == side, F.col("ret"))), F.lit(0.0))
    legs = whole.select(cols).unionByName(part.select(cols)).groupBy(DATE).agg(
        leg("long").alias("long_ret"), leg("short").alias("short_ret"))
    returns = pairs.where(F.col("ret").isNotNull()).select(DATE).distinct()
    return legs.join(returns, DATE, "left_semi").withColumn("spread", F.col("long_ret") - F.col("short_ret"))


# ---- direction predictions ---------------------------------------------------------------------

COVERAGES = (1.0, 0.8, 0.6, 0.4, 0.2)


def prediction_summary(predictions: DataFrame, by=()) -> DataFrame:
    """Accuracy, base rate, edge, up rate and Brier score per group."""
    p, a = F.col("prob_up"), F.col("actual").cast("double")
    hit = ((p >= 0.5).cast("int") == F.col("actual")).cast("double")
    share = F.avg(a)
    return (predictions.groupBy(*by).agg(
        F.count("*").alias("n_predictions"), F.countDistinct("ticker").alias("n_stocks"), F.avg(hit).alias("accuracy"),
        F.greatest(share, 1 - share).alias("base_rate"), F.avg((p >= 0.5).cast("double")).alias("up_rate"),
        F.avg((p - a) * (p - a)).alias("brier"))
        .withColumn("edge", F.col("accuracy") - F.col("base_rate")))


def reliability(predictions: DataFrame, by=(), bins: int = 10) -> DataFrame:
    """Mean prediction and realised share per probability bin, left-closed on the exact edges
    ``i * (1 / bins)``, with 1.0 in the last bin; empty bins are absent."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    b = sum((F.when(F.col("prob_up") >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return (predictions.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("prob_up").alias("mean_pred"),
        F.avg(F.col("actual").cast("double")).alias("frac_up")))


def calibration_error(predictions: DataFrame, by=(), bins: int = 10) -> DataFrame:
    table = reliability(predictions, by, bins)
    gap = F.col("n") * F.abs(F.col("mean_pred") - F.col("frac_up"))
    return table.groupBy(*by).agg(safe_div(F.sum(gap), F.sum("n")).alias("ece"))


def _by_probability(predictions: DataFrame, by) -> DataFrame:
    """Counts per distinct probability. Predictions fold on the map side; what is left is one row
    per distinct value, the unit all pooled orderings below work on."""
    return predictions.groupBy(*by, "prob_up").agg(
        F.sum(F.col("actual").cast("bigint")).alias("up"), F.count("*").alias("n"))


def _running_before(df: DataFrame, by, order: str, counts: list[str]) -> DataFrame:
    """Totals of ``counts`` over all rows with a smaller ``order``, per group; ``order`` is unique in a group, and rows
    without one are left out. No group is sorted in one task: Spark cuts the rows into ranges at cut points that it
    samples, so ranges are even however the values bunch. Totals run inside ranges first, then over the ranges' totals."""
    by = list(by)
    cut = df.where(F.col(order).isNotNull()).repartitionByRange(*by, order).withColumn("_cell", F.spark_partition_id())
    df = session.stage(cut, "ranges")  # a range is what a task wrote
    w_cell = Window.partitionBy(*by, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w_ranges = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    cells = cells.select(*by, "_cell", *[F.coalesce(F.sum(f"_t_{c}").over(w_ranges), F.lit(0)).alias(f"_b_{c}")
                                         for c in counts])
    inner = df.select("*", *[F.coalesce(F.sum(c).over(w_cell), F.lit(0)).alias(f"_i_{c}") for c in counts])
    out = null_safe_join(inner, cells, [*by, "_cell"])
    return out.select(*[c for c in df.columns if c != "_cell"],
                      *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"before_{c}") for c in counts])


def pooled_auc(predictions: DataFrame, by=()) -> DataFrame:
    """AUC over all predictions of a group; NULL when only one class occurs."""
    by = list(by)
    v = _by_probability(predictions, by).withColumn("down", F.col("n") - F.col("up"))
    v = _running_before(v, by, "prob_up", ["down"])
    ups, downs = F.sum("up").cast("double"), F.sum("down").cast("double")
    area = F.sum(F.col("up") * (F.col("before_down") + F.col("down") / F.lit(2.0)))
    return v.groupBy(*by).agg(F.when((ups > 0) & (downs > 0), area / F.nullif(ups * downs, F.lit(0.0))).alias("auc"))


def selective_accuracy(predictions: DataFrame, by=(), coverages=COVERAGES) -> DataFrame:
    """Accuracy when only the most confident share of predictions is kept.

    The kept number is ``max(1, round(n * coverage))``. Whole confidence levels are added up; in
    the one level a cut falls into, predictions are taken in md5 order of (ticker, date).
    """
    by = list(by) or ["_all"]
    rows = predictions.withColumn("_all", F.lit(1)).withColumn(
        "confidence", F.abs(F.col("prob_up") - 0.5)).withColumn(
        "hit", ((F.col("prob_up") >= 0.5).cast("int") == F.col("actual")).cast("bigint"))
    share = F.avg(F.col("actual").cast("double"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"), F.greatest(share, 1 - share).alias("base_rate"))
    keep = lambda c: F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(c)).cast("bigint"))
    # Staged, so that the key is a column even where it is a constant, and joins stay hash joins.
    cuts = session.stage(totals.select(*by, "base_rate", F.inline(F.array(*[
        F.struct(F.lit(float(c)).alias("coverage"), keep(float(c)).alias("keep")) for c in coverages]))), "cuts")
    levels = (rows.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
              .withColumn("_doubt", -F.col("confidence")))
    levels = session.stage(_running_before(levels, by, "_doubt", ["n", "hits"]), "levels")
    edge = levels.join(cuts, by).where(
        (F.col("before_n") < F.col("keep")) & (F.col("before_n") + F.col("n") >= F.col("keep"))
    ).withColumn("take", F.col("keep") - F.col("before_n"))
    edge = session.stage(edge, "edge")
    split = edge.where(F.col("take") < F.col("n")).select(*by, "confidence", "coverage", "take")
    tied = rows.join(split, [*by, "confidence"]).withColumn(
        "_name", F.concat_ws("|", "ticker", F.col("date").cast("string")))
    part = (ranks.hash_positions(tied.select(*by, "coverage", "take", "hit", "_name"), [*by, "coverage"], "_name")
            .where(F.col("position") < F.col("take"))
            .groupBy(*by, "coverage").agg(F.sum("hit").alias("_part")))
    taken = F.when(F.col("take") == F.col("n"), F.col("hits")).otherwise(F.col("_part"))
    accuracy = (F.col("before_hits") + taken) / F.col("keep")
    return edge.join(part, [*by, "coverage"], "left").select(
        *[c for c in by if c != "_all"], "coverage", F.col("keep").alias("n"), accuracy.alias("accuracy"),
        (accuracy - F.col("base_rate")).alias("edge_vs_base"))
