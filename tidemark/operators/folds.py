"""What every walk-forward fold trains on, for all folds at once.

A fold trains on dates that follow each other, so its rows are an interval of the calendar. Counts over intervals are
differences of running totals: one grouped pass over the rows gives a total per date, and however many folds there are and
however much they overlap, each takes two lookups. Exact medians come from value counts per date, which add up over
the dates of a fold. Nothing is joined row by row with the folds, and no fold runs a job of its own. Tables of one row
per date, fold or (fold, feature) are bounded by the calendar and broadcast.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import session
from tidemark.operators import ranks
from tidemark.operators.selection import DATE

#: Slices per feature that medians are looked for in, and the share of (date, value) that cut points are read off.
SLICES, SAMPLE_ONE_IN = 128, 16


def fold_bounds(dates: DataFrame, horizon_months: int = 1, train_window: int | None = 12, min_train_dates: int = 3) -> DataFrame:
    """(rebalance_date, train_start, train_end, n_dates) of each fold that has training dates.

    The fold at t trains on the last ``train_window`` dates before t (None: on all of them). A label of more than one
    month is known ``horizon_months`` after its date, so dates with d + horizon > t drop out. Months keep the order of dates, so
    what is known at t is a beginning of the calendar, and one sweep over dates and days of release counts it.
    """
    days = dates.select(DATE).distinct()
    numbered = days.select(F.col(DATE).alias("day"), (F.row_number().over(Window.orderBy(DATE)) - 1).alias("k"))
    if horizon_months > 1:
        sweep = (numbered.select(F.add_months("day", horizon_months).alias("at"), F.lit(0).alias("asks"), "day", "k")
                 .union(numbered.select("day", F.lit(1), "day", "k")))
        known = F.sum(1 - F.col("asks")).over(Window.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
        numbered = sweep.withColumn("known", known).where("asks = 1").select("day", "k", F.least("k", "known").alias("stop"))
    else:
        numbered = numbered.withColumn("stop", F.col("k"))
    start = F.lit(0) if train_window is None else F.greatest(F.lit(0), F.col("k") - train_window)
    spans = numbered.where(F.col("k") >= min_train_dates).select(
        F.col("day").alias(DATE), start.alias("first"), (F.col("stop") - 1).alias("last")).where("last >= first")
    place = numbered.select("k", "day")
    return (spans.join(F.broadcast(place.withColumnsRenamed({"k": "first", "day": "train_start"})), "first")
            .join(F.broadcast(place.withColumnsRenamed({"k": "last", "day": "train_end"})), "last")
            .select(DATE, "train_start", "train_end", (F.col("last") - F.col("first") + 1).cast("long").alias("n_dates")))


def over_spans(bounds: DataFrame, per_date: DataFrame, sums: list[str]) -> DataFrame:
    """``bounds`` (train_start, train_end, both dates of ``per_date``) with the sums of whole numbers between them."""
    upto = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    totals = per_date.select(DATE, *sums, *[F.sum(c).over(upto).alias(f"_upto_{c}") for c in sums])
    end = totals.select(F.col(DATE).alias("train_end"), *[f"_upto_{c}" for c in sums])
    begin = totals.select(F.col(DATE).alias("train_start"), *[(F.col(f"_upto_{c}") - F.col(c)).alias(f"_before_{c}") for c in sums])
    return bounds.join(F.broadcast(end), "train_end").join(F.broadcast(begin), "train_start").select(
        *bounds.columns, *[(F.col(f"_upto_{c}") - F.col(f"_before_{c}")).alias(c) for c in sums])


def members(bounds: DataFrame, dates: DataFrame) -> DataFrame:
    """(fold, rebalance_date): the dates that each fold trains on; one row per pair of dates."""
    days = dates.select(DATE).distinct()
    pairs = bounds.select(F.col(DATE).alias("fold"), "train_start", "train_end").join(
        F.broadcast(days), F.col(DATE).between(F.col("train_start"), F.col("train_end")))
    return pairs.select("fold", DATE)


def _long(labelled: DataFrame, features: list[str]) -> DataFrame:
    return labelled.select(DATE, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("c")).select(DATE, "c.*")


def _medians(sliced: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fold, feature, median) of the values (rebalance_date, feature, value, n: how often, slice) on the dates of each fold (``pairs``). Slices are
    in the order of their values. Only the values of slices that hold a median are gathered."""
    per_slice = (sliced.groupBy(DATE, "feature", "slice").agg(F.sum("n").alias("n")).join(pairs, DATE)
                 .groupBy("fold", "feature", "slice").agg(F.sum("n").alias("n")))
    inside = Window.partitionBy("fold", "feature")
    run = inside.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    held = per_slice.select("fold", "feature", "slice", "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(inside).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    wanted = held.where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high)).select(
        "fold", "feature", "slice", "total", (F.col("upto") - F.col("n")).alias("before"))
    wanted = F.broadcast(session.stage(F.broadcast(wanted).join(pairs, "fold"), "median-slices"))

    # Values are counted per date before they go to the folds of that date.
    near = sliced.join(F.broadcast(wanted.select(DATE, "feature", "slice").distinct()), [DATE, "feature", "slice"], "left_semi").groupBy(
        DATE, "feature", "slice", "value").agg(F.sum("n").alias("n"))
    chosen = (wanted.join(near, [DATE, "feature", "slice"])
              .groupBy("fold", "feature", "slice", "before", "total", "value").agg(F.sum("n").alias("n")))
    within = Window.partitionBy("fold", "feature", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = chosen.withColumn("upto", F.col("before") + F.sum("n").over(within))
    return placed.groupBy("fold", "feature").agg(
        ((F.min(F.when(F.col("upto") > low, F.col("value"))) + F.min(F.when(F.col("upto") > high, F.col("value")))) / 2).alias("median"))


def fold_medians(cells: DataFrame, features: list[str], bounds: DataFrame, slices: int = SLICES, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """(rebalance_date, feature, median): the exact medians of ``fold_statistics`` alone. The cells are read for counts per (date, slice), and again for
    the values of the slices that hold a median: what is shuffled is bounded by the calendar, but for these. A feature without any known
    value in a fold has no row."""
    labelled = cells.where(F.col("label").isNotNull())
    pairs = F.broadcast(session.stage(members(bounds, labelled), "fold-members"))
    known = _long(labelled, features).where("value is not null")
    share = [k / slices for k in range(1, slices)]
    sample = known.where(F.pmod(F.xxhash64(DATE, "value"), F.lit(one_in)) == 0)
    cuts = session.stage(sample.groupBy("feature").agg(F.percentile_approx("value", share, 10_000).alias("_cuts")), "value-cuts")
    sliced = ranks._with_slice(known.join(F.broadcast(cuts), "feature", "left"), "value", slices)
    return _medians(sliced.select(DATE, "feature", "value", F.lit(1).alias("n"), F.col("_slice").alias("slice")), pairs).withColumnRenamed("fold", DATE)


def fold_statistics(cells: DataFrame, features: list[str], bounds: DataFrame, slices: int = SLICES) -> DataFrame:
    """(rebalance_date, feature, n_rows, n_known, median, mean, std) of the labelled ``cells`` that each fold trains on: the exact median of the
    known values, and mean and population deviation once missing values are that median.

    Values are counted per date and cut into slices at any cut points. Counts per (date, slice) add up to those of a fold, which tell
    the slice that holds its median; only the values of that slice are gathered. Deviations add up by date, too.
    A feature without any known value has NULL statistics.
    """
    labelled = cells.where(F.col("label").isNotNull())
    long = _long(labelled, features)
    counts = session.stage(long.groupBy(DATE, "feature", "value").agg(F.count("*").alias("n")), "value-counts")
    pairs = F.broadcast(session.stage(members(bounds, labelled), "fold-members"))

    known = counts.where("value is not null")
    share = [k / slices for k in range(1, slices)]
    cuts = F.broadcast(session.stage(known.groupBy("feature").agg(F.percentile_approx("value", share, 10_000).alias("cuts")), "value-cuts"))
    sliced = known.join(cuts, "feature").select(DATE, "feature", "value", "n", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("slice"))
    sliced = session.stage(sliced, "sliced-counts")
    medians = _medians(sliced, pairs)

    mean = F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    by_date = counts.join(counts.groupBy(DATE, "feature").agg(mean.alias("m")), [DATE, "feature"]).groupBy(DATE, "feature").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_known"),
        F.first("m").alias("m"), F.sum((F.col("value") - F.col("m")) * (F.col("value") - F.col("m")) * F.col("n")).alias("m2"))
    by_date = session.stage(by_date, "moments")
    folded = by_date.join(pairs, DATE).groupBy("fold", "feature").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_known").alias("n_known"), F.sum(F.col("m") * F.col("n_known")).alias("s"),
        F.collect_list(F.struct("n_known", "m", "m2")).alias("dates"))
    all_ = folded.join(medians, ["fold", "feature"], "left").withColumn("gaps", F.col("n_rows") - F.col("n_known"))
    whole = (F.coalesce("s", F.lit(0.0)) + F.col("gaps") * F.col("median")) / F.col("n_rows")
    spread = F.aggregate("dates", F.lit(0.0), lambda total, d: total + F.coalesce(
        d["m2"] + d["n_known"] * (d["m"] - F.col("mean")) * (d["m"] - F.col("mean")), F.lit(0.0)))
    return all_.withColumn("mean", whole).select(
        F.col("fold").alias(DATE), "feature", "n_rows", "n_known", "median", "mean",
        F.sqrt((spread + F.col("gaps") * (F.col("median") - F.col("mean")) * (F.col("median") - F.col("mean"))) / F.col("n_rows")).alias("std"))


def column_medians(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians of a single training set."""
    day = F.lit("2000-01-01").cast("date")
    cells = rows.select(day.alias(DATE), "label", *features)
    one = rows.sparkSession.range(1).select(day.alias(DATE), day.alias("train_start"), day.alias("train_end"))
    return {r["feature"]: r["median"] for r in fold_statistics(cells, features, one).collect()}


# ---- pooled panels -----------------------------------------------------------------------------

def embargo_days(horizon: int) -> int:
    return math.ceil(horizon * 1.5)


def pooled_spans(panel: DataFrame, dates: DataFrame, features: list[str], horizon: int = 5, years: int = 3) -> DataFrame:
    """What the model of each prediction date (``dates``: date) trains on: rows of all tickers from train_start = date - 365 * years to
    train_end = date - 1.5 * horizon, both included.

    (date, train_start, train_end, n_rows, n_incomplete: a feature is NULL, n_unlabelled, n_train: neither, n_positive, n_tickers with a
    training row.) Windows overlap almost whole, so counts come from running totals per day. A ticker is in a window if
    its last training row up to train_end is not before train_start: each row answers for the ends from its own day
    to its successor's, at most the window's length, so tickers are counted by +1 and -1 per day, too.
    """
    gap, length = embargo_days(horizon), int(365 * years) - embargo_days(horizon)
    incomplete = functools.reduce(operator.or_, [F.col(f).isNull() for f in features])
    rows = panel.select("ticker", "date", F.col("label").alias("label"), incomplete.alias("incomplete"))
    trains = ~F.col("incomplete") & F.col("label").isNotNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per_day = rows.groupBy(F.col("date").alias("day")).agg(
        F.count("*").alias("n_rows"), one(F.col("incomplete")).alias("n_incomplete"), one(F.col("label").isNull()).alias("n_unlabelled"),
        one(trains).alias("n_train"), one(trains & (F.col("label") == 1)).alias("n_positive"))
    following = F.lead("date").over(Window.partitionBy("ticker").orderBy("date"))
    kept = rows.where(trains).select("date", F.least(following, F.date_add("date", length + 1)).alias("stop"))
    moves = kept.select(F.explode(F.array(F.struct(F.col("date").alias("day"), F.lit(1).alias("n")),
                                          F.struct(F.col("stop").alias("day"), F.lit(-1).alias("n")))).alias("m"))
    moves = moves.groupBy(F.col("m.day").alias("day")).agg(F.sum("m.n").alias("n_tickers"))

    sums = ["n_rows", "n_incomplete", "n_unlabelled", "n_train", "n_positive"]
    ends = rows.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    totals = days.join(per_day, "day", "left").join(moves, "day", "left").select("day", *[
        F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in [*sums, "n_tickers"]])
    totals = session.stage(totals, "day-totals")  # one row per day of the calendar
    asked = dates.select("date", F.date_sub("date", int(365 * years)).alias("train_start"), F.date_sub("date", gap).alias("train_end"))
    end = totals.select(F.col("day").alias("train_end"), *sums, "n_tickers")
    begin = totals.select(F.date_add("day", 1).alias("train_start"), *[F.col(c).alias(f"_before_{c}") for c in sums])
    return (asked.join(F.broadcast(end), "train_end", "left").join(F.broadcast(begin), "train_start", "left")
            .select("date", "train_start", "train_end", *[
                (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_before_{c}"), F.lit(0))).cast("long").alias(c) for c in sums],
                F.coalesce("n_tickers", F.lit(0)).cast("long").alias("n_tickers")))
