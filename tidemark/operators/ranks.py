"""Exact ranks inside very large groups.

A cross-section (all tickers on one date) grows with the universe, so it may not be sorted in one
task. Ranks are therefore built from slices of the value range:

1. cut points per group, read off a small keyed sample. They only decide how the work is split;
   any cut points give the same ranks.
2. count rows per slice, and turn the counts into offsets.
3. rank inside each slice, add the slice's offset.

A value equal to a cut point gets a slice of its own. A value held by a large share of a group is
always a cut point, so ties cannot make a slice hot: rows of such a slice need no ordering and are
spread over salts.

Cut points and offsets have one row per group (and slice); groups are dates, or dates x features x
sectors, so they grow with the calendar and not with the rows. Both are staged: every later step
reads the same cut points, and Spark sees the tables' real size, broadcasts them below its
threshold and joins by shuffle above it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import session
from tidemark.functions.numeric import null_safe_join

SAMPLE_ONE_IN = 4096
SLICES = 64
SALTS = 256
#: Ranked rows of a task. They shuffle to some 15 bytes but take some 450 in its sorts and windows, so partitions sized by bytes would be too large.
TASK_ROWS = 500_000


def _probabilities(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _cut_points(df: DataFrame, by: list[str], value: str, key: list[str], one_in: int, slices: int) -> DataFrame:
    sample = df.where(F.col(value).isNotNull()
                      & (F.pmod(F.xxhash64(F.lit(17), *key), F.lit(one_in)) == 0))
    points = F.percentile(F.col(value), F.array(*[F.lit(p) for p in _probabilities(slices)]))
    return sample.groupBy(*by).agg(F.array_distinct(points).alias("_cuts"))


def _with_slice(df: DataFrame, value: str, slices: int) -> DataFrame:
    """``_slice`` in place of ``_cuts``: even numbers are open intervals between cut points, odd ones are the cut points. The number
    of cut points below a value is found by halving, a column a step: a few comparisons a row, not one per cut point."""
    df, step = df.withColumn("_below", F.lit(0)), 1 << max(0, (slices - 1).bit_length() - 1)
    while step:
        at = F.col("_below") + step
        df = df.withColumn("_below", F.when(F.get("_cuts", at - 1) < F.col(value), at).otherwise(F.col("_below")))
        step //= 2
    equal = F.coalesce((F.get("_cuts", F.col("_below")) == F.col(value)).cast("int"), F.lit(0))
    return df.withColumn("_slice", 2 * F.col("_below") + equal).drop("_below", "_cuts")


def _tasks(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: one per ``TASK_ROWS``, and for small tables up to one per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(rows / TASK_ROWS), min(cores, 10 * rows // TASK_ROWS))


def ranked(df: DataFrame, by, value: str, key, one_in: int = SAMPLE_ONE_IN, slices: int = SLICES) -> DataFrame:
    """Add, per group ``by``: ``n`` (non-NULL values), ``below`` (values smaller than this one),
    ``ties`` (values equal to it) and ``avg_rank`` (1-based, ties averaged). Rows whose value is
    NULL are left out. ``df`` is read several times: stage it when it is expensive.
    """
    by, key = list(by), list(key)
    cuts = session.stage(_cut_points(df, by, value, key, one_in, slices), "cuts")
    sliced = _with_slice(null_safe_join(df.where(F.col(value).isNotNull()), cuts, by, "left"), value, slices)
    w_group = Window.partitionBy(*by)
    offsets = (
        sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_held"))
        .withColumn("n", F.sum("_held").over(w_group))
        .withColumn("_before", F.sum("_held").over(
            w_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    )
    offsets = session.stage(offsets, "offsets")
    tasks = _tasks(df, offsets.agg(F.coalesce(F.sum("_held"), F.lit(0))).first()[0])
    rows = null_safe_join(sliced, offsets, [*by, "_slice"])
    is_point = F.col("_slice") % 2 == 1
    salt = F.when(is_point, F.pmod(F.xxhash64(*key), F.lit(SALTS))).otherwise(0)
    rows = rows.withColumn("_salt", salt).repartition(tasks, *by, "_slice", "_salt")
    w_slice = Window.partitionBy(*by, "_slice", "_salt")
    inner = F.rank().over(w_slice.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, "_slice", "_salt", value))
    return (
        rows
        .withColumn("_inner", inner).withColumn("_equal", equal)
        .withColumn("below", F.coalesce("_before", F.lit(0))
                    + F.when(is_point, F.lit(0)).otherwise(F.col("_inner")))
        .withColumn("ties", F.when(is_point, F.col("_held")).otherwise(F.col("_equal")))
        .withColumn("avg_rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0))
        .drop("_slice", "_salt", "_held", "_before", "_inner", "_equal")
    )


def ranked_in_history(df: DataFrame, by, value: str) -> DataFrame:
    """The same columns by plain windows, for groups bounded by the calendar (one ticker's rows)."""
    by = list(by)
    shown = df.where(F.col(value).isNotNull())
    return (
        shown.withColumn("n", F.count("*").over(Window.partitionBy(*by)))
        .withColumn("below", (F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1).cast("bigint"))
        .withColumn("ties", F.count("*").over(Window.partitionBy(*by, value)))
        .withColumn("avg_rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0))
    )


HASH_CELLS = 4096


def hash_positions(df: DataFrame, by, key: str = "ticker") -> DataFrame:
    """Add ``position`` (0-based) of each row in md5 order of ``key`` inside its group, and ``n``.

    An order that is arbitrary but fixed, for numbering candidates and for breaking ties. The md5
    is uniform, so its first three digits split any group evenly: rows are ordered inside such a
    cell, and cells are added up. ``key`` is unique inside a group.
    """
    by = list(by)
    cell = F.conv(F.substring("_md5", 1, 3), 16, 10).cast("int")
    rows = df.withColumn("_md5", F.md5(F.col(key))).withColumn("_cell", cell)
    w_group = Window.partitionBy(*by)
    cells = (rows.groupBy(*by, "_cell").agg(F.count("*").alias("_held"))
             .withColumn("n", F.sum("_held").over(w_group))
             .withColumn("_before", F.coalesce(F.sum("_held").over(
                 w_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .drop("_held"))
    inner = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_md5", key)) - 1
    return (null_safe_join(rows.withColumn("_inner", inner), cells, [*by, "_cell"])
            .withColumn("position", F.col("_before") + F.col("_inner"))
            .drop("_md5", "_cell", "_inner", "_before"))


def at_position(ranked_rows: DataFrame, by, value: str, position: Column) -> Column:
    """Aggregate expression: the value at the 0-based ``position`` of the sorted group."""
    inside = (F.col("below") <= position) & (position < F.col("below") + F.col("ties"))
    return F.max(F.when(inside, F.col(value)))


def group_quantiles(ranked_rows: DataFrame, by, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, from ranks (no group is collected)."""
    aggs = []
    for name, q in quantiles.items():
        spot = (F.col("n") - 1) * F.lit(float(q))
        aggs += [at_position(ranked_rows, by, value, F.floor(spot)).alias(f"_lo_{name}"),
                 at_position(ranked_rows, by, value, F.ceil(spot)).alias(f"_hi_{name}"),
                 F.max(spot - F.floor(spot)).alias(f"_f_{name}")]
    got = ranked_rows.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    return got.select(*by, "n", *[
        (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_f_{m}")).alias(m)
        for m in quantiles])
