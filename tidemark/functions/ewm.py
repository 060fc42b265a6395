"""Exponentially weighted means (``adjust=False``) with window functions only.

``y[i] = (1-a) y[i-1] + a x[i]`` unrolls to a running sum of ``x[j] (1-a)^-j`` times ``(1-a)^i``.
That sum overflows on long histories, so a ticker's rows are cut into blocks; each block adds the
decayed end value of the block before it. Blocks are long enough that anything older weighs less
than 1e-16.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Ewm:
    """``out`` = ewm of ``source``; undefined before ``min_periods`` values; ``gaps`` when the
    source may start with NULLs (it may never have NULLs in the middle)."""

    out: str
    source: str
    alpha: float
    min_periods: int = 0
    gaps: bool = False


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def block_length(alphas) -> int:
    rows = math.ceil(40.0 / -math.log1p(-min(alphas)))
    if rows * -math.log1p(-max(alphas)) > 650.0:
        raise ValueError("smoothing factors too far apart for one block length; add them in two calls")
    return rows


def with_blocks(df: DataFrame, rows: int) -> DataFrame:
    """Row index, block number and position in the block, per ticker by date."""
    i = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    return (df.withColumn("_i", i)
            .withColumn("_block", F.floor(F.col("_i") / rows).cast("int"))
            .withColumn("_j", (F.col("_i") % rows).cast("int")))


def smooth(df: DataFrame, specs: list[Ewm]) -> DataFrame:
    """Add all ``specs`` to a frame from :func:`with_blocks`. Every window here sorts by
    (ticker, block, date), so the frame is sorted once."""
    w_block = (Window.partitionBy("ticker", "_block").orderBy("date")
               .rowsBetween(Window.unboundedPreceding, 0))
    running = (Window.partitionBy("ticker").orderBy("_block", "date")
               .rowsBetween(Window.unboundedPreceding, 0))

    def seen(s: Ewm) -> Column:
        return F.col(f"_seen_{s.out}") if s.gaps else F.col("_i") + 1

    counted = df.select("*", *[F.count(s.source).over(running).alias(f"_seen_{s.out}")
                               for s in specs if s.gaps])
    terms = counted.select("*", *[
        (F.when(seen(s) == 1, 1.0).otherwise(s.alpha) * F.col(s.source)
         * F.pow(F.lit(1.0 - s.alpha), -F.col("_j"))).alias(f"_term_{s.out}") for s in specs])
    local = terms.select("*", *[
        (F.pow(F.lit(1.0 - s.alpha), F.col("_j")) * F.sum(f"_term_{s.out}").over(w_block)).alias(f"_local_{s.out}")
        for s in specs])
    earlier = (Window.partitionBy("ticker").orderBy("_block")
               .rangeBetween(Window.unboundedPreceding, -1))
    carried = local.select("*", *[
        F.coalesce(F.max_by(f"_local_{s.out}", "_i").over(earlier), F.lit(0.0)).alias(f"_carry_{s.out}")
        for s in specs])

    def value(s: Ewm) -> Column:
        y = (F.coalesce(F.col(f"_local_{s.out}"), F.lit(0.0))
             + F.pow(F.lit(1.0 - s.alpha), F.col("_j") + 1) * F.col(f"_carry_{s.out}"))
        return F.when(seen(s) >= max(1, s.min_periods), y).alias(s.out)

    return carried.select(*df.columns, *[value(s) for s in specs])
