"""Normal distribution function and quantile as column expressions. Spark has no erf, so the distribution
function is its series ``1/2 + density * (z + z^3/3 + z^5/(3*5) + ...)``, all of whose terms have one sign.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Beyond so many deviations the tail is below the resolution of a double near 1.
FAR, TERMS, HALVINGS = 8.5, 160, 60


def _cdf(z: Column) -> Column:
    """For a Column without NULLs; terms fall below 1e-17 within TERMS steps for any |z| up to FAR."""
    z = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), z))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct(z.alias("z"), z.alias("term"), z.alias("total"))
    grown = F.aggregate(steps, start, lambda acc, k: F.struct(
        acc["z"].alias("z"), (acc["term"] * acc["z"] * acc["z"] / (2 * k + 1)).alias("term"),
        (acc["total"] + acc["term"] * acc["z"] * acc["z"] / (2 * k + 1)).alias("total")))
    return 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * grown["total"]


def normal_cdf(z: Column) -> Column:
    return F.when(z.isNotNull(), _cdf(F.coalesce(z, F.lit(0.0))))


def normal_quantile(p: Column) -> Column:
    """By halving the interval that holds it; NULL unless 0 < p < 1."""
    inside = F.coalesce((p > 0) & (p < 1), F.lit(False))
    p = F.when(inside, p).otherwise(0.5)
    start = F.struct(p.alias("p"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        below = _cdf(mid) < acc["p"]
        return F.struct(acc["p"].alias("p"), F.when(below, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)
    return F.when(inside, (found["lo"] + found["hi"]) / 2)
