"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """NULL on a zero or missing denominator (plain ``/`` raises under ANSI)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def to_number(c) -> Column:
    """Double from any column; text that is no number, and "nan", become NULL."""
    return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))


def sign_of(cond_up, cond_down, size=1) -> Column:
    """``+size`` / ``-size`` / 0; an unknown comparison counts as 0."""
    return F.when(cond_up, size).when(cond_down, -size).otherwise(0)


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Round every double column, for results that are compared or printed."""
    return df.select([
        F.round(c.name, overrides.get(c.name, digits)).alias(c.name)
        if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
        for c in df.schema.fields
    ])


def null_safe_join(left: DataFrame, right: DataFrame, by, how: str = "inner") -> DataFrame:
    """An equi-join on ``by`` in which NULL equals NULL, so that the rows of a NULL group stay."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in by])


def full_window(value: Column, seen: Column, size: int) -> Column:
    """A trailing statistic is undefined until its window holds ``size`` values."""
    return F.when(seen == size, value)
