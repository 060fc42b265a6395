"""Reproducible random draws as column expressions.

A draw is the first 60 bits of the md5 of its coordinates, so the same (seed, draw, key) gives
the same number on any partitioning, after a retry, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BITS = 60


def draw_digest(*parts) -> Column:
    """The md5 that the number of the given coordinates comes from. Coordinates may be joined by ``|`` beforehand."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def digest_number(digest) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform_int(*parts) -> Column:
    """Uniform integer in ``[0, 2**60)`` from the given coordinates."""
    return digest_number(draw_digest(*parts))
