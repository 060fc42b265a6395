"""What the text operators share: reading, scanning rows in Python, checked broadcasts, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import stage

#: Rows handed to a Python function at once; texts are long, so an Arrow batch is cut.
ROWS_AT_ONCE = 256
#: A table of ids is broadcast only if it holds at most so many rows (16 bytes each).
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def ascii_lowered(text: str) -> str:
    return text.translate(_LOWERED)


def scan(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Apply ``fn`` to the columns of ``df`` as Python lists, ``rows`` rows at a time. ``fn`` returns
    the output columns; their length is free. Nothing is kept from one call to the next."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def rewrite(df: DataFrame, column: str, fn: Callable[[list], tuple[list | None, list[bool] | None]]) -> DataFrame:
    """``df`` with the values of ``column`` replaced, or with some rows only: ``fn`` gets values of the column and
    returns new ones (None: as they are) and which rows stay (None: all). Other columns pass through as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                k = part.schema.get_field_index(column)
                values, stay = fn(part.column(k).to_pylist())
                if values is not None:
                    part = part.set_column(k, part.schema.field(k), pa.array(values, part.schema.field(k).type))
                yield part if stay is None else part.filter(pa.array(stay, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each run of equal first ``keys`` columns, without these; the rows come sorted by them."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a staged table of a few fixed-size columns, marked for broadcast if it has at most
    ``limit`` rows; otherwise Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b: same type, not null): node, root.

    Each round gives every node the smallest root among itself and its neighbours' and then jumps
    from root to root, so a chain of n nodes takes about log n rounds. Rounds are staged tables;
    only a count of changes comes to the driver. No nodes: an empty table.
    """
    both = stage(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").selectExpr("b", "a")).distinct(),
                 f"{name}-edges")
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), f"{name}-roots")
    # Roots are two values a node: below the limit they go to each task, and a round shuffles twice.
    light = F.broadcast if roots.count() <= BROADCAST_ROWS else (lambda df: df)
    while True:
        seen = roots.select(F.col("node").alias("b"), F.col("root").alias("near"))
        best = (both.join(light(seen), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
                .join(light(roots), "node")
                .select("node", F.col("root").alias("old"), F.least("near", "root").alias("low")))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("up"))
        # A root learns what its nodes have found, so that whole trees move at once.
        moved = stage(best.join(light(jump), "low", "left")
                      .select("node", "old", F.least("low", F.coalesce("up", "low")).alias("root")), f"{name}-moved")
        pushed = (moved.filter("root < old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("pushed")))
        after = stage(moved.join(light(pushed), "node", "left")
                      .select("node", "old", F.least("root", F.coalesce("pushed", "root")).alias("root")),
                      f"{name}-roots")
        if after.filter("root <> old").isEmpty():
            return after.select("node", "root")
        roots = after.select("node", "root")


def spans_text(spans: list[tuple[int, int, int, str]]) -> str:
    """``kind:start:end`` by start, then the order of the kinds (start, order, end, kind)."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
