"""Removal of exact copies by sorting the corpus by content.

Two texts are equal when they are identical after the deletion of ASCII white space. Of equal texts the row with the most code
points in the original text stays, among these the one with the smallest id.

1. Normalised bytes are range-partitioned by sampled splitters. A splitter holds the first ``PREFIX`` bytes, a hash of the
   whole, the length and the id, so what the driver samples does not grow with the texts, a common beginning does not fill one
   partition, and a group of copies of any size is dealt over many.
2. Each partition is sorted on disk (prefix, hash, whole content, longest first, id), so equal texts are neighbours and the first
   of each run is the one that stays.
3. A task compares each row's whole content with the one before it. Texts end here; a row goes on with its run, the
   run's first id and its size.
4. A group may go on in the next partition. Only runs at the edges of a partition keep their content; these (about two a
   partition) are compared with each other in full, and what they add up to is sent to the rows.

One shuffle moves the normalised texts; nothing is collected, and a group is never in one task.

Nulls and odd inputs: a null text counts as empty, and all empty texts are equal. A null id sorts after all others, so it stays only
if no equal text of that length has an id. Rows that repeat an id and a text are copies of each other like any others: one
stays. Texts of any length are compared whole. Columns beyond id and text are not read by ``exact_copies``; ``without_copies``
passes them on, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import small_or_not
from tidemark.session import stage

#: Bytes of content in a splitter.
PREFIX = 16
#: Rows that a task hands on at once.
ROWS = 4096


def normalised(text: Column) -> Column:
    """``text`` without ASCII white space; null as the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


class _Runs:
    """The runs of a sorted partition. Those of the current (prefix, hash) are held back until another one follows, as they
    are at an edge if none does."""

    def __init__(self, part: int, schema: pa.Schema):
        self.part, self.schema, self.number = part, schema, -1
        self.place = self.content = None  # of the current run
        self.held: list[list] = []  # runs of the current place: number, ids, rows, content
        self.first_place = True
        self.out: list[tuple] = []

    def add(self, place: tuple, content: bytes, doc_id: object, row: int) -> None:
        if place != self.place:
            if self.held:
                self.close(edge=self.first_place)
                self.first_place = False
            self.place, self.content = place, None
        if content != self.content:
            self.number += 1
            self.content = content
            self.held.append([self.number, [], [], content])
        self.held[-1][1].append(doc_id)
        self.held[-1][2].append(row)

    def close(self, edge: bool) -> None:
        for number, ids, rows, content in self.held:
            digest = hashlib.sha256(content).hexdigest()
            for k, (doc_id, row) in enumerate(zip(ids, rows, strict=True)):
                self.out.append((doc_id, row, self.part, number, ids[0], len(ids), k == 0, digest, content if edge and not k else None))
        self.held = []

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        while len(self.out) >= least and self.out:
            now, self.out = self.out[:ROWS], self.out[ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*now, strict=True), self.schema, strict=True)],
                                             schema=self.schema)


def _runs(ordered: DataFrame, kind: str) -> DataFrame:
    struct = T.StructType.fromDDL(f"doc_id {kind}, _row long, part int, run long, keep_id {kind}, size long, leads boolean, "
                                  "digest string, edge binary")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Runs(TaskContext.get().partitionId(), arrow)
        for batch in batches:
            ids, rows, prefixes, hashes, contents = (c.to_pylist() for c in batch.columns)
            for doc_id, row, prefix, hashed, content in zip(ids, rows, prefixes, hashes, contents, strict=True):
                found.add((prefix, hashed), content, doc_id, row)
            yield from found.batches(ROWS)
        found.close(edge=True)
        yield from found.batches(1)

    return ordered.select("doc_id", "_row", "prefix", "hash", "content").mapInArrow(run, struct)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256 (of the
    normalised text), and ``_row``, a hash of the original text that tells rows with the same id apart."""
    text = F.col(text_col)
    content = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"),
                          F.length(F.coalesce(text, F.lit(""))).alias("chars"), normalised(text).cast("binary").alias("content"))
    keyed = content.select("*", F.substring("content", 1, PREFIX).alias("prefix"), F.xxhash64("content").alias("hash"))
    best = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ordered = keyed.repartitionByRange("prefix", "hash", *best).sortWithinPartitions("prefix", "hash", "content", *best)
    runs = stage(_runs(ordered, docs.schema[id_col].dataType.simpleString()), "copy-runs")

    edges = runs.filter("edge is not null").select("part", "run", "keep_id", "size", "edge")
    whole = edges.groupBy("edge").agg(F.min(F.struct("part", "run", "keep_id")).alias("first"), F.sum("size").alias("whole_size"),
                                      F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    joined = edges.select("part", "run", "edge").join(whole, "edge").select(
        "part", "run", F.col("first.keep_id").alias("whole_id"), "whole_size",
        ((F.col("part") == F.col("first.part")) & (F.col("run") == F.col("first.run"))).alias("whole_first"))
    joined = small_or_not(stage(joined, "copy-edges"))
    spans = F.col("whole_size").isNotNull()
    return runs.drop("edge").join(joined, ["part", "run"], "left").select(
        "doc_id", F.when(spans, F.col("whole_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("whole_size", "size").alias("group_size"),
        (F.col("leads") & F.coalesce("whole_first", F.lit(True))).alias("kept"), F.col("digest").alias("text_sha256"), "_row")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that are equal in id and text one stays, any of them."""
    kept = exact_copies(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_copy_id"), F.col("_row").alias("_copy_row"))
    kept = small_or_not(stage(kept, "copies-kept"))
    row = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    found = docs.join(kept, docs[id_col].eqNullSafe(kept["_copy_id"]) & (row == kept["_copy_row"]), "left_semi")
    return found.dropDuplicates([id_col, text_col])
