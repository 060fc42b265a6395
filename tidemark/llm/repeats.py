"""Removal of text units that repeat anywhere in the corpus.

A unit is a sentence or a line, whichever ends first, with the white space after it, so that the units of a text tile
it and a passage that starts within a line is caught from its next sentence on. Units are compared by a 128-bit
digest of their normal form (A-Z lowered, white space runs as one blank, ends trimmed); those of fewer than
``least_words`` words are never removed. Words are what blanks separate; in scripts written without blanks each two letters that follow
each other count as one more. Of equal units the one of the earliest row stays, in a row the first; all others are
removed, and their places in the original text are returned. Rows rank by id, then by a hash of their text.

Digests are grouped in two steps, in each document and then over all, by count and earliest row: a unit that fills a third of
the corpus is one row per task before the shuffle. Only repeated digests are joined back, and texts that lose nothing to other rows
are not shuffled as long as the numbers of those that do can be broadcast.

Nulls and odd inputs: a null text stays null and has no units; rows without an id rank after all others. Rows that repeat an id are
rows of their own; of rows that repeat id and text, any one counts as the earliest, so the result is the same but for which of the equal rows
it is. Very long texts are read whole. All columns of
the input stay; names that clash with those added are taken over by the added ones. No rows: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import BROADCAST_ROWS, ROWS_AT_ONCE, ascii_lowered
from tidemark.session import stage

LEAST_WORDS = 5
_END = re.compile("[.!?]+[ \t\n\r\f]+|[\u3002\uFF01\uFF1F]+[ \t\n\r\f]*|\n[ \t\n\r\f]*")
#: Letters of scripts written without blanks: Thai to Myanmar, Khmer, Kana, Han. Two of them make a word.
_UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF]{2}")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


def units(text: str) -> list[tuple[int, int]]:
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def normal(unit: str) -> str:
    return _BLANKS.sub(" ", ascii_lowered(unit)).strip(" ")


def n_words(form: str) -> int:
    return form.count(" ") + 1 + (0 if form.isascii() else len(_UNSPACED.findall(form)))


def _examine(text: str, least_words: int) -> tuple[int, list[dict], list[dict]]:
    first, again, seen, tiles = [], [], set(), units(text) if text else []
    for start, end in tiles:
        form = normal(text[start:end])
        if n_words(form) < least_words or not form:
            continue
        digest = xxhash.xxh3_128_intdigest(form.encode("utf-8", "surrogatepass"))
        if digest in seen:
            again.append({"start": start, "end": end})
        else:
            seen.add(digest)
            first.append({"h1": (digest >> 64) - (1 << 63), "h2": (digest & ((1 << 64) - 1)) - (1 << 63),
                          "start": start, "end": end})
    return len(tiles), first, again


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` cut, and n_units, n_removed, removed (start, end in the original text)."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("_all"), F.col(id_col).alias("_own"),
                       F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_key"))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(
        "n_units long, first array<struct<h1:long,h2:long,start:int,end:int>>, again array<struct<start:int,end:int>>").fields])
    arrow = to_arrow_schema(schema)

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                seen = [_examine(t or "", least_words) for t in part.column(2).to_pylist()]
                added = [pa.array([x[i] for x in seen], arrow.field(f).type) for i, f in enumerate(("n_units", "first", "again"))]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)], *added], schema=arrow)

    # Rows are numbered once, where they are written: rows that are equal in all columns stay apart.
    found = stage(rows.mapInArrow(examine, schema).withColumn("_nr", F.monotonically_increasing_id()), "units")
    own = found.select("_nr", "_own", "_key", F.explode("first").alias("u")).select("_nr", "_own", "_key", "u.*")
    rank = F.struct(F.col("_own").isNull().alias("none"), "_own", "_key", "_nr")
    repeated = stage(own.groupBy("h1", "h2").agg(F.min(rank)["_nr"].alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n"),
                     "repeated-units")
    late = stage(own.join(repeated, ["h1", "h2"]).filter("_nr <> keeper").groupBy("_nr").agg(
        F.collect_list(F.struct("start", "end")).alias("late")), "unit-cuts")
    found = found.drop("first", "_own", "_key")
    if late.count() <= BROADCAST_ROWS:
        touched = F.broadcast(late.select("_nr"))
        whole = found.join(touched, "_nr", "left_anti").withColumn("late", F.lit(None).cast(late.schema["late"].dataType))
        joined = found.join(touched, "_nr", "left_semi").join(late, "_nr").unionByName(whole)
    else:
        joined = found.join(late, "_nr", "left")
    joined = joined.withColumn("removed", F.array_sort(F.concat("again", F.coalesce("late", F.array().cast("array<struct<start:int,end:int>>")))))

    # Kept pieces in order: from the end of each cut to the start of the next. Cuts are tiles, so none overlap.
    starts = F.concat(F.array(F.lit(0)), F.col("removed.end"))
    ends = F.concat(F.col("removed.start"), F.array(F.length("_text")))
    kept = F.when(F.size("removed") == 0, F.col("_text")).otherwise(F.array_join(F.zip_with(
        starts, ends, lambda a, b: F.substring(F.col("_text"), a + 1, b - a)), ""))
    text = F.when(F.col("_text").isNotNull(), kept)
    added = ("n_units", "n_removed", "removed")
    return joined.select(*[(text if c == text_col else F.col("_all")[c]).alias(c) for c in docs.columns if c not in added],
                         "n_units", F.size("removed").cast("long").alias("n_removed"), "removed")
