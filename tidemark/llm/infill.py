"""Fill-in-the-middle samples whose cuts are found by chunks that texts share.

A text of n lines is cut in front of two lines into prefix, middle and suffix, which are written in the order prefix, suffix,
middle (psm) or suffix, prefix, middle (spm), each behind its mark, so that a model learns to fill the gap.

1. A rolling hash over ``WINDOW`` bytes cuts each text into chunks where it meets a mask, so equal passages of any two texts are
   cut into equal chunks, wherever they begin. Chunks have ``LEAST`` to ``MOST`` bytes.
2. A task remembers a summary of each chunk it has seen (ends of lines, number of code points), up to ``MEMO_BYTES`` of
   them, the least recently used going first. A chunk is found by the hash of its content and verified by comparing the
   content, so the summary is exact; forgetting costs time, never results.
3. Running totals over a text's summaries give its number of lines and, for a cut, the chunk it lies in and the place there.

The texts do not leave their tasks: there is no shuffle, no key and no group that could be hot.

Nulls and odd inputs: a null or empty text has no lines and stays as it is (``plain``), as does one that holds a mark. Which lines are
cut depends on the id alone, a null id counting as the empty string; rows that repeat an id and a text get the same cuts.
A text of any length is read whole. Columns that clash with the added ones are taken over by these; all others stay. No
rows: no rows.
"""

from __future__ import annotations

import bisect
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import ROWS_AT_ONCE

SEED, RATE, SPM = 7, 100, 50
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"

WINDOW, MASK_BITS, LEAST, MOST = 16, 10, 256, 8192
#: Bytes of chunks that one task remembers.
MEMO_BYTES = 64 << 20

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def chunk_ends(raw: bytes) -> list[int]:
    """Where the chunks of ``raw`` end. An end depends on the ``WINDOW`` bytes before it and on the end before that."""
    if len(raw) <= LEAST:
        return [len(raw)] if raw else []
    rolled = _GEAR[np.frombuffer(raw, np.uint8)]
    step = 1
    while step < WINDOW:  # sums of 2, 4, ... WINDOW bytes, each shifted by its age
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    at = (np.flatnonzero(rolled >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    ends, last = [], 0
    while len(raw) - last > LEAST:
        k = bisect.bisect_left(at, last + LEAST)
        last = min(at[k] if k < len(at) else len(raw), last + MOST, len(raw))
        ends.append(last)
    if last < len(raw):
        ends.append(len(raw))
    return ends


class Summary(NamedTuple):
    line_ends: np.ndarray  # places behind each line feed
    chars: int


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    return Summary(np.flatnonzero(data == 10) + 1, _chars(data))


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero(data & 0xC0 != 0x80))


class Memo:
    """Summaries of the chunks seen last, found by content."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.size, self.hits = limit, 0, 0
        self.held: OrderedDict[bytes, Summary] = OrderedDict()  # a dict compares whole keys when hashes agree

    def __call__(self, chunk: bytes) -> Summary:
        if (found := self.held.get(chunk)) is not None:
            self.held.move_to_end(chunk)
            self.hits += 1
            return found
        found = self.held[chunk] = summary(chunk)
        self.size += len(chunk) + 8 * len(found.line_ends)
        while self.size > self.limit:
            old, gone = self.held.popitem(last=False)
            self.size -= len(old) + 8 * len(gone.line_ends)
        return found


class Lines:
    """The lines of a text by its chunks."""

    def __init__(self, raw: bytes, memo: Memo):
        self.raw, self.ends = raw, chunk_ends(raw)
        self.starts = [0, *self.ends[:-1]]
        self.parts = [memo(raw[a:b]) for a, b in zip(self.starts, self.ends, strict=False)]
        self.feeds = np.cumsum([len(p.line_ends) for p in self.parts], dtype=np.int64)
        self.chars = np.cumsum([0, *(p.chars for p in self.parts)], dtype=np.int64)
        fed = int(self.feeds[-1]) if self.parts else 0
        self.n = fed + (not raw.endswith(b"\n") if raw else 0)

    def cut(self, lines: int) -> tuple[int, int]:
        """Bytes and code points of the first ``lines`` lines."""
        if lines == 0:
            return 0, 0
        if not len(self.feeds) or lines > self.feeds[-1]:
            return len(self.raw), int(self.chars[-1])
        k = int(np.searchsorted(self.feeds, lines))
        before = int(self.feeds[k - 1]) if k else 0
        inside = int(self.parts[k].line_ends[lines - before - 1])
        start = self.starts[k]
        return start + inside, int(self.chars[k]) + _chars(np.frombuffer(self.raw, np.uint8, inside, start))


_MARKS = tuple(m.encode() for m in (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK))


def _infilled(raw: bytes, draws: tuple[int, int, int, int], rate: int, spm: int, memo: Memo) -> tuple:
    """n, form, code points of prefix and middle, output."""
    lines = Lines(raw, memo)
    if not raw or any(m in raw for m in _MARKS) or draws[2] % 100 >= rate:
        return lines.n, "plain", None, None, raw
    first, last = sorted(draws[k] % (lines.n + 1) for k in (0, 1))
    (a, prefix_chars), (b, upto) = lines.cut(first), lines.cut(last)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = _MARKS
    form, output = (("spm", b"".join([s, suffix, p, prefix, m, middle])) if draws[3] % 100 < spm
                    else ("psm", b"".join([p, prefix, s, suffix, m, middle])))
    return lines.n, form, prefix_chars, upto - prefix_chars, output


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
           spm: int = SPM) -> DataFrame:
    """``docs`` with n (lines), form (plain, psm, spm), prefix_chars, middle_chars and ``infilled``, the sample. ``rate`` percent of the
    texts are cut, ``spm`` percent of these put the suffix first."""
    added = ["n", "form", "prefix_chars", "middle_chars", "infilled"]
    whole = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(whole, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in added] or [F.lit(0).alias("_none")]).alias("_all"), draws.alias("_draws"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
    struct = T.StructType([rows.schema["_all"], *T.StructType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, infilled binary")])
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = [_infilled(raw, draws, rate, spm, memo) for draws, raw in
                         zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(
                    pa.array([x[k] for x in found], f.type) for k, f in enumerate(list(arrow)[1:]))], schema=arrow)

    done = rows.mapInArrow(run, struct)
    return done.select(*[F.col("_all")[c].alias(c) for c in docs.columns if c not in added], *added[:-1],
                       F.col("infilled").cast("string").alias("infilled"))


def restored(output: Column, form: Column) -> Column:
    """The text that a sample was made of. A text that is cut holds no mark, so the marks tell its parts apart."""
    part = F.split(output, f"{PREFIX_MARK}|{SUFFIX_MARK}|{MIDDLE_MARK}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
