"""Best-fit packing of token sequences by bin completion.

Documents are tokenized and closed with an end token; one that is longer than a sequence is cut into full
pieces, of which the first takes the remainder. Pieces of one length are alike, so a packing is a list of
fillings (how many pieces of which lengths) with a number of sequences each. Only the count of every
length, at most ``capacity`` numbers, comes to the driver. There the search fills the sequence of the
largest piece left: it enumerates fillings of the rest that no other dominates, least waste first, uses
one as often as the counts allow, and backtracks under a bound: used sequences plus the least that the
remaining tokens need must be below the incumbent, which starts as best-fit decreasing. It ends at the lower
bound or after ``nodes`` steps. Each piece then finds its place from its number among those of its
length; the numbers come from the counts per task, so no length meets in one task.

Nulls and odd inputs: a null text is empty and yields the end token alone; null or repeated ids are separate
documents, each packed; very long texts are cut like others, whole. Columns beyond id and text are
not read. No rows: no pieces.
"""

from __future__ import annotations

import array
import base64
import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import ROWS_AT_ONCE, scan
from tidemark.session import stage

CAPACITY, END = 1024, 2
#: Longer texts go to the slower of two libraries, which takes any text.
LONG = 100_000


@cache
def _encoders(vocabulary: str, ranks: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return slow, fast, re.compile("|".join(map(re.escape, added)) or r"(?!)")


def token_bytes(text: str, vocabulary: str = "", ranks: str = "") -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit numbers. Both libraries hold one vocabulary and give the same ids, but for
    the vocabulary's added tokens, which only the slower one knows: it takes the texts that hold one."""
    slow, fast, added = _encoders(vocabulary, ranks)
    if len(text) > LONG or added.search(text):
        return array.array("I", slow.encode(text, add_special_tokens=False).ids).tobytes()
    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
           vocabulary: str = "", ranks: str = "") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the task (``part``) and place (``nth``) among
    its pieces of that length that make it distinct."""
    struct = T.StructType.fromDDL(f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, "
                                  "ids_crc32 long, part int, nth long")
    arrow = to_arrow_schema(struct)
    closing = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = []
                ids, texts = (c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)
                for doc_id, text in zip(ids, texts, strict=True):
                    tokens = token_bytes(text or "", vocabulary, ranks) + closing
                    n = len(tokens) // 4
                    start, length, k = 0, n % capacity or capacity, 0
                    while start < n:
                        crc = zlib.crc32(tokens[4 * start:4 * (start + length)])
                        rows.append((doc_id, k, start, length, crc, part, seen[length]))
                        seen[length] += 1
                        start, length, k = start + length, capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, struct)


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: one for each piece of over half a sequence, plus what pieces of
    ``least`` to a half need beyond the room beside those that leave so much."""
    half = capacity // 2
    best = -(-sum(size * n for size, n in enumerate(counts)) // capacity)
    big = sum(counts[half + 1:])
    small = sum(size * counts[size] for size in range(1, half + 1))
    room = sum((capacity - size) * counts[size] for size in range(half + 1, capacity + 1))
    for least in range(1, half + 1):
        best = max(best, big + -(-max(0, small - room) // capacity))
        small -= least * counts[least]
        room -= least * counts[capacity - least] if capacity - least > half else 0
    return best


def fillings(counts: list[int], room: int, keep: int = 6, steps: int = 600) -> list[tuple[int, ...]]:
    """Undominated sets of pieces for ``room``, least waste first: nothing left fits beside one, and no piece of
    one can give way to a larger piece left. At most ``keep`` of the first ``steps`` met, largest pieces first."""
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    if not sizes:
        return [()]
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest, budget = sizes[-1], steps
    position = {s: i for i, s in enumerate(sizes)}
    ascending = sizes[::-1]

    def descend(first: int, left: int, chosen: list[int]) -> bool:
        nonlocal budget
        budget -= 1
        # The largest that fits from here on; pieces come in falling order.
        at = bisect.bisect_right(ascending, left) - 1
        at = max(first, position[ascending[at]]) if at >= 0 else len(sizes)
        tried = 0
        while at < len(sizes) and budget > 0 and tried < 4:
            size = sizes[at]
            if chosen.count(size) < counts[size]:
                chosen.append(size)
                done = descend(at, left - size, chosen)
                chosen.pop()
                if done:
                    return True
                tried += 1
            at += 1
        if not tried and (left < smallest or not any(
                s <= left and counts[s] > chosen.count(s) for s in ascending[:bisect.bisect_right(ascending, left)])):
            for size in set(chosen):
                better = ascending[bisect.bisect_right(ascending, size):bisect.bisect_right(ascending, size + left)]
                if any(counts[s] > chosen.count(s) for s in better):
                    return False  # dominated
            found.append((left, tuple(chosen)))
            return left == 0 and len(found) >= keep
        return False

    descend(0, room, [])
    if not found:  # every filling met was dominated: the plain best fit
        chosen, left = [], room
        for size in sizes:
            while size <= left and chosen.count(size) < counts[size]:
                chosen.append(size)
                left -= size
        found.append((left, tuple(chosen)))
    return [c for _, c in sorted(set(found), key=lambda x: (x[0], len(x[1])))[:keep]]


def _times(counts: list[int], filling: tuple[int, ...]) -> int:
    return min(counts[s] // filling.count(s) for s in set(filling))


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: the largest piece left, then always the largest that fits."""
    left, out = counts[:], []
    for size in range(capacity, 0, -1):
        while left[size]:
            chosen, room = [size], capacity - size
            for s in range(min(size, room), 0, -1):
                if s <= room and left[s] > chosen.count(s):
                    n = min(room // s, left[s] - chosen.count(s))
                    chosen += [s] * n
                    room -= s * n
            n = _times(left, tuple(chosen))
            for s in chosen:
                left[s] -= n
            out.append((n, tuple(chosen)))
    return out


def complete(counts: list[int], capacity: int = CAPACITY, nodes: int = 4_000) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, filling) of the best packing found."""
    counts = [*counts, *[0] * (capacity + 1 - len(counts))]
    best = best_fit(counts, capacity)
    used, bound = sum(n for n, _ in best), lower_bound(counts, capacity)
    if used <= bound:
        return best
    left, total = counts[:], sum(s * n for s, n in enumerate(counts))
    path: list[tuple[int, tuple[int, ...]]] = []
    open_: list[Iterator] = []
    mine = 0

    def choices() -> Iterator:
        size = next((s for s in range(capacity, 0, -1) if left[s]), 0)
        left[size] -= 1
        options = fillings(left, capacity - size) if size else []
        left[size] += 1
        return iter([(size, *f) for f in options])

    open_.append(choices())
    while open_ and nodes > 0:
        filling = next(open_[-1], None)
        if filling is None:
            open_.pop()
            if path:
                n, last = path.pop()
                mine, total = mine - n, total + n * sum(last)
                for s in last:
                    left[s] += n
            continue
        nodes -= 1
        n = _times(left, filling)
        if mine + n + -(-(total - n * sum(filling)) // capacity) >= used:
            # As often as the counts allow is too wasteful; the other fillings remain.
            continue
        mine, total = mine + n, total - n * sum(filling)
        for s in filling:
            left[s] -= n
        path.append((n, filling))
        if total == 0:
            best, used = path[:], mine
            if used <= bound:
                break
        open_.append(choices())
    return best


def _places(packing: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the runs of its places: first number, first sequence, pieces a sequence, first offset."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for n, filling in packing:
        offset = 0
        for size in dict.fromkeys(filling):
            many = filling.count(size)
            out.setdefault(size, []).append((taken.get(size, 0), sequence, many, offset))
            taken[size] = taken.get(size, 0) + n * many
            offset += many * size
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
         vocabulary: str = "", ranks: str = "", nodes: int = 4_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stage(pieces(docs, id_col, text_col, capacity, end, vocabulary, ranks), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = stage(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = [0] * (capacity + 1)
    for r in numbered.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    places = _places(complete(counts, capacity, nodes))
    firsts = {size: [r[0] for r in runs] for size, runs in places.items()}

    def place(*columns: list) -> dict[str, list]:
        *own, number = columns
        out = dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), own, strict=True))
        sequences, offsets = [], []
        for size, k in zip(out["length"], number, strict=True):
            first, sequence, many, offset = places[size][bisect.bisect_right(firsts[size], k) - 1]
            sequences.append(sequence + (k - first) // many)
            offsets.append(offset + (k - first) % many * size)
        return out | {"sequence_id": sequences, "offset": offsets}

    named = cut.join(numbered.drop("n"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    return scan(named, place, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, "
                "ids_crc32 long, sequence_id long, offset long", 8192)
