"""Spelling variants: words one edit apart, grouped under the most frequent of them.

1. Words are counted in each task and then over all, so a word that fills the corpus is one row a task before the shuffle.
2. Blocked Bloom filters hold the vocabulary, one filter per word length: a word sets bits in one block of 64 bytes. Blocks are built by
   grouped ``bit_or`` and number ``bits`` per word, more for longer words, which have more edits to ask for. They are broadcast
   in passes of at most ``FILTER_BYTES``, so a vocabulary of any size takes that much memory and more passes.
3. Each word's edits are generated as hashes: a polynomial hash of the edited word follows from the word's prefix sums
   without writing the edit down. An insertion into one word is a deletion from the other and a replacement goes both ways, so
   deletions and replacements by later letters find every pair.
4. Only edits that the filters hold are written down and shuffled, to a join with the vocabulary that removes false positives.
5. A word's form is its most frequent near word if that is at least ``lead`` times as frequent. Roots follow by doubling:
   each round joins a word's form with that one's, so a chain of k forms takes about log k rounds. Frequencies grow along a chain, so it ends.

Nulls and odd inputs: a null or empty text has no words; a null id counts as the empty string where typing errors are drawn; rows
that repeat an id count each time. A text or word of any length is read whole. Equal frequencies are told apart by code
points. Columns beyond id and text are not read. No rows, or no word that is frequent enough: no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import spread, stage

LEAST_CHARS, LEAST_COUNT, LEAD = 5, 3, 2
#: One run in so many loses a letter, drawn from id and run; None: none does.
TYPO_EVERY = 97
#: Bits of filter per word of up to 16 letters; two more per doubling of the length.
BITS = 16
#: Most bytes of filter that are broadcast at once.
FILTER_BYTES = 64 << 20
#: Words that a task counts before it hands them on, and edits that it hashes at once.
COUNTED, EDITS = 300_000, 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")  # one byte a letter in Latin-1
_PROBES = 7
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_LETTER = np.array([pow(k + 3, 11, (1 << 64) - 59) for k in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(raw: bytes | None, doc_id: str | None, typo_every: int | None = TYPO_EVERY,
             least_chars: int = LEAST_CHARS) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, once per different run of letters."""
    if not raw:
        return
    seed = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in Counter(_RUN.findall(raw.lower().decode("utf-8", "replace"))).items():  # bytes: A-Z only
        if len(run) < least_chars:
            continue
        if typo_every and (h := zlib.crc32(run.encode(), seed)) % typo_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least_chars:
                continue
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = TYPO_EVERY,
               least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``least_chars`` letters that occur at least ``least_count`` times."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in words_of(raw, doc_id, typo_every, least_chars):
                    seen[word] += n
                if len(seen) >= COUNTED:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Shape:
    """Where the filter of each word length lies among all blocks."""

    def __init__(self, counts: dict[int, int], bits: int = BITS):
        self.start, self.size, self.blocks = {}, {}, 0
        for length, n in sorted(counts.items()):
            each = bits + 2 * max(0, math.ceil(math.log2(length / 16)))
            self.start[length], self.size[length] = self.blocks, -(-n * each // 512)
            self.blocks += self.size[length]

    def block(self, key: np.ndarray, length: int) -> np.ndarray:
        size = np.uint64(self.size[length])
        high, low = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)  # key * size >> 64, size below 2 ** 32
        return ((high * size + (low * size >> np.uint64(32))) >> np.uint64(32)).astype(np.int64) + self.start[length]


def _bits(key: np.ndarray) -> np.ndarray:
    """Places in a block, one row per probe."""
    other = _mix(key ^ np.uint64(_UNBASE))
    return np.stack([(other >> np.uint64(9 * k)) & np.uint64(511) for k in range(_PROBES)])


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(length, letters in rows, words) of words of equal length, for at most ``EDITS`` letters at once."""
    sorted_words = defaultdict(list)
    for w in words:
        sorted_words[len(w)].append(w)
    for length, own in sorted_words.items():
        step = max(1, EDITS // (length * 64))
        for at in range(0, len(own), step):
            part = own[at:at + step]
            yield length, np.frombuffer("".join(part).encode("latin-1"), np.uint8).reshape(len(part), length), part


def _sums(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first k letters of each row, for k from 0, and the powers used."""
    powers = _powers(letters.shape[1])
    sums = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    np.cumsum(_LETTER[letters] * powers[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums, powers


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    return _mix(sums + np.uint64(length * 0x632BE5AB & 0xFFFFFFFF))


def _blocks(words: DataFrame, shape: Shape) -> DataFrame:
    """The filters: block, b0 to b7 (64 bits each)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, bits = [], []
            with np.errstate(over="ignore"):
                for length, letters, _ in _by_length(batch.column(0).to_pylist()):
                    key = _key(_sums(letters)[0][:, -1], length)
                    blocks.append(shape.block(key, length))
                    bits.append(_bits(key))
            if not blocks:
                continue
            block, bits = np.concatenate(blocks), np.concatenate(bits, 1)
            own, row = np.unique(block, return_inverse=True)
            held = np.zeros((len(own), 8), np.uint64)
            for probe in bits:
                np.bitwise_or.at(held, (row, (probe >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (probe & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(held[:, k].view(np.int64)) for k in range(8))],
                                             names=["block", *(f"b{k}" for k in range(8))])

    each = words.select("word").mapInArrow(build, "block long, " + ", ".join(f"b{k} long" for k in range(8)))
    return each.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(8)])


def _held(filters: np.ndarray, low: int, key: np.ndarray, length: int, shape: Shape) -> np.ndarray:
    """Which places of ``key`` are held by the blocks from ``low`` on."""
    if not shape.size.get(length):
        return np.zeros(0, np.int64)
    flat = key.ravel()
    block = shape.block(flat, length) - low
    at = np.flatnonzero((block >= 0) & (block < len(filters)))
    for probe in range(_PROBES):
        if not len(at):
            break
        place = (_mix(flat[at] ^ np.uint64(_UNBASE)) >> np.uint64(9 * probe)) & np.uint64(511)
        word = filters[block[at], (place >> np.uint64(6)).astype(np.int64)]
        at = at[(word >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _edits(words: list[str], filters: np.ndarray, low: int, shape: Shape, alphabet: np.ndarray) -> Iterator[tuple[str, str]]:
    """(word, edit) for the edits that the filters hold: deletions, and replacements by letters further on in ``alphabet``."""
    with np.errstate(over="ignore"):
        for length, letters, own in _by_length(words):
            sums, powers = _sums(letters)
            whole = sums[:, -1:]
            if length > 1:
                shorter = sums[:, :-1] + (whole - sums[:, 1:]) * np.uint64(_UNBASE)
                for k in _held(filters, low, _key(shorter, length - 1), length - 1, shape).tolist():
                    w, at = own[k // length], k % length
                    yield w, w[:at] + w[at + 1:]
            for begin in range(0, length, max(1, EDITS // (len(own) * len(alphabet)))):  # a very long word goes piece by piece
                part = letters[:, begin:begin + max(1, EDITS // (len(own) * len(alphabet)))]
                scale = powers[begin:begin + part.shape[1], None]
                changed = whole[:, :, None] + (_LETTER[alphabet] - _LETTER[part][:, :, None]) * scale
                row, at, letter = np.nonzero(alphabet > part[:, :, None])
                key = _key(changed[row, at, letter], length)
                for k in _held(filters, low, key, length, shape).tolist():
                    w, i = own[row[k]], begin + int(at[k])
                    yield w, w[:i] + chr(alphabet[letter[k]]) + w[i + 1:]


def _candidates(words: DataFrame, filters: np.ndarray, low: int, shape: Shape, letters: list[str]) -> DataFrame:
    """(word, n, edit) that the filters hold."""
    sent = words.sparkSession.sparkContext.broadcast(filters)
    alphabet = np.array([ord(c) for c in letters], np.uint8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = dict(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found = list(_edits(list(count), sent.value, low, shape, alphabet))
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([w for w, _ in found], pa.string()), "n": pa.array([count[w] for w, _ in found], pa.int64()),
                "edit": pa.array([e for _, e in found], pa.string())})

    done = stage(words.select("word", "n").mapInArrow(probe, "word string, n long, edit string"), "variant-edits")
    sent.unpersist()
    return done


def near_words(words: DataFrame, bits: int = BITS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Pairs (word, n, near, near_n) of ``words`` (word, n; a staged table of different words), each in both directions."""
    counts = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    letters = sorted(r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect())
    shape = Shape(counts, bits)
    blocks = stage(_blocks(words, shape), "variant-filters")
    many = max(1, filter_bytes // 64)
    dealt = spread(words)
    found = words.select("word", "n", F.col("word").alias("edit")).filter(F.lit(False))
    for low in range(0, shape.blocks, many):
        table = blocks.filter((F.col("block") >= low) & (F.col("block") < low + many)).toArrow()
        filters = np.zeros((min(many, shape.blocks - low), 8), np.uint64)
        for k in range(8):
            filters[table["block"].to_numpy() - low, k] = table[f"b{k}"].to_numpy().view(np.uint64)
        found = found.union(_candidates(dealt, filters, low, shape, letters))
    pairs = (found.distinct().join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
             .select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")))
    pairs = stage(pairs, "variant-pairs")
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """The last form of each word (word, root) that has one (word, form)."""
    now = stage(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "variant-roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = None,
                      lead: int = LEAD, bits: int = BITS, filter_bytes: int = FILTER_BYTES, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary (``limits``: see ``vocabulary``)."""
    words = stage(vocabulary(docs, id_col, text_col, typo_every, **limits), "variant-words")
    near = near_words(words, bits, filter_bytes)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    named = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(-F.col("best.less") >= lead * F.col("n"), c).alias(name) for c, name in
          ((F.col("best.near"), "form"), (-F.col("best.less"), "form_n"))]), "variant-forms")
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
