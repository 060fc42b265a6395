"""Language identification: scripts narrow the languages of a word, Viterbi labels the words of a text.

Learning counts hashed character grams (2 to 4, with word edges) by language in a bounded sample of
labelled rows, and the scripts each language is written in. A word is a run of letters; its score in
a language is the sum of its grams' log probabilities, and only languages that are written in the word's script
(at least ``SCRIPT_SHARE`` of their letters) are candidates; a script that no language was seen in leaves all.
Viterbi finds the labels with the highest sum of scores, less ``penalty`` for each change of language.
The language with the most letters is the document's; its share of the letters is the score.

Nulls and odd inputs: a text that is null or has no letter is ``und`` with score 0 and no spans, and so
is every text if nothing was learned. Rows with a null label or id are not learned from. Each row is
labelled on its own, so equal rows give equal results; texts are labelled whole. Columns beyond id, text and label
are not read. No rows: no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import rewrite, scan

UNKNOWN = "und"
BUCKET_BITS = 17
ORDERS = (2, 3, 4)
SCRIPT_SHARE = 0.01
LEARN_ROWS = 4_000
#: What a change of language costs, in log probability.
PENALTY = 12.0

#: First and last code point of the larger scripts' blocks.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF))
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, 0 unless a letter or mark; its script's number."""
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha() or (i > 0x2FF and unicodedata.category(c)[0] == "M"):
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = SCRIPT_NAMES.index(name)
    return lower, script


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Codes of all texts in a row (0: no letter), and for each word its first place, end, text and script."""
    lower, script = _characters()
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = lower[raw]
    letter = codes != 0
    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.searchsorted(firsts, starts, "right") - 1
    return codes, starts, ends, owner, script[raw[starts]], firsts


_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def _grams(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the places where a gram ends (in a word or just after it) and the grams' buckets."""
    out = []
    back = [np.concatenate([np.zeros(k, np.uint32), codes[:len(codes) - k]]) for k in range(max(ORDERS))]
    for order in ORDERS:
        inner = back[1] != 0  # all but the last of a gram, and all but the first, are letters
        for k in range(2, order - 1):
            inner = inner & (back[k] != 0)
        if order == 2:
            inner = (back[0] != 0) | (back[1] != 0)
        at = np.flatnonzero(inner)
        mixed = np.full(len(at), order, np.uint32)
        for k in range(order):
            mixed = (mixed ^ back[k][at]) * np.uint32(_MULTIPLIERS[k])
            mixed ^= mixed >> np.uint32(15)
        out.append((at, mixed >> np.uint32(32 - BUCKET_BITS)))
    return out


@dataclass
class Model:
    """At most ``languages x 2 ** BUCKET_BITS`` weights, whatever was learned from."""

    languages: list[str]
    weights: np.ndarray  # bucket x language: log probability
    scripts: np.ndarray  # script x language: is a candidate

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, script: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(codes), len(self.languages)), np.float32)
        for at, bucket in _grams(codes):
            sums[at] += self.weights[bucket]
        # A word's grams end from its first letter to the place after it; no two words share a place.
        bounds = np.stack([starts, ends + 1], 1).ravel()
        scores = np.add.reduceat(np.concatenate([sums, np.zeros((2, sums.shape[1]), np.float32)]), bounds, axis=0)[::2]
        scores[~self.scripts[script]] -= 1e4
        return scores


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
          rows: int = LEARN_ROWS) -> Model:
    """Learn from about ``rows`` labelled rows per language, chosen by a hash of the id; all of them if
    there are fewer. What comes to the driver is counts: languages x buckets, languages x scripts."""
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(label_col).alias("lang"))
              .agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    index = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rows / counts[name]))])
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.filter(place < F.element_at(share, F.col(label_col)))

    def count(labels: list, texts: list) -> dict[str, list]:
        out = {"lang": [], "what": [], "bucket": [], "n": []}
        for name in sorted(set(labels)):
            codes, starts, ends, _, script, _ = _words([t for t, own in zip(texts, labels, strict=True) if own == name])
            grams = np.bincount(np.concatenate([b for _, b in _grams(codes)]), minlength=1)
            letters = np.bincount(script, ends - starts, minlength=1).astype(np.int64)
            for what, array in ((0, grams), (1, letters)):
                at = np.flatnonzero(array)
                out["lang"] += [index[name]] * len(at)
                out["what"] += [what] * len(at)
                out["bucket"] += at.tolist()
                out["n"] += array[at].tolist()
        return out

    counted = (scan(chosen.select(label_col, text_col), count, "lang int, what int, bucket int, n long", 2048)
               .groupBy("lang", "what", "bucket").agg(F.sum("n").alias("n")).toPandas())
    weights = np.zeros((1 << BUCKET_BITS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for what, into in ((0, weights), (1, scripts)):
        part = counted[counted["what"] == what]
        into[part["bucket"].to_numpy(), part["lang"].to_numpy()] = part["n"].to_numpy()
    weights = np.log((weights + 0.5) / (weights.sum(0) + 0.5 * len(weights)))
    # Only differences between languages matter; the mean is taken out so that sums stay small.
    weights -= weights.mean(1, keepdims=True)
    known = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    known[~known.any(1)] = True
    return Model(languages, weights.astype(np.float32), known)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word. The words of text i are ``first[i]`` to ``first[i] + count[i] - 1``; all texts
    advance together, a word at a time."""
    n, size = scores.shape
    origin = np.empty((n, size), np.uint8 if size < 256 else np.uint32)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    active = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")
    value = scores[first[:active[0]]].copy() if len(active) else scores[:0]
    own = np.arange(size, dtype=origin.dtype)
    last = np.empty(len(first), np.int64)
    for t in range(len(active)):
        k = active[t]
        if t:
            top = value[:k].argmax(1)
            best = value[np.arange(k), top] - penalty
            turn = best[:, None] > value[:k]
            at = first[:k] + t
            origin[at] = np.where(turn, top[:, None], own)
            value = np.where(turn, best[:, None], value[:k]) + scores[at]
        done = active[t + 1] if t + 1 < len(active) else 0
        last[done:k] = value[done:k].argmax(1)
    labels = np.empty(n, np.int64)
    state = last
    for t in range(len(active) - 1, -1, -1):
        at = first[:active[t]] + t
        labels[at] = state[:active[t]]
        if t:
            state[:active[t]] = origin[at, state[:active[t]]]
    return labels


def label_texts(model: Model, texts: list, penalty: float) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each text."""
    langs, scores, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    # A mark belongs to a word, but is no letter by itself.
    codes, starts, ends, owner, script, firsts = _words([t if t and any(map(str.isalpha, t)) else "" for t in texts])
    size = len(model.languages)
    if not size or not len(starts):
        return langs, scores, spans
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    labels = viterbi(model.word_scores(codes, starts, ends, script), first, count, penalty)
    letters = np.bincount(owner * size + labels, ends - starts, minlength=len(texts) * size).reshape(len(texts), size)
    best, total = letters.argmax(1), letters.sum(1)
    for i in np.flatnonzero(count):
        langs[i] = model.languages[best[i]]
        scores[i] = float(letters[i, best[i]] / total[i])
    opens = np.flatnonzero(np.diff(labels, prepend=-1).astype(bool) | np.diff(owner, prepend=-1).astype(bool))
    closes = np.concatenate([opens[1:], [len(labels)]]) - 1
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        i = owner[a]
        spans[i].append({"lang": model.languages[labels[a]], "start": int(starts[a] - firsts[i]),
                         "end": int(ends[b] - firsts[i])})
    return langs, scores, spans


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = PENALTY) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score and spans (lang, start, end in code points), one for each
    stretch of words of one language. The model goes to each task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(ids: list, texts: list) -> dict[str, list]:
        langs, scores, spans = label_texts(shared.value, texts, penalty)
        return {"doc_id": ids, "lang_pred": langs, "score": scores, "spans": spans}

    return scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), label,
                f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, "
                "spans array<struct<lang:string,start:int,end:int>>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_share: float = 0.5,
                    penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` with a language that has at least ``least_share`` of the letters; all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def stay(texts: list) -> tuple[None, list[bool]]:
        langs, scores, _ = label_texts(shared.value, texts, penalty)
        return None, [name != UNKNOWN and score >= least_share for name, score in zip(langs, scores, strict=True)]

    return rewrite(docs, text_col, stay)


def training_part(id_col: str = "doc_id"):
    """False for rows held out of learning (crc32 of the id, as text, mod 4 is 2), null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2
