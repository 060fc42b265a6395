"""Secret scans: patterns, and a battery of randomness tests on strings that no pattern names.

Patterns give the base spans ``assign``, ``access`` and ``hex``, which are always kept. Every other run
of at least ``SHORTEST`` token characters, or what base spans leave of it, is a candidate; ``=`` ends a run unless it pads it. Its alphabet tells its encoding, and
three tests ask whether its characters may come from a uniform source: chi-squared over groups
of the alphabet, the runs test about the alphabet's middle, serial correlation of neighbours. Fisher's
sum makes one p of the three. Short strings pass such tests by chance, so the p that a string must
reach is set for each encoding and class of lengths: decoys of the same length, cut from the words around each
candidate, take the same tests, and the cut is the lowest p at which the candidates that would pass at the decoys' rate
are at most ``rate`` of the strings declared. A first candidate has up to ``DECOYS`` of them, so that a string needs no
companions. Where a class has too few decoys to tell, those of the neighbouring lengths of all encodings join it,
with a few that every document gives. There, and where fewer than 1 / ``rate`` strings pass, a string's p must also be above
0.001. Only counts by (encoding, length class, step of p) meet, so the control covers the whole corpus at any size.

Nulls and odd inputs: a null text is empty; equal rows give equal results, each on its own; very long
texts are scanned whole in linear time. Columns beyond id and text are not read. No rows: no rows.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import rewrite, scan, spans_text
from tidemark.session import stage

KINDS = ("assign", "access", "hex")
RANDOM = "random"
SHORTEST = 20
#: p is counted in steps of a quarter of a decimal; lengths in steps of a factor of 1.25.
STEPS, LAST_STEP = 4, 60
#: Decoys of a document's first candidate, the n-th has an n-th of that; and those that every document gives.
DECOYS, GIVEN = 100, 2
#: The last step above p = 0.001.
PLAIN = 3 * STEPS - 1

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: ``=`` is padding at the end only: elsewhere it stands between a name and a value.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % SHORTEST)
_NO_LETTER = re.compile(r"[^A-Za-z0-9]+")
_ALPHABETS = (
    ("hex", "0123456789abcdef"), ("hex_upper", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
_INDEX = {name: {c: i for i, c in enumerate(chars)} for name, chars in _ALPHABETS}
_INDEX["base64"] |= {"-": 62, "_": 63}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found)


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return min(1.0, max(1e-300, 0.5 * math.erfc(z / math.sqrt(2))))


def _both_tails(z: float) -> float:
    return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))


def encoding_of(s: str) -> str | None:
    """The smallest alphabet that holds every character; None for digits only."""
    body = s.rstrip("=")
    if body.isdigit():
        return None
    chars = set(body)
    return next((name for name, index in _INDEX.items() if chars <= index.keys()), None)


def battery(s: str, encoding: str) -> float:
    """p of a uniform source over the alphabet of ``encoding``."""
    index = _INDEX[encoding]
    size = max(index.values()) + 1
    at = [index[c] for c in s if c in index]
    n = len(at)
    if n < 8:
        return 1e-300
    # Groups of equal width keep at least five expected characters each, where the length allows.
    groups = max(4, min(size, n // 5))
    counts, width = [0] * groups, [0] * groups
    for i in range(size):
        width[i * groups // size] += 1
    for i in at:
        counts[i * groups // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width, strict=True))
    ps = [_chi_tail(chi, groups - 1)]
    high = [i * 2 >= size for i in at]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(_both_tails((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    mid = sum(at) / n
    around = sum((i - mid) ** 2 for i in at)
    r = sum((a - mid) * (b - mid) for a, b in zip(at, at[1:], strict=False)) / around if around else 1.0
    ps.append(_both_tails((r + 1 / n) * math.sqrt(n)))
    half = -sum(map(math.log, ps))  # half of Fisher's sum: chi-squared with 6 degrees, whose tail is a short series
    return max(1e-300, math.exp(-half) * (1 + half + half * half / 2))


def _tested(s: str) -> dict | None:
    encoding = encoding_of(s)
    if encoding is None:
        return None
    step = min(LAST_STEP, int(-math.log10(battery(s, encoding)) * STEPS))
    return {"kind": encoding, "size": int(math.log(len(s)) / math.log(1.25)), "step": step}


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _runs(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """Token runs, and what base spans leave of them, of at least ``SHORTEST`` characters."""
    covered = _united([(s, e) for s, _, e, _ in base])
    k = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        at = k
        while at < len(covered) and covered[at][0] < end:
            if covered[at][0] - start >= SHORTEST:
                yield start, covered[at][0]
            start = max(start, covered[at][1])
            at += 1
        if end - start >= SHORTEST:
            yield start, end


def _letters(text: str, start: int, end: int, held: list[tuple[int, int]]) -> str:
    """Letters and digits of a part of ``text``, without the strings ``held`` (sorted, disjoint)."""
    start, out = max(0, start), []
    for a, b in held[bisect.bisect_left(held, start, key=lambda x: x[1]):]:
        if a >= end:
            break
        out.append(text[start:max(start, a)])
        start = b
    return _NO_LETTER.sub("", "".join([*out, text[start:end]]))


def _examine(text: str, with_decoys: bool = True) -> tuple[list, list, list]:
    base = base_spans(text)
    candidates, decoys, runs = [], [], list(_runs(text, base))
    for start, end in runs:
        if got := _tested(text[start:end]):
            candidates.append(got | {"start": start, "end": end})
    if not with_decoys:
        return base, candidates, decoys
    held = _united(runs + [(s, e) for s, _, e, _ in base])
    for nth, c in enumerate(candidates):
        start, end, many = c["start"], c["end"], max(1, DECOYS // (nth + 1))
        length = end - start
        reach = min(3 * length + 20 * many, 8 * length)
        near = _letters(text, start - reach, start, held) + _letters(text, end, end + reach, held)
        # Each takes the test of its own alphabet, as the candidate did, and counts for the candidate's class.
        for at in range(0, len(near) - length + 1, max(1, (len(near) - length) // many))[:many]:
            if got := _tested(near[at:at + length]):
                decoys.append({"kind": c["kind"], "size": c["size"], "step": got["step"]})
    for k in range(GIVEN if len(text) >= SHORTEST else 0):
        seed = zlib.crc32(text[:4096].encode("utf-8", "surrogatepass"), k)
        length = math.ceil(SHORTEST * 1.25 ** (seed % 16))
        start = (seed >> 4) % len(text)
        near = _letters(text, start - length, start + 2 * length, held)[:length]
        if len(near) == length and (got := _tested(near)):
            decoys.append(got | {"kind": ""})
    return base, candidates, decoys


_TEST = "kind:string,size:int,step:int"


def _first_pass(ids: list, texts: list) -> dict[str, list]:
    seen = [_examine(t or "") for t in texts]
    return {"doc_id": ids,
            "base": [[{"start": s, "end": e, "kind": k} for s, _, e, k in x[0]] for x in seen],
            "candidates": [x[1] for x in seen], "decoys": [x[2] for x in seen]}


def _cuts(examined: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """Largest step of p to accept, by (encoding, length class). Some thousand counts at most come to the driver."""
    found, false = Counter(), Counter()
    for column, counts in (("candidates", found), ("decoys", false)):
        for r in (examined.select(F.explode(column).alias("t")).groupBy("t.kind", "t.size", "t.step")
                  .agg(F.count("*").alias("n")).collect()):
            counts[r["kind"], r["size"], r["step"]] = r["n"]
    return {c: step for c in {c[:2] for c in found} if (step := _cut(c, found, false, rate)) is not None}


def _cut(of: tuple[str, int], found: Counter, false: Counter, rate: float) -> int | None:
    own = [found[*of, step] for step in range(LAST_STEP + 1)]
    decoys = [false[*of, step] for step in range(LAST_STEP + 1)]
    total, plain = sum(own), sum(own[:PLAIN + 1])
    far, pooled = 0, False
    # Too few decoys to tell: were none to pass, what looks random could still not be declared.
    while plain and total > rate * plain * (1 + sum(decoys)) and far <= max(size for _, size, _ in (*found, *false)):
        pooled = True
        decoys = [0] * (LAST_STEP + 1)
        for (_, size, step), n in false.items():
            if abs(size - of[1]) <= far:
                decoys[step] += n
        far += 1
    passed = np.cumsum(own)
    expected = total * (1 + np.cumsum(decoys)) / (1 + sum(decoys))
    good = [step for step in range(LAST_STEP + 1) if own[step] and expected[step] <= rate * passed[step]
            and (step <= PLAIN or (not pooled and passed[step] * rate >= 1))]
    return max(good, default=None)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, end, kind; code points,
    end exclusive; base spans, and those with the random strings declared)."""
    spans = "array<struct<start:int,end:int,kind:string>>"
    examined = stage(scan(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), _first_pass,
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {spans}, "
        f"candidates array<struct<{_TEST},start:int,end:int>>, decoys array<struct<{_TEST}>>"), "examined")
    cuts = _cuts(examined, rate)
    order = {k: i for i, k in enumerate((*KINDS, RANDOM))}

    def declare(ids: list, base: list, candidates: list) -> dict[str, list]:
        out = []
        for b, cs in zip(base, candidates, strict=True):
            more = [{"start": c["start"], "end": c["end"], "kind": RANDOM} for c in cs
                    if c["step"] <= cuts.get((c["kind"], c["size"]), -1)]
            out.append(sorted(b + more, key=lambda s: (s["start"], order[s["kind"]], s["end"])))
        return {"doc_id": ids, "base": base, "spans": out}

    return scan(examined.select("doc_id", "base", "candidates"), declare,
                f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {spans}, spans {spans}", 4096)


def redacted(docs: DataFrame, text_col: str = "text", rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every declared span of ``text_col`` replaced by ``mark`` (touching and nested ones by one); other columns
    and all rows stay, a null text stays null. Two scans of the texts, no join."""
    def examine(texts: list) -> dict[str, list]:
        seen = [_examine(t or "") for t in texts]
        return {"candidates": [x[1] for x in seen], "decoys": [x[2] for x in seen]}

    examined = scan(docs.select(text_col), examine,
                    f"candidates array<struct<{_TEST},start:int,end:int>>, decoys array<struct<{_TEST}>>")
    cuts = _cuts(stage(examined.filter("size(candidates) + size(decoys) > 0"), "examined"), rate)

    def mask(text: str) -> str:
        base, candidates, _ = _examine(text, with_decoys=False)
        spans = [(s[0], s[2]) for s in base]
        spans += [(c["start"], c["end"]) for c in candidates if c["step"] <= cuts.get((c["kind"], c["size"]), -1)]
        out, at = [], 0
        for start, end in sorted(spans):
            if start > at or (start == at == 0):
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]

    return rewrite(docs, text_col, lambda texts: ([t if t is None else mask(t) for t in texts], None))


def digest(found: DataFrame) -> DataFrame:
    """The result of ``scan_secrets`` with counts and hashes of spans in place of the arrays."""
    def rows(ids: list, base: list, spans: list) -> dict[str, list]:
        import hashlib
        order = {k: i for i, k in enumerate((*KINDS, RANDOM))}
        text = [[spans_text([(s["start"], order[s["kind"]], s["end"], s["kind"]) for s in x]) for x in part]
                for part in (base, spans)]
        counts = {f"n_{k}": [sum(s["kind"] == k for s in b) for b in base] for k in KINDS}
        return {"doc_id": ids, **counts, "base_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in text[0]],
                "spans": text[1]}

    return scan(found.select("doc_id", "base", "spans"), rows,
                f"doc_id {found.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS)
                + ", base_sha256 string, spans string", 4096)
