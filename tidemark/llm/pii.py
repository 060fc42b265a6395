"""Personal data: patterns, and terms of their surroundings that give the protected value away.

Patterns give the base spans ``email``, ``ip``, ``card`` and ``phone``; they are always kept. Each distinct value
is a protected entity. Over all lines of the corpus, n(t) lines hold a term, n(e) an entity, n(e, t) both.
The information a term gives away about an entity is their pointwise mutual information; as a share of
the entity's own information content it says how much of the entity is disclosed:

    disclosure(t, e) = log2(n(e, t) N / (n(e) n(t))) / log2(N / n(e))

1 means that the term occurs with the entity only. In the lines of an entity, terms of at least
``remove`` disclosure are to be removed, terms of at least ``generalise`` to be generalised; both need the
pair in two different lines at least, as a single line shows no association.

Nulls and odd inputs: a null text is empty; rows that repeat an id are separate documents if their texts
differ (equal rows give equal results, and count as often as they occur); very long texts and lines are scanned
whole in linear time. Columns beyond id and text are not read. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import WORD, ascii_lower, ascii_lowered, scan, small_or_not, spans_text
from tidemark.llm.decontaminate import NOT_WORD
from tidemark.session import stage

KINDS = ("email", "ip", "card", "phone")
REMOVED, GENERALISED = "term", "hint"
_ORDER = {k: i for i, k in enumerate((*KINDS, REMOVED, GENERALISED))}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ back over the local part, but not into the match before: linear in any text."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(a, 0, b, "email") for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        found += [(m.start(), 3, m.end(), "phone") for m in _PHONE.finditer(text)
                  if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def _entity(text: str, start: int, end: int, kind: str) -> str:
    value = text[start:end]
    return f"{kind}:{ascii_lowered(value) if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def _contexts(text: str, base: list) -> list[dict]:
    """Each line that holds entities, with them and with the terms outside of all base spans."""
    out, at = [], 0
    while at < len(base):
        start = text.rfind("\n", 0, base[at][0]) + 1
        end = text.find("\n", base[at][2])
        end = len(text) if end < 0 else end
        own = []
        while at < len(base) and base[at][0] < end:
            own.append(base[at])
            at += 1
        entities = sorted({_entity(text, s, e, k) for s, _, e, k in own})
        line, terms, k, covered = ascii_lowered(text[start:end]), [], 0, 0
        for m in WORD.finditer(line):
            a, b = m.start() + start, m.end() + start
            while k < len(own) and own[k][0] < b:
                covered = max(covered, own[k][2])
                k += 1
            if a >= covered:
                terms.append({"term": m[0], "start": a, "end": b})
        out.append({"line": hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(),
                    "entities": entities, "terms": terms})
    return out


def _first_pass(ids: list, rows: list, texts: list) -> dict[str, list]:
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    return {"doc_id": ids, "_row": rows, "n_lines": [t.count("\n") + 1 for t in texts], "base": [[{"start": s, "end": e, "kind": k} for s, _, e, k in b] for b in bases],
            "contexts": [_contexts(t, b) if b else [] for t, b in zip(texts, bases, strict=True)]}


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.8,
             remove: float = 0.95, least_lines: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, end, kind; code points, end
    exclusive; ``spans`` also has the terms to be removed, ``term``, or generalised, ``hint``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start:int,end:int,kind:string>>"
    texts = docs.select(F.col(id_col).alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_row"), F.col(text_col).alias("_text"))
    first = stage(scan(texts, _first_pass, f"doc_id {kind}, _row long, n_lines long, base {spans}, contexts array<struct<line:binary,"
                       "entities:array<string>,terms:array<struct<term:string,start:int,end:int>>>>"), "pii")
    lines = first.select("doc_id", "_row", F.explode("contexts").alias("c"))
    held = lines.select("c.line", F.explode("c.entities").alias("entity"), "c.terms")
    met = (held.select("entity", "line", F.explode(F.array_distinct("terms.term")).alias("term"))
           .groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.min("line").alias("a"), F.max("line").alias("b")))
    met = stage(met.filter(f"a <> b and n_both >= {least_lines}").drop("a", "b"), "pii-met")

    # Lines of all texts that hold one of the terms met.
    wanted = small_or_not(stage(met.select("term").distinct(), "pii-terms"), 100_000)
    every = texts.select(F.explode(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("line"))
    n_term = (every.select(F.explode(F.array_distinct(F.split(ascii_lower(F.col("line")), NOT_WORD))).alias("term"))
              .join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term")))
    n_lines = F.lit(first.agg(F.sum("n_lines")).first()[0] or 0)
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    told = met.join(n_term, "term").join(n_entity, "entity").withColumn("disclosure", F.when(
        n_lines > F.col("n_entity"),
        F.log2(F.col("n_both").cast("double") * n_lines / F.col("n_entity") / F.col("n_term"))
        / F.log2(n_lines.cast("double") / F.col("n_entity"))))
    told = stage(told.filter(F.col("disclosure") >= generalise).select(
        "entity", "term", F.when(F.col("disclosure") >= remove, REMOVED).otherwise(GENERALISED).alias("kind")), "pii-told")

    places = (lines.select("doc_id", "_row", F.explode("c.entities").alias("entity"), "c.terms")
              .select("doc_id", "_row", "entity", F.explode("terms").alias("t"))
              .select("doc_id", "_row", "entity", "t.term", "t.start", "t.end")
              .join(told, ["entity", "term"]).groupBy("doc_id", "_row", "start", "end")
              .agg(F.max("kind").alias("kind")))  # "term" sorts after "hint"
    more = (places.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
            .withColumnsRenamed({"doc_id": "_id", "_row": "_key"}))
    base = first.select("doc_id", "_row", "base")
    out = base.join(more, base["doc_id"].eqNullSafe(more["_id"]) & (base["_row"] == more["_key"]), "left")
    return out.select("doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(spans))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The result of ``scan_pii`` with counts and hashes of spans in place of the arrays."""
    def rows(ids: list, base: list, spans: list) -> dict[str, list]:
        text = [[spans_text([(s["start"], _ORDER[s["kind"]], s["end"], s["kind"]) for s in x]) for x in part]
                for part in (base, spans)]
        counts = {f"n_{k}": [sum(s["kind"] == k for s in b) for b in base] for k in KINDS}
        return {"doc_id": ids, **counts, "base_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in text[0]],
                "spans": text[1]}

    return scan(found.select("doc_id", "base", "spans"), rows,
                f"doc_id {found.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS)
                + ", base_sha256 string, spans string", 4096)


def sanitise(text: str | None, spans: list[dict]) -> str | None:
    """``text`` with base spans replaced by their kind, hints by a placeholder, and telling terms taken out."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            continue
        out.append(text[at:s["start"]])
        out.append({REMOVED: "", GENERALISED: "[TERM]"}.get(s["kind"], f"[{s['kind'].upper()}]"))
        at = s["end"]
    return "".join(out) + text[at:]
