"""Exact copies, fill-in-the-middle samples and spelling variants against brute force; their SQL is compared in test_texts.py."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_texts import corpus
from tidemark.llm import content_sort, infill, variants
from tidemark.llm.queries import QUERIES

NEW = ["op11_infill", "op12_variants", "op13_copies"]


@pytest.mark.parametrize("name", NEW)
def test_empty_tables_and_clashing_columns(spark, tmp_path, name):
    schema = "text string, n long, form string, kept boolean, _row long, doc_id long, edge binary, part int, content binary, infilled string"
    rows = [(None, 1, "x", True, 5, 1, None, 2, b"a", "y"), ("", 1, "x", True, 5, None, None, 2, b"a", "y"),
            ("ab ab\nab", 1, "x", True, 5, 2, None, 2, b"a", "y")]
    for k, data in enumerate(([], rows)):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = QUERIES[name](spark, f"{tmp_path}/{k}").collect()
        assert len(got) == (0 if name == "op12_variants" else len(data))


# ---- exact copies

def _copies(rows):
    """{(id, text): ...} by brute force: keep_id, size, digest per row, and how many rows are kept of each id."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for doc_id, text in rows:
        content = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        out.append((doc_id, min(groups[content])[2], len(groups[content]), hashlib.sha256(content.encode()).hexdigest()))
    return out, len(groups)


def _check_copies(spark, rows, partitions=4):
    got = content_sort.exact_copies(corpus(spark, rows).repartition(partitions)).collect()
    want, groups = _copies(rows)
    assert sorted(map(tuple, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got)), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_copies_differ_in_white_space_only(spark):
    _check_copies(spark, [(5, "a b"), (4, "ab"), (3, "a\tb"), (9, "a  b"), (7, "a\x0bb "), (1, "a b"), (2, "aB"), (10, None), (11, ""),
                          (12, " \n"), (13, "b"), (None, "a  b"), (None, "zz"), (14, "ä"), (15, "ä"), (14, "ä"), (16, "日 本"), (17, "日本")])


def test_a_group_spans_partitions(spark):
    rng = random.Random(4)
    long = "same beginning of every text " * 20
    rows = [(i, long + "copy") for i in range(600)] + [(1000 + i, long + f"{rng.randint(0, 150)}") for i in range(600)]
    rows += [(2000 + i % 7, long + "x " * (i % 3)) for i in range(300)] + [(3000, "q" * 300_000), (3001, "q" * 299_999 + " q")]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check_copies(spark, rows, 8)
        spread = content_sort.stage(content_sort.exact_copies(corpus(spark, rows)), "test")
        assert spread.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_with_equal_hashes_are_told_apart():
    runs = content_sort._Runs(0, None)
    for k, content in enumerate([b"a", b"a", b"b", b"b", b"c"]):
        runs.add(("p", 1 if content != b"c" else 2), content, k, 0)
    runs.close(edge=True)
    assert [(r[0], r[3], r[4], r[5], r[8]) for r in runs.out] == [
        (0, 0, 0, 2, b"a"), (1, 0, 0, 2, None), (2, 1, 2, 2, b"b"), (3, 1, 2, 2, None), (4, 2, 4, 1, b"c")]


def test_documents_without_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (1, "a b", "x"), (None, None, "z"), (4, "", "w")],
                                 "doc_id long, text string, kept string")
    got = content_sort.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a b"), (4, "")]


# ---- fill in the middle

def _infilled(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _texts(rng):
    passage = "".join(rng.choice("abcdé 日\n") for _ in range(3000))
    out = [None, "", "\n", "a", "a\n", "\n\n", "a\n\nb", "x <P> y\nz", "<S", "<M\n>", "\r\n\r\n", "ends in <P\n", "€" * 5000, "\n" * 20_000]
    for _ in range(60):
        own = "".join(rng.choice("efghö €\n") for _ in range(rng.randint(0, 1500)))
        out.append(own + passage[rng.randint(0, 900):rng.randint(1500, 3000)] + own[::-1])
    return [*out, passage * 60]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_samples_like_brute_force(spark, rate, spm):
    rng = random.Random(rate + spm)
    rows = list(enumerate(_texts(rng))) + [(None, "a\nb\nc\n"), (3, "u\nv\nw")]
    docs = corpus(spark, rows).withColumn("n", F.lit("taken over")).withColumn("_all", F.lit(1))
    got = infill.infill(docs, rate=rate, spm=spm).withColumn("again", infill.restored(F.col("infilled"), F.col("form")))
    found = got.collect()
    assert "_all" in got.columns and got.columns.count("n") == 1
    assert (sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["infilled"]) for r in found), key=repr)
            == sorted(((i, *_infilled(i, t, rate, spm)) for i, t in rows), key=repr))
    assert all(r["again"] == (r["text"] or "") for r in found)


def test_chunks_tile_and_are_shared():
    rng = random.Random(3)
    common = rng.randbytes(60_000)
    a, b = rng.randbytes(777) + common, rng.randbytes(3001) + common
    for raw in (b"", b"a", a, b, b"a" * 50_000, b"\n" * 9000, common[:256], common[:257]):
        ends = infill.chunk_ends(raw)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(raw) and (sizes[:-1] >= infill.LEAST).all() and (sizes <= infill.MOST).all()
    memo = infill.Memo()
    infill.Lines(a, memo)
    seen = memo.hits
    infill.Lines(b, memo)
    assert memo.hits - seen > 0.8 * len(infill.chunk_ends(a))


def test_forgetting_changes_nothing():
    rng = random.Random(5)
    texts = [(t or "").encode() for t in _texts(rng)]
    whole, little, none = infill.Memo(), infill.Memo(3000), infill.Memo(0)
    for raw in texts * 2:
        lines = [infill.Lines(raw, m) for m in (whole, little, none)]
        assert len({x.n for x in lines}) == 1
        for k in range(0, lines[0].n + 1, 1 + lines[0].n // 50):
            assert len({x.cut(k) for x in lines}) == 1
    assert little.size <= 3000 and none.size == 0 and whole.hits > little.hits


# ---- spelling variants

def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows, typo_every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def _words(rng):
    base = ["".join(rng.choice("abcdeàÿ") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.2)), 24)]
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcÀÿ") + w[k:], w[:k] + rng.choice("abÉz") + w[k + 1:]])
            words.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i % 280, rng.choice([" ", "1", "\n", "ā", "-"]).join(words)))
    return [*rows, (None, "abcde " * 4), (7, None), (8, ""), (9, "x" * 20_000), (10, "x" * 20_000), (11, "x" * 20_000 + " " + "x" * 19_999),
            (12, "x" * 19_999), (13, "x" * 19_999)]


@pytest.mark.parametrize("typo_every,filter_bytes,bits", [(97, 64 << 20, 16), (7, 64, 16), (None, 320, 1)])
def test_variants_like_brute_force(spark, typo_every, filter_bytes, bits):
    rows = _words(random.Random(bits))
    got = variants.spelling_variants(corpus(spark, rows), typo_every=typo_every, filter_bytes=filter_bytes, bits=bits)
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()),
                  key=repr) == _variants(rows, typo_every)


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 20))) for _ in range(20_000)})
    inside = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    shape = variants.Shape(Counter(len(w) for w in words[::2]))
    filters = np.zeros((shape.blocks, 8), np.uint64)
    for r in variants._blocks(inside, shape).collect():
        filters[r["block"]] = np.array(r[1:], np.int64).view(np.uint64)
    held = set()
    with np.errstate(over="ignore"):
        for length, letters, own in variants._by_length(words):
            key = variants._key(variants._sums(letters)[0][:, -1], length)
            held |= {own[k] for k in variants._held(filters, 0, key, length, shape)}
    assert set(words[::2]) <= held and len(held - set(words[::2])) < 0.02 * len(words)


def test_edit_hashes_are_those_of_the_edits():
    letters = np.frombuffer("straßen".encode("latin-1") + "anderes".encode("latin-1"), np.uint8).reshape(2, 7)
    with np.errstate(over="ignore"):
        sums, _ = variants._sums(letters)
        shorter = sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * np.uint64(variants._UNBASE)
        for row, word in enumerate(("straßen", "anderes")):
            for k in range(7):
                own = np.frombuffer((word[:k] + word[k + 1:]).encode("latin-1"), np.uint8)[None]
                assert variants._sums(own)[0][0, -1] == shorter[row, k]


def test_roots_follow_a_chain(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("b", "a")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.roots(forms).collect()}
    assert got == {**{f"w{i:03}": "w037" for i in range(37)}, "b": "a"}
