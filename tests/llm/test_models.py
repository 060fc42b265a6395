"""Language, quality, licences, packing: held-out accuracy, round trips, small fixtures, odd inputs."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_texts import corpus
from tidemark.llm import language, licences, packing, quality
from tidemark.llm.common import components

# Language


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet").filter(language.training_part()))


def test_language_of_held_out_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, model).join(docs, "doc_id").filter(~language.training_part())
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()


def test_spans_of_mixed_text_and_scripts(spark):
    train = ([(i, "the house and the garden with this thing " * 3, "en") for i in range(5)]
             + [(10 + i, "le jardin et la maison avec cette chose " * 3, "fr") for i in range(5)]
             + [(20 + i, "дом и сад этот большой мир " * 3, "ru") for i in range(5)] + [(30, None, "xx"), (31, "the", None)])
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == ["en", "fr", "ru"]
    text = "the garden and the house with this thing. la maison et le jardin avec cette chose! дом и сад"
    rows = [(1, text), (2, None), (3, "12 !?\u0301"), (4, ""), (1, text)]
    got = language.identify(corpus(spark, rows), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[1:4]] == [("und", 0.0)] * 3
    assert got[0] == got[4] and 0 < got[0]["score"] < 1
    assert [s["lang"] for s in got[0]["spans"]] == ["en", "fr", "ru"]
    assert text[got[0]["spans"][1]["start"]:got[0]["spans"][1]["end"]] == "la maison et le jardin avec cette chose"
    kept = language.keep_identified(corpus(spark, rows), model, least_share=0.35)
    assert kept.columns == corpus(spark, rows).columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    nothing = language.learn(docs.limit(0))
    assert [r["lang_pred"] for r in language.identify(corpus(spark, rows), nothing).collect()] == ["und"] * 5
    assert language.identify(corpus(spark, rows).limit(0), model).collect() == []


def test_viterbi_like_plain_recursion():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 7, 3, 0, 12])
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    got = language.viterbi(scores, first, counts, 0.8)
    for f, n in zip(first, counts, strict=True):
        if not n:
            continue
        value, back = scores[f].astype(float), []
        for t in range(1, n):
            move = value[:, None] - 0.8 * (1 - np.eye(3))
            back.append(move.argmax(0))
            value = move.max(0) + scores[f + t]
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        total = lambda p: sum(scores[f + t, s] for t, s in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert total(got[f:f + n]) == pytest.approx(total(path[::-1]), abs=1e-4)


# Quality

def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    got = quality.score_quality(docs, train, F.col("source"), F.col("lang")).join(held, "doc_id").collect()
    good, bad = ([r["keep"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_sites_shrink_by_their_size(spark):
    rows = [(i, "plain words of one kind", "big" if i < 60 else "one", f"p{i % 2}") for i in range(61)]
    rows += [(100 + i, "plain words of one kind", "bad", "p0") for i in range(60)] + [(200, None, None, None), (201, "", "lone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumn("score", F.lit("x"))
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(999, 1), (None, 0), (5, None), (3, 1), (3, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels, F.col("host"), F.col("path")).collect()}
    assert len(got) == 123
    assert got[150]["site_rate"] < 0.2 < 0.8 < got[50]["site_rate"]
    assert 0.3 < got[60]["site_rate"] < 0.7 and 0.3 < got[200]["site_rate"] < 0.7  # no neighbours: near the corpus's rate
    blind = quality.score_quality(docs, labels.limit(0), F.col("host"), F.col("path")).collect()
    assert all(r["evidence"] == 0 and r["score"] == pytest.approx(0.5, abs=0.01) for r in blind)
    assert quality.score_quality(docs.limit(0), labels, F.col("host"), F.col("path")).collect() == []


# Licences

def test_licences_and_inheritance(spark):
    filler = "\n".join(f"line {i} of some source text that says nothing about rights" for i in range(20))
    rows = [("repo/LICENSE", "Released under the MIT License."), ("repo/a.py", filler),
            ("repo/sub/b.py", "Licensed under the Apache License, Version 2.0.\n" + filler), ("repo/sub/deep/c.py", filler),
            ("repo/other/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
            ("repo/other/d.py", filler), ("alone.py", filler), (None, filler), ("repo/n.py", None), ("repo/e.py", ""),
            ("repo/other/x/y/z.py", "licensed under the apache license version 2.0\n" + filler)]
    docs = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "doc_id long, p string, text string, own string")
    got = licences.scan_licences(docs, licences.templates(spark), F.col("p"))
    assert got.columns == ["doc_id", "n_lines", "own", "inherited", "license"]
    found = {rows[r["doc_id"]][0]: r for r in got.collect()}
    want = {"repo/LICENSE": "MIT", "repo/a.py": "MIT", "repo/sub/b.py": "Apache-2.0", "repo/sub/deep/c.py": "MIT",
            "repo/other/LICENSE": "GPL-3.0", "repo/other/d.py": "GPL-3.0", "alone.py": None, None: None, "repo/e.py": "MIT",
            "repo/other/x/y/z.py": "Apache-2.0"}
    assert {p: found[p]["license"] for p in want} == want
    assert found["repo/sub/b.py"]["inherited"] is None and found["repo/a.py"]["own"] is None
    assert found["repo/n.py"]["n_lines"] == 0
    assert licences.scan_licences(docs.limit(0), licences.templates(spark), F.col("p")).collect() == []


def _wrapped(text, width, mark):
    out, line = [], mark
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(line)
            line = mark
        line += " " + word
    return "\n".join([*out, line])


def test_headers_and_whole_licence_files(spark):
    filler = "\n\n".join(f"value {i} comes out of this function when nothing else is asked" for i in range(20))
    body = max((n for k, n in licences.NOTICES if k == "MIT"), key=len).removeprefix("MIT License ")
    gpl = next(n for k, n in licences.NOTICES if k == "GPL-3.0" and n.startswith("This program"))
    apache = next(n for k, n in licences.NOTICES if k == "Apache-2.0" and "Unless" in n)
    cut = [body[:body.index("The above")], body[body.index("The above"):body.index("THE SOFTWARE IS")], body[body.index("THE SOFTWARE IS"):]]
    mit = "MIT License\n\nCopyright (c) 2020 Jane Q Holder and others\n\n" + "\n\n".join(_wrapped(c, 70, "") for c in cut)
    rows = [("r/mit.txt", mit), ("r/gpl.py", _wrapped(gpl, 60, "#") + "\n\n" + filler), ("r/apache.c", _wrapped(apache, 60, " *") + "\n\n" + filler),
            ("r/owned.txt", "Copyright 2020 Foo. All rights reserved.\n" + filler), ("r/plain.txt", filler), ("r/" + "x" * 9, "copyright" + " " * 200_000),
            ("q/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + filler), ("q/a/b/c.py", filler)]
    docs = spark.createDataFrame(rows, "p string, text string")
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.templates(spark), F.col("p"), "p").collect()}
    assert {p: got[p]["own"] for p, _ in rows} == {
        "r/mit.txt": "MIT", "r/gpl.py": "GPL-3.0", "r/apache.c": "Apache-2.0", "r/owned.txt": "proprietary", "r/plain.txt": None,
        "r/" + "x" * 9: None, "q/COPYING": "GPL-3.0", "q/a/b/c.py": None}
    assert got["r/plain.txt"]["inherited"] == "MIT"  # the only file that is licence to a half
    assert got["q/a/b/c.py"]["inherited"] == "GPL-3.0"  # named as a licence file


def test_licences_of_repeated_rows(spark):
    rows = [(1, "d/x", "Licensed under the Apache License, Version 2.0.\nthree more words"), (2, "d/y", "nothing of it\nhere"), (3, "d/z", None), (3, "d/z", "")]
    schema = "doc_id long, p string, text string"
    run = lambda r: sorted(map(tuple, licences.scan_licences(
        spark.createDataFrame(r, schema), licences.templates(spark), F.col("p")).collect()), key=repr)
    once, twice = run(rows), run(rows + rows[:2])
    assert twice == sorted(once + [r for r in once if r[0] in (1, 2)], key=repr)
    assert (1, 2, "Apache-2.0", None, "Apache-2.0") in once and (2, 2, None, "Apache-2.0", "Apache-2.0") in once
    assert {r[1] for r in once if r[0] == 3} == {0, 1}


# Packing

def _counts(sizes):
    out = [0] * 1025
    for s in sizes:
        out[s] += 1
    return out


def test_completion_is_a_packing_and_near_the_bound():
    rng = random.Random(1)
    for draw in (lambda: rng.randint(1, 1024), lambda: rng.randint(200, 400), lambda: rng.choice([1024, 1, 513, 512, 340]),
                 lambda: rng.randint(300, 700)):
        for n in (0, 1, 30, 3000):
            counts = _counts(draw() for _ in range(n))
            packed = packing.complete(counts)
            used = [0] * 1025
            for times, filling in packed:
                assert sum(filling) <= 1024 and times > 0
                for s in filling:
                    used[s] += times
            bins = sum(t for t, _ in packed)
            assert used == counts and bins <= sum(t for t, _ in packing.best_fit(counts, 1024))
            assert packing.lower_bound(counts, 1024) <= bins <= 1.06 * packing.lower_bound(counts, 1024) + 1


def test_completion_beats_best_fit_where_it_is_wrong():
    counts = [0] * 11
    counts[6], counts[4], counts[3], counts[2] = 0, 4, 4, 2  # 4 4 2 | 4 4 2 | 3 3 3 | 3 is one too many for best fit
    assert sum(t for t, _ in packing.complete(counts, 10)) == packing.lower_bound(counts, 10) == 4


def test_pieces_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["word", "Été", "x1", "\n", "  ", "日本", "don't", "🙂"]) for _ in range(rng.choice([0, 3, 200, 900, 3000]))))
            for i in range(60)] + [(70, None), (None, "no id"), (5, "again"), (71, "a" * 120_000), (72, " " * 5000 + "x")]
    got = packing.pack(corpus(spark, rows), capacity=1024)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = got.collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start, length, k = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            part = ids[start:start + length]
            want.append((str(i), k, start, length, zlib.crc32(np.array(part, "<u4").tobytes())))
            start, length, k = start + length, 1024, k + 1
    assert sorted((str(r["doc_id"]), *r[1:5]) for r in found) == sorted(want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert packing.pack(corpus(spark, rows).limit(0)).collect() == []


# Components

def test_added_tokens_are_known_as_by_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\nb", "<|endoftext| >", "word " * 30_000 + "<|endoftext|> end"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.token_bytes(text), "<u4").tolist() == ids
    assert np.frombuffer(packing.token_bytes("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 299), (299, 301), (299, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {299: 299, 300: 299, 301: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []
