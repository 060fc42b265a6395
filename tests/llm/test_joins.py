"""Jaccard join, nearest neighbours and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_texts import LOWER, _hits, corpus
from tidemark import session
from tidemark.llm import jaccard, neighbours, secrets
from tidemark.llm.queries import QUERIES


def _grams(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def _groups(sets, percent=85):
    """Smallest index reachable from each set by links."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def _near_copies(rng, bases, copies, words):
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice(words))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            own = base[:]
            for _ in range(rng.randint(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 10 ** 6)}"
            rows.append(" ".join(own))
    return rows


def _check(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    got = jaccard.jaccard_groups(corpus(spark, list(zip(ids, texts, strict=True)))).collect()
    roots = _groups([_grams(t) for t in texts])
    least = defaultdict(list)
    for i, r in zip(ids, roots, strict=True):
        least[r].append(i)
    want = sorted((str(i), len(_grams(t)), str(min((x for x in least[r] if x is not None), default=None)))
                  for i, t, r in zip(ids, texts, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    return got


@pytest.mark.parametrize("words", [(1, 2, 4, 8, 12, 20), (30, 34, 38, 60, 68, 130, 140), (250, 300, 600)])
def test_links_like_brute_force(spark, words):
    _check(spark, _near_copies(random.Random(sum(words)), 25, 6, words))


def test_large_regions_are_cut_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TASK_SETS", 12)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rng = random.Random(9)
    chain = [f"w{i}" for i in range(200)]  # each text moves on from the last, so that ends are far apart
    texts = [" ".join(chain[:100 - 3 * i] + [f"c{j}" for j in range(3 * i)] + chain[100:]) for i in range(30)]
    texts += _near_copies(rng, 3, 60, (120,)) + _near_copies(rng, 2, 40, (14,))
    rng.shuffle(texts)
    _check(spark, texts)


def test_solver_like_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        texts = _near_copies(rng, rng.randint(1, 4), 8, (5, 9, 30, 80))
        assert jaccard.solve([jaccard.gram_set(t) for t in texts]).tolist() == _groups([_grams(t) for t in texts])


def test_cells_of_linked_sets_meet():
    rng = random.Random(6)
    for words in (6, 20, 31, 33, 36, 40, 65, 70, 127, 130, 300):
        for _ in range(40):
            a = {rng.getrandbits(60) for _ in range(words)}
            cut = rng.randint(0, len(a) * 15 // 100)
            b = set(rng.sample(sorted(a), len(a) - cut))
            while 100 * len(a & b) >= 85 * (len(a | b) + 1):
                if rng.random() < 0.3:
                    break
                b.add(rng.getrandbits(60))
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            x, y = jaccard.cells(x), jaccard.cells(y)
            for p, q in ((x, y), (y, x)):
                assert {c >> 1 for c in p if c & 1 == 0} & {c >> 1 for c in q}


def test_links_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text + " eight nine"), (3, text.upper()), (None, text), (None, "a b"), (None, "a  B"), (8, None), (9, ""),
            (10, " \n"), (11, "x"), (12, "X"), (5, text)]
    got = _check(spark, [t for _, t in rows], [i for i, _ in rows])
    assert sum(r["first"] for r in got if r["n_shingles"] == 4) == 1  # the equal texts' smallest id
    assert jaccard.jaccard_groups(corpus(spark, rows).limit(0)).collect() == []


def test_query_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    roots = _groups([_grams(r["text"]) for r in docs])
    want = {r["doc_id"]: docs[k]["doc_id"] for r, k in zip(docs, roots, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op10_jaccard_join"](spark, SF).collect()} == want


# Nearest neighbours

def test_files_meet_in_shards():
    n = neighbours.BLOCK
    held = [10, n - 10, 1, 3 * n + 1, 5, 0, n, 7]
    first, blocks = neighbours._shards(held)
    assert first == [0, 0, 1, 2, 6, 6, 7, 8] and blocks == [1, 1, 1, 4, 1, 1, 1, 1]


def test_queries_of_a_shard_come_in_pieces():
    asks = neighbours._ASKS
    rows = [(0, 1, 5), (0, asks, 6), (1, asks, 7), (2, 3, 8), (3, 4, 9)] + [(3, asks, i) for i in range(600)]
    batches = [pa.RecordBatch.from_pydict(dict(zip("scv", zip(*rows[i:i + 100], strict=True), strict=True)))
               for i in range(0, len(rows), 100)]
    got = [(own, [len(p) for p in asking]) for own, asking in neighbours._shard_groups(iter(batches))]
    assert got == [([(1, 5)], [1]), ([(3, 8)], []), ([(4, 9)], [256, 256, 88])]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(5000 + i, base[0].tolist()) for i in range(40)] + [(6000, base[1].tolist()), (6000, base[1].tolist())]
    odd = [(7000, None), (7001, []), (7002, [0.0] * 24), (7003, [float("nan")] * 24), (7004, [None] * 24), (None, base[2].tolist()),
           (7100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("k1", F.lit(2))
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    ids = [i for i, _ in dict(rows).items()]
    vectors = [list(map(float, dict(rows)[i])) for i in ids]
    assert set(got) == {i for i in ids if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        at = ids.index(q)
        want = neighbours.exact(vectors[at], ids[:at] + ids[at + 1:], vectors[:at] + vectors[at + 1:])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(np.linalg.norm(np.array(vectors[at]) - np.array(vectors[ids.index(v)])), abs=1e-9)
                   for _, s, v in found)
        hit += len({v for _, _, v in found} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(got)
    assert [v for _, _, v in got[0]] == list(range(5000, 5010))  # ties go to the smaller id


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, pytest.approx(2 ** 0.5)), (100, 1, 0, 0.0), (100, 2, 1, pytest.approx(2 ** 0.5))]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.nearest(df.limit(1), F.col("vec_id") % 100 == 0).collect() == []


def test_repeated_rows_hide_no_ids(spark):
    ids = [0] * 30 + [i for i in range(1, 15) for _ in range(3)]
    df = spark.createDataFrame([(100 * (i == 0) + i, [1.0, 2.0]) for i in ids] + [(500, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id").isin(1, 14, 100)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    every = [*range(1, 15), 100]
    assert {q: sorted(x) for q, x in got.items()} == {
        q: [(k + 1, i, 0.0) for k, i in enumerate([i for i in every if i != q][:10])] for q in (1, 14, 100)}
    low = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "vec_id long, embedding array<double>")
    found = neighbours.nearest(low, F.col("vec_id") == 14).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(10))


# Pipeline

def test_near_copies_of_five_words_go(spark):
    rng = random.Random(21)
    texts = _near_copies(rng, 20, 8, (9, 30, 46, 50, 90, 100, 140, 300))
    base = [f"b{i}" for i in range(50)]
    texts += [" ".join(base), " ".join([*base[:25], "other", *base[26:]])]  # 41 of 51 5-grams, 43 of 51 4-grams
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    grams = [_grams(t, 5) for t in texts]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert got == set(_groups(grams, 80))
    assert got != set(_groups([_grams(t) for t in texts]))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10 ** 6, "123 456 !!", "en", "s", 10), (10 ** 6 + 1, None, "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    for name in ("_id", "_key", "_row", "n_words", "spans", "component_id"):
        docs = docs.withColumn(name, F.lit("x"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = out.collect()
        if name != "pack":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language":
            assert set(before) - set(after) == {10 ** 6, 10 ** 6 + 1}
        if name == "near_duplicates":
            ids = sorted(before)
            assert set(after) == {ids[k] for k in _groups([_grams(before[i]["text"], 5) for i in ids], 80)}
        if name == "decontaminate":
            assert set(before) - set(after) == {i for i, r in before.items() if _hits(r["text"], items)[1]}
        if name == "secrets":
            assert set(after) == set(before)
            assert all(not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
        if name == "pack":
            assert {r["doc_id"] for r in rows} == set(before)
        docs = out


def test_near_copies_keep_one_of_equal_rows_and_need_no_other_column(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None), (None, "x y z"), (None, "x y z"), (4, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()  # the next stage ends what this one has staged
    got = spark.createDataFrame(kept, docs.schema)
    assert sorted(map(tuple, kept), key=repr) == sorted(
        [(1, "a b c d e f g"), (3, None), (None, "x y z"), (4, "p q")], key=repr)
    assert sorted(r["text"] or "" for r in corpus_pipeline.mask_secrets(spark, got, SF).collect()) == ["", "a b c d e f g", "p q", "x y z"]
    none = docs.filter("doc_id = 99")
    for name, stage in corpus_pipeline.STAGES:
        if name != "language":  # which learns from the column lang
            assert stage(spark, none, SF).count() == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _held_shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_shuffle_files_end_with_the_write_they_are_for(spark):
    """They stayed until the driver collected garbage: those of all tables of near_duplicates lay on disk at once."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    try:
        rows = spark.range(1000).withColumn("k", F.col("id") % 7)
        held = _held_shuffles(spark)
        sums = session.stage(rows.groupBy("k").agg(F.sum("id").alias("s")), "sums")
        again = session.stage(sums.join(rows.repartition(3, "k"), "k").groupBy("s").count(), "again")
        assert _held_shuffles(spark) <= held
        assert spark.conf.get(setting) == "false"  # the session's own
        assert sorted(r["count"] for r in again.collect()) == [142] * 1 + [143] * 6
    finally:
        spark.conf.unset(setting)


def test_regions_are_not_written_with_their_sets_again(spark, monkeypatch):
    """Of a large region that single n-grams cut, the sets are written once; the rest of its tables hold ids."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} " + " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(30)) for _ in range(40)]
    texts += [t + " more" for t in texts[:5]]
    monkeypatch.setattr(jaccard, "TASK_SETS", 8)
    written = []
    monkeypatch.setattr(jaccard, "stage", lambda df, name: written.append((name, df.columns, (out := session.stage(df, name)).count())) or out)
    _check(spark, texts)
    assert [(name, rows) for name, columns, rows in written if {"key", "grams"} <= set(columns) and rows] == [("jaccard-large", 45)]
