"""Decontamination, secrets, personal data and repeats: brute force on small corpora, and odd inputs."""

import random
import re

import duckdb
import pytest

from tests.conftest import SF
from tidemark.llm import decontaminate, pii, repeats, secrets
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n_words long, _row string, start int, _id string, key string, items string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 7, "r", 1, "s", "k", "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# Decontamination

def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _hits(text, items):
    words, hit, found = _words(text), set(), set()
    for item_id, own in items:
        w = _words(own)
        size = min(10, len(w))
        windows = {tuple(w[p:p + size]) for p in range(len(w) - size + 1)} if w else set()
        for p in range(len(words) - size + 1):
            if w and tuple(words[p:p + size]) in windows:
                hit.update(range(p, p + size))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_decontamination_like_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "é1", "x", "zwölf"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 7, 9, 10, 11, 14, 30]))) for i in range(6)] + [(6, "?!"), (7, None), (6, text(12))]
    docs = [(i, text(rng.choice([0, 1, 5, 9, 12, 40, 200]))) for i in range(40)]
    docs += [(50 + i, text(20) + ", " + items[i % 6][1] + " - " + text(15)) for i in range(8)]
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, items[3][1]), (92, text(30)), (93, docs[5][1]), (93, docs[5][1])]
    got = decontaminate.decontaminate(corpus(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((str(i), *_hits(t, items)) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).collect() == []
    some = corpus(spark, [(1, "a b c")])
    assert [r["n_hit"] for r in decontaminate.decontaminate(some, items.limit(0)).collect()] == [0]


def test_winnowing_selects_a_gram_of_every_shared_span(spark):
    rng = random.Random(1)
    shared = [str(rng.random()) for _ in range(10)]
    rows = [" ".join([str(rng.random()) for _ in range(rng.randint(0, 20))] + shared
                     + [str(rng.random()) for _ in range(rng.randint(0, 20))]) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, _text string")
    prints = [set(r["prints"]) for r in decontaminate._fingerprints(df, [], ["doc_id"]).collect()]
    assert all(a & b for a in prints for b in prints)


# Secrets

def _naive_secrets(text):
    out = []
    spec = ((0, "assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             lambda m: len(m[2]) >= 6),
            (1, "access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            (2, "hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    for k, kind, pattern, ok in spec:
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def test_base_secrets_like_the_patterns():
    rng = random.Random(3)
    parts = ["password", "PassWD", "token", "api_key", "apikey", "ſecret", "=", ":", " ", "'", '"', "abc123", "AKIA", "AKIA" + "Z9" * 9,
             "0123456789abcdef" * 2, "f" * 23, "é", "\n", "x.y", "-", "KEY"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == _naive_secrets(text)


def _key(rng, chars, n):
    return "".join(rng.choice(chars) for _ in range(n))


@pytest.fixture(scope="module")
def keyed():
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: "".join(rng.choice(["tion", "the", "er", "an", "in", "ou", "re", "st", "nd"]) for _ in range(rng.randint(1, 9)))
    rows = []
    for i in range(400):
        key = _key(rng, chars, 40) if i % 2 else ""
        rows.append((i, " ".join(word() for _ in range(60)) + f" {key} " + " ".join(word() for _ in range(60)), key))
    return rows


def test_randomness_finds_keys_and_leaves_words(spark, keyed):
    found = {r["doc_id"]: r for r in secrets.scan_secrets(corpus(spark, [r[:2] for r in keyed])).collect()}
    hit = sum(bool(key) and any(text[s["start"]:s["end"]] == key for s in found[i]["spans"]) for i, text, key in keyed)
    false = sum(s["kind"] == "random" and text[s["start"]:s["end"]] != key for i, text, key in keyed for s in found[i]["spans"])
    assert hit >= 0.8 * sum(bool(k) for _, _, k in keyed)
    assert false <= 0.05 * hit


def test_redaction_keeps_all_else(spark, keyed):
    rows = [(i, t) for i, t, _ in keyed] + [(900, "token = abcdef12 end"), (901, None), (None, "password: hunter22"),
                                             (902, ""), (903, "secret=aaaaaaaaaaaa" + "b" * 20), (904, "AKIA" + "A" * 16)]
    docs = corpus(spark, rows)
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[900] == "[SECRET] end" and got[901] is None and got[None] == "[SECRET]" and got[902] == ""
    assert got[903] == "[SECRET]" and got[904] == "[SECRET]"
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    for i, t in rows[:50]:
        at, want = 0, ""
        for s in found[i]:
            want += t[at:s["start"]] + "[SECRET]"
            at = s["end"]
        assert got[i] == want + t[at:]


def test_strings_behind_names_are_tested():
    rng = random.Random(12)
    for name in ("AWS_SECRET_ACCESS_KEY", "DB_KEY", "https://x.example/a?id=7&sig", "key"):
        for pad in ("", "=", "=="):
            key = _key(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 44) + pad
            text = f"run {name}={key} or {name}: {key}\n"
            found = [text[c["start"]:c["end"]] for c in secrets._examine(text)[1]]
            assert found.count(key) == 2, (name, found)
    # What a base span leaves of a run is tested.
    left, right = (_key(rng, "GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz", 40) for _ in range(2))
    digits = "0123456789abcdef" * 2
    text = f"{left}{digits}{right} end"
    base, candidates, _ = secrets._examine(text)
    assert [text[s:e] for s, _, e, _ in base] == [digits]
    assert [text[c["start"]:c["end"]] for c in candidates] == [left, right]


def test_a_lone_key_needs_no_companions(spark):
    rng = random.Random(13)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["tion", "the", "er", "an", "in", "ou", "re", "st", "nd", "Wh"]
    text = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n))
    hit = false = 0
    for _ in range(6):
        key = _key(rng, chars, 64)
        rows = [(i, text(60)) for i in range(30)] + [(99, text(20) + f" {key} " + text(20))]
        rows.append((100, "NAME=" + _key(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 52)))  # no words around it
        got = {r["doc_id"]: [rows_text[s["start"]:s["end"]] for s in r["spans"] for rows_text in [dict(rows)[r["doc_id"]]]]
               for r in secrets.scan_secrets(corpus(spark, rows)).collect()}
        hit += (key in got[99]) + (rows[-1][1][5:] in got[100])
        false += sum(len(v) for i, v in got.items() if i < 99)
    assert hit >= 11 and false <= 1


def test_secrets_of_odd_texts(spark):
    docs = corpus(spark, [(1, None), (1, ""), (None, "a" * 200_000), (2, "token" + " " * 100_000), (3, "9" * 50_000)])
    got = secrets.digest(secrets.scan_secrets(docs))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted((r["n_assign"], r["n_access"], r["n_hex"]) for r in got.collect()) == [(0, 0, 0)] * 3 + [(0, 0, 1)] * 2
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


# Personal data

def _naive_pii(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_personal_data_like_the_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", "+", "%", " ", "4111111111111111", "4111 1111 1111 1111", "12", "255", "256", "007", "(0)", "é", "\n",
             "x@y.zz", "1.2.3.4", "+49 30 1234567", "0"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == _naive_pii(text), text


def test_telling_terms_are_added(spark):
    noise = [(100 + i, f"common words here number w{i} and more common words") for i in range(60)]
    rows = [(1, "common Zorgblat works with bob@corp.example here"), (2, "mail bob@corp.example or ask zorgblat about words"),
            (3, "single qqterm with eve@corp.example common")]
    docs = corpus(spark, rows + noise)
    got = {r["doc_id"]: r for r in pii.scan_pii(docs).collect()}
    text = dict(rows)
    terms = {i: [text[i][s["start"]:s["end"]].lower() for s in got[i]["spans"] if s["kind"] in ("term", "hint")] for i in text}
    assert "zorgblat" in terms[1] and "zorgblat" in terms[2]
    assert "common" not in terms[1] and "here" not in terms[1] and terms[3] == []
    assert all(s in got[i]["spans"] for i in got for s in got[i]["base"])
    clean = pii.sanitise(rows[0][1], [s.asDict() for s in got[1]["spans"]])
    assert "bob" not in clean and "Zorgblat" not in clean and "[EMAIL]" in clean and "common" in clean


def test_personal_data_of_odd_texts(spark):
    docs = corpus(spark, [(1, None), (1, ""), (1, "x@y.zz"), (None, "1.2.3.4"), (2, "7" * 100_000), (3, "a" * 100_000 + "@b.cc"),
                          (4, "x@y.zz"), (4, "x@y.zz")])
    got = sorted(tuple(r)[1:5] for r in pii.digest(pii.scan_pii(docs)).collect())
    assert got == [(0, 0, 0, 0)] * 3 + [(0, 1, 0, 0)] + [(1, 0, 0, 0)] * 4
    assert pii.scan_pii(docs.limit(0)).collect() == []


# Repeats

def test_units_tile_the_text():
    for text in ("", "a", "One two. Three!\n\n four? five", "\n\n", "no end", "a.b c.  d\n"):
        tiles = repeats.units(text) if text else []
        assert "".join(text[a:b] for a, b in tiles) == text


def test_repeats_stay_once(spark):
    passage = "This passage is long enough to count. And here is its second sentence for all."
    rows = [(3, "Intro of three words that is here. " + passage), (2, f"mid line {passage} Tail of two which is long."),
            (5, passage.upper()), (7, "short. short. short."), (8, None), (None, passage), (9, ""),
            (10, "Twice in one document is this. Twice in one document is this.")]
    docs = corpus(spark, rows)
    out = repeats.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_units", "n_removed", "removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] == rows[1][1] and got[7]["text"] == rows[3][1] and got[8]["text"] is None and got[9]["text"] == ""
    # Document 2 is the earliest; its first sentence has other words before it, so only the second is equal.
    assert got[3]["text"] == "Intro of three words that is here. This passage is long enough to count. "
    assert got[5]["text"] == "" and got[None]["text"] == ""
    assert got[10]["text"] == "Twice in one document is this. "
    for i, text in rows:
        kept, at = "", 0
        for s in got[i]["removed"]:
            kept += text[at:s["start"]]
            at = s["end"]
        assert (text is None and got[i]["text"] is None) or kept + text[at:] == got[i]["text"]


def test_repeats_of_odd_tables(spark):
    rows = [(1, "equal rows of one document here."), (1, "equal rows of one document here."),
            (None, "no id has this unit of words."), (None, "no id has this unit of words. more"), (2, "no id has this unit of words, but two")]
    docs = corpus(spark, rows)
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect()]
    # One of the equal rows stays whole, and one of those without an id.
    assert sorted(g[1:] for g in got if g[0] == 1) == [("", 1), (rows[0][1], 0)]
    assert sorted(n for i, _, n in got if i is None) == [0, 1] and (2, rows[4][1], 0) in got
    assert {t for i, t, _ in got if i is None} in ({rows[2][1], "more"}, {rows[3][1], ""})
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_repeats_without_blanks(spark):
    passage = "\u6211\u4eec\u5728\u8fd9\u91cc\u5199\u4e86\u4e00\u6bb5\u5f88\u957f\u7684\u6587\u5b57\u3002"
    rows = [(1, passage + "\u7b2c\u4e00\u3002"), (2, "\u5f00\u59cb\u3002" + passage * 2), (3, "\u7b2c\u4e00\u3002")]
    got = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(corpus(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\u5f00\u59cb\u3002", 3: rows[2][1]}  # short units stay


def test_repeats_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, f"this unit is in every document. own words of number {i} are here.") for i in range(20)]
    want = sorted(map(tuple, repeats.remove_repeats(corpus(spark, rows)).select("doc_id", "text", "n_removed").collect()))
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 3)
    got = sorted(map(tuple, repeats.remove_repeats(corpus(spark, rows)).select("doc_id", "text", "n_removed").collect()))
    assert got == want and sum(n for _, _, n in got) == 19

