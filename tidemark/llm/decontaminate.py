"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are maximal runs of letters, digits and non-ASCII characters, A-Z lowered. A document's
fingerprints are the smallest of every ``SPAN - GRAM + 1`` neighbouring ``GRAM``-word hashes. Two texts
that share ``SPAN`` words in a row share all grams in them, hence their smallest: no shared span of
that length goes unseen. Documents that share a fingerprint with an item are read again, and every
window of theirs that equals a window of an item, word for word, is a hit.

Nulls and odd inputs: a null or wordless text has no words and no hits. An item without words has no
window; an item without an id marks words but is not listed. Rows that repeat an id are separate
documents if their texts differ (equal rows give equal results); a repeated item id unites the windows
of its rows. Columns beyond id and text are not read. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import ascii_lower, small_or_not
from tidemark.session import stage

SPAN, GRAM = 10, 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _positions(n: Column, size: int) -> Column:
    """1 .. n - size + 1, or nothing."""
    return F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, n: Column, size: int) -> Column:
    return F.transform(_positions(n, size), lambda i: F.xxhash64(*[F.get(hashes, i + (k - 1)) for k in range(size)]))


def _winnowed(grams: Column, n: Column) -> Column:
    """Smallest gram of each full window."""
    width = SPAN - GRAM + 1
    return F.array_distinct(F.transform(
        _positions(n, SPAN), lambda i: F.least(*[F.get(grams, i + (k - 1)) for k in range(width)])))


def _fingerprints(df: DataFrame, short: list[int], keep: list[str]) -> DataFrame:
    """``keep``, n_words and prints: winnowed grams, and all grams of the lengths of short items."""
    df = df.select(*keep, words_of(F.col("_text")).alias("_words"))
    df = df.select(*keep, F.size("_words").alias("n_words"),
                   F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    df = df.withColumn("_grams", _grams(F.col("_hashes"), F.col("n_words"), GRAM))
    parts = [_winnowed(F.col("_grams"), F.col("n_words"))]
    parts += [F.array_distinct(_grams(F.col("_hashes"), F.col("n_words"), size)) for size in short]
    return df.select(*keep, "n_words", (F.concat(*parts) if short else parts[0]).alias("prints"))


def _windows(words: Column, size: int) -> Column:
    return F.transform(_positions(F.size(words), size), lambda i: F.struct(
        i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, size), " ").alias("key")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  keep_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a window of an item), n_items,
    items (their ids as strings, sorted as strings), contaminated; on request also _row, the hash of the text."""
    items = stage(benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
                  .filter(F.size("words") > 0), "bench-items")
    short = sorted(r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect())
    sizes = [*short, SPAN]
    windows = stage(items.select("item_id", F.explode(F.flatten(F.array(*[
        F.when(F.size("words") == s if s < SPAN else F.size("words") >= s, _windows(F.col("words"), s))
        .otherwise(F.array().cast("array<struct<at:int,size:int,key:string>>")) for s in sizes]))).alias("w"))
        .select("item_id", "w.size", "w.key").distinct(), "bench-windows")
    item_words = items.select(F.array_join("words", " ").alias("_text"), F.size("words").alias("_n"))
    known = [_fingerprints(item_words.filter(f"_n >= {SPAN}"), [], ["_text"])]
    known += [_fingerprints(item_words.filter(f"_n = {s}"), [s], ["_text"]) for s in short]
    prints = known[0].select("prints")
    for more in known[1:]:
        prints = prints.union(more.select("prints"))
    # Staged before explode: Spark would push the test for empty arrays below and evaluate all of it per element.
    prints = stage(prints, "item-prints").select(F.explode("prints").alias("print"))
    prints = small_or_not(stage(prints.distinct(), "bench-prints"))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    key = F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_row")
    base = stage(_fingerprints(texts.withColumn("_row", key), short, ["doc_id", "_row"]), "doc-prints")
    suspects = stage(base.select("doc_id", "_row", F.explode("prints").alias("print"))
                     .join(prints, "print", "left_semi").select("doc_id", "_row").distinct(), "suspects")

    chosen = small_or_not(suspects.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key")))
    again = (texts.withColumn("_row", key)
             .join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")), "left_semi")
             .select("doc_id", "_row", words_of(F.col("_text")).alias("_words")))
    own = again.select("doc_id", "_row", F.explode(F.flatten(F.array(*[_windows(F.col("_words"), s) for s in sizes])))
                       .alias("w")).select("doc_id", "_row", "w.at", "w.size", "w.key")
    places = stage(own.join(small_or_not(windows.select("size", "key").distinct(), 100_000), ["size", "key"], "left_semi")
                   .distinct(), "hits")

    # Words covered: each hit adds what lies beyond the end of those before it.
    before = Window.partitionBy("doc_id", "_row").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    covered = (places.withColumn("_seen", F.coalesce(F.max(end).over(before), F.lit(1)))
               .groupBy("doc_id", "_row")
               .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("at", "_seen"))).cast("long").alias("n_hit")))
    listed = (places.select("doc_id", "_row", "size", "key").distinct().join(windows, ["size", "key"])
              .groupBy("doc_id", "_row")
              .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    found = stage(covered.withColumnsRenamed({"doc_id": "_id", "_row": "_key"}), "covered")
    named = stage(listed.withColumnsRenamed({"doc_id": "_id", "_row": "_key"}), "listed")
    out = base.select("doc_id", "_row", "n_words")
    for part in (found, named):
        same = out["doc_id"].eqNullSafe(part["_id"]) & (out["_row"] == part["_key"])
        out = out.join(part, same, "left").drop("_id", "_key")
    out = (out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
           .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))
    row = ["_row"] if keep_row else []
    return out.select("doc_id", *row, F.col("n_words").cast("long").alias("n_words"), "n_hit",
                      F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
