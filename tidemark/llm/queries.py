"""The registered queries of this package: thin callers of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import session
from tidemark.llm import (content_sort, decontaminate, infill, jaccard, language, licences, neighbours, packing, pii, quality, repeats,
                          secrets, variants)
from tidemark.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    found = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                  host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "score", "keep", "evidence", "site_rate")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(language.training_part()))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(~language.training_part(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return pii.digest(pii.scan_pii(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.templates(spark), path)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_units", "n_removed", places.alias("removed"), "text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    found = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = infill.restored(F.col("infilled"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("infilled", 256).alias("output_sha256"),
                        F.sha2(again, 256).alias("restored_sha256"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return variants.spelling_variants(table(spark, sf_dir, "documents"), typo_every=variants.TYPO_EVERY)


def op13_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    return content_sort.exact_copies(table(spark, sf_dir, "documents")).drop("_row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_neighbours": op3_neighbours,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_licences": op8_licences,
    "op9_repeats": op9_repeats,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_infill": op11_infill,
    "op12_variants": op12_variants,
    "op13_copies": op13_copies,
}
