"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is a log odds: shape features of its text (shares of letters, capitals, digits, marks,
distinct words, repeated lines, lengths) fall into fixed bins, and each bin's odds are counted among labelled
documents. Its site adds what is known of its neighbours: a host's rate of good documents is shrunk
towards the corpus's, a path's towards its host's, each as far as its count is small against the spread between
sites (Beta priors whose strength comes from the moments of the rates). A document with a label counts as such, others
by their own evidence, and no document counts as its own neighbour. The score is the
posterior probability: logit(score) = logit(rate of path without the document) + evidence.

Everything from the corpus is a grouped sum: by bin and label, by host, by path. Bins are a table of fixed size; sites
are joined as staged tables, so Spark broadcasts them only if they are small, and splits a host of a third of all rows.

Nulls and odd inputs: a null text is an empty one; a null host or path is a site of its own; null labels are no
labels, several labels of an id count as their mean (0.5 and more: good), labels of ids that are null or not there are
ignored. Equal rows count as often as they occur. No labels: all scores are those of even odds and an empty evidence.
Columns beyond those named are not read. No rows: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import scan
from tidemark.session import stage

#: Bins per feature: shares fall into steps of their square root, sizes into powers of two.
BINS = 16
FEATURES = ("upper", "lower", "digit", "mark", "bar", "blank", "non_ascii", "distinct", "repeated", "capital_words",
            "stutter", "word_length", "line_words", "words", "marked_words")

_CLASS = np.zeros(256, np.uint8)
for _code in range(256):
    _c = chr(_code)
    _CLASS[_code] = (6 if _code >= 128 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit()
                     else 5 if _c.isspace() else 4 if _c in "|#*%&$@<>{}[]=~^_\\/" else 3)


def shape(text: str) -> list[int]:
    """A bin for each of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7, np.int64)
    total = max(1, len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    endings = sum(w[-1] in b"!#%&$*|" for w in words)
    shares = [*(classes[[0, 1, 2, 3, 4, 5, 6]] / total), len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)),
              sum(w.isupper() for w in words) / n, sum(map(bytes.__eq__, words, words[1:])) / n]
    sizes = [len(raw) / n, n / max(1, len(lines)), len(words)]
    bins = [min(BINS - 1, int(math.sqrt(s) * BINS)) for s in shares]
    bins += [min(BINS - 1, int(math.log2(1 + s))) for s in sizes]
    return [*bins, min(BINS - 1, int(math.sqrt(endings / n) * BINS))]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: Column) -> float:
    """Strength of the Beta prior of sites (a of n good, around ``mean``) by moments; at least 1, at most 10,000."""
    rate = F.col("a") / F.col("n")
    got = sites.filter("n >= 2").agg(
        F.sum(F.col("n") * (rate - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("whole")).first()
    if not got["whole"]:
        return 10.0
    spread = (got["between"] - got["noise"]) / got["whole"]  # share of the variance that is between sites
    return min(10_000.0, max(1.0, 1 / spread - 1)) if spread > 0 else 10_000.0


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", temper: float = 0.5,
                  threshold: float = 0.2) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence (log odds of the text alone), site_rate (posterior of
    its path without it), score, keep (score of ``threshold`` and more). ``temper`` weighs the features' summed log odds,
    which are not independent."""
    kind = docs.schema[id_col].dataType.simpleString()

    def examine(ids: list, hosts: list, paths: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "host": hosts, "path": paths, "bins": [shape(t or "") for t in texts]}

    named = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), text_col)
    shapes = scan(named, examine, f"doc_id {kind}, host string, path string, bins array<int>")
    marks = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg((F.avg(label_col) >= 0.5).cast("int").alias("label")))
    shapes = stage(shapes.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "shapes")

    counted = (shapes.filter("label is not null").select("label", F.posexplode("bins").alias("feature", "bin"))
               .groupBy("feature", "bin", "label").agg(F.count("*").alias("n")).collect())  # features x bins x 2
    seen = np.full((len(FEATURES), BINS, 2), 0.0)
    for r in counted:
        seen[r["feature"], r["bin"], r["label"]] = r["n"]
    totals = seen[0].sum(0)
    odds = np.log((seen + 0.5) / (totals + 0.5 * BINS))
    odds = temper * (odds[:, :, 1] - odds[:, :, 0]) if totals.min() > 0 else np.zeros(odds.shape[:2])
    evidence = F.lit(0.0)
    for i in range(len(FEATURES)):
        row = F.array(*[F.lit(float(x)) for x in odds[i]])
        evidence = evidence + F.element_at(row, F.get("bins", F.lit(i)) + 1)
    base = float((totals[1] + 0.5) / (totals.sum() + 1)) if totals.sum() else 0.5
    good = 1 / (1 + F.exp(-(F.col("evidence") + math.log(base / (1 - base)))))
    judged = stage(shapes.withColumn("evidence", evidence).select(
        "doc_id", "host", "path", "evidence", F.coalesce(F.col("label").cast("double"), good).alias("good")), "judged")

    paths = stage(judged.groupBy("host", "path").agg(F.sum("good").alias("a"), F.count("*").alias("n")), "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("a").alias("a"), F.sum("n").alias("n")), "hosts")
    all_ = hosts.agg(F.sum("a").alias("a"), F.sum("n").alias("n")).first()
    mean = F.lit(min(0.999, max(0.001, all_["a"] / all_["n"])) if all_["n"] else 0.5)
    of_host = _strength(hosts, mean)
    hosts = hosts.select(F.col("host").alias("_host"), F.col("a").alias("host_a"), F.col("n").alias("host_n"))
    sites = stage(paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "a", "n", "host_a", "host_n"), "sites")
    prior = (F.col("host_a") + of_host * mean) / (F.col("host_n") + of_host)
    of_path = _strength(sites, prior)
    joined = judged.join(sites, judged["host"].eqNullSafe(sites["_host"]) & judged["path"].eqNullSafe(sites["_path"]))
    # Without the document itself.
    from_host = (F.col("host_a") - F.col("good") + of_host * mean) / (F.col("host_n") - 1 + of_host)
    rate = (F.col("a") - F.col("good") + of_path * from_host) / (F.col("n") - 1 + of_path)
    rate = F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), rate))
    out = joined.withColumn("site_rate", rate)
    out = out.withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("site_rate")) + F.col("evidence")))))
    return out.select("doc_id", "evidence", "site_rate", "score", (F.col("score") >= threshold).alias("keep"))
