"""Licence scans: TF-IDF cosine of lines, headers and whole files to licence templates, and inheritance down directories.

Units of a file are its lines, its paragraphs (lines up to one without any word, so that a wrapped header in a comment is one) and the whole text.
Each is a vector of words (runs of letters and digits, A-Z lowered), weighed by term frequency times ln((1 + N) / (1 + df)),
df among all N lines of the corpus. Copyright statements with a year, which name holders, are taken out first. Only the templates'
words are ever looked up: the templates' vocabulary is a table of fixed size, and all other words of a unit enter its length
with the weight of an unseen word. A unit whose cosine to its best template reaches ``threshold`` is licensed, its file's licence that of its
best unit (ties: the earliest, lines before paragraphs before the whole). A file with a licence is a licence file if ``file_share`` of its words are
in licensed units of one kind, or if it is named as one (LICENSE, LICENCE, COPYING, with any ending); its licence holds for its directory. A file
without a licence of its own inherits from the nearest ancestor directory that has one, found by a join of the file's ancestors with the
directories' licences.

All steps are DataFrame functions. Files are rows; a unit's words are exploded only where half of them are template words.

Nulls and odd inputs: a null text has no units; a null path is in no directory; rows that repeat id, path and text are
files of their own, and get equal results, those of a single such row. Ties between templates and between the licences of a
directory's files go to the more frequent, then to the smaller name. Columns beyond those named are not read. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import ascii_lower
from tidemark.llm.decontaminate import NOT_WORD, words_of
from tidemark.session import stage

#: Notices, headers, titles and bodies of common licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
            "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
            "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                 "version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                     "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
)
#: A statement that names holders, in lowered text, up to its full stop or the end of its line.
COPYRIGHT = r"copyright[ ]{0,3}(\(c\))?[ ]{0,3}[0-9][^.\n]*[.]?"
#: Between paragraphs, in lowered text: a line without a word.
BETWEEN = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
#: Names of licence files.
NAMED = r"(^|/)(?i:licen[sc]e|copying)([.][^/]*)?$"
LINE, PARAGRAPH, WHOLE = 0, 1, 2

def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(NOTICES)], "template int, license string, notice string")


def scan_licences(docs: DataFrame, notices: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.8, file_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, own (licence or null), inherited (likewise), license (own, else
    inherited). ``notices`` (template, license, notice) is a small table; ``path`` names the file."""
    known = stage(notices.select("template", "license", F.explode(words_of(F.col("notice"))).alias("term"))
                  .groupBy("template", "license", "term").agg(F.count("*").alias("tf")), "notices")
    vocabulary = sorted(r["term"] for r in known.select("term").distinct().collect())  # of the templates only
    text = ascii_lower(F.col(text_col))
    files = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
                        F.xxhash64(F.col(text_col)).alias("_row"),
                        F.regexp_replace(text, COPYRIGHT, " ").alias("_text"))
    # One-line paragraphs and texts of one paragraph are units already.
    blocks = F.split("_text", BETWEEN)
    kinds = F.array(F.struct(F.lit(LINE).alias("unit"), F.split("_text", "\n").alias("parts")),
                    F.struct(F.lit(PARAGRAPH).alias("unit"), F.transform(
                        blocks, lambda b: F.when(F.contains(F.trim(b, F.lit("\n")), F.lit("\n")), b)).alias("parts")),
                    F.struct(F.lit(WHOLE).alias("unit"), F.when(F.size(blocks) > 1, F.array("_text")).alias("parts")))
    units = (files.select("doc_id", "path", "_row", F.explode(kinds).alias("k"))
             .select("doc_id", "path", "_row", "k.unit", F.posexplode("k.parts").alias("at", "line"))
             .where(F.col("line").isNotNull()))
    units = units.withColumn("terms", F.array_remove(F.split("line", NOT_WORD), "")).drop("line")
    held = units.withColumn("held", F.filter(F.array_distinct("terms"), lambda t: t.isin(vocabulary)))
    # One pass: counts for every file, terms for the units that may be notices, sets of words held for df.
    marked = stage(held.select("doc_id", "path", "_row", "unit", "at", F.size("terms").alias("n"), F.when(
        F.col("unit") == LINE, F.col("held")).alias("held"), F.when(
        F.size("held") * 2 >= F.size(F.array_distinct("terms")), F.col("terms")).alias("terms")), "licence-marked")
    lines = marked.where(F.col("unit") == LINE)
    # Rows that repeat id, path and text count their first lines; the rest of them is one file's.
    files_of = stage(lines.groupBy("doc_id", "path", "_row").agg(
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"), F.count("*").alias("n_lines"), F.sum("n").alias("n_words"))
        .withColumns({"n_lines": F.expr("n_lines div copies"), "n_words": F.expr("n_words div copies")}), "licence-files")
    df = lines.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n_lines = F.lit(files_of.agg(F.sum(F.col("n_lines") * F.col("copies"))).first()[0] or 0).cast("double")
    weights = stage(known.select("term").distinct().join(df, "term", "left").select(
        "term", F.log((n_lines + 1) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf")), "licence-idf")
    unseen = F.log(n_lines + 1)

    vectors = known.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    vectors = stage(vectors.withColumn("w", F.try_divide(F.col("w"), length)).select("template", "license", "term", "w"),
                    "licence-vectors")
    unit = ["doc_id", "path", "_row", "unit", "at", "n"]
    maybe = (marked.filter(F.col("terms").isNotNull() & (F.size("terms") > 0))
             .select(*unit, F.explode("terms").alias("term"))
             .groupBy(*unit, "term").agg(F.count("*").alias("tf"))  # that of all equal rows: lengths do not matter to a cosine
             .join(F.broadcast(weights), "term", "left")
             .withColumn("w", F.col("tf") * F.coalesce("idf", unseen)))
    maybe = stage(maybe, "licence-lines")
    norm = maybe.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (maybe.join(F.broadcast(vectors.withColumnRenamed("w", "v")), "term")
            .groupBy(*unit, "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot")))
    same = [dots[c].eqNullSafe(norm[c]) for c in unit]
    scored = dots.join(norm, same).select(*[dots[c] for c in unit], "license", F.round(
        F.try_divide("dot", "norm"), 6).alias("cosine")).filter(F.col("cosine") >= threshold)
    best = scored.groupBy(*unit).agg(F.min(F.struct((-F.col("cosine")).alias("far"), "license")).alias("best"))
    words_in = [F.coalesce(F.sum(F.when(F.col("unit") == kind, F.col("n"))), F.lit(0)) for kind in (LINE, PARAGRAPH, WHOLE)]
    own = (best.groupBy("doc_id", "path", "_row").agg(
        F.min(F.struct("best.far", "unit", "at", "best.license")).alias("top"), F.greatest(*words_in).alias("licensed"))
        .select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), F.col("_row").alias("_key"),
                F.col("top.license").alias("own"), "licensed"))
    out = stage(files_of.join(own, files_of["doc_id"].eqNullSafe(own["_id"]) & (files_of["path"] == own["_path"])
                              & (files_of["_row"] == own["_key"]), "left").drop("_id", "_path", "_key"), "licence-own")

    # A directory's licence, from the licence files directly in it.
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    per_dir = (out.filter((F.col("path") != "") & F.col("own").isNotNull() & (
        (F.col("licensed") >= file_share * F.col("n_words")) | F.col("path").rlike(NAMED)))
               .groupBy(directory.alias("dir"), "own").agg(F.sum("copies").alias("files")))
    per_dir = stage(per_dir.groupBy("dir").agg(F.min(F.struct((-F.col("files")).alias("few"), "own")).alias("top"))
                    .select("dir", F.col("top.own").alias("dir_license")), "licence-dirs")
    # Ancestors are taken per directory, not per file.
    dirs = stage(out.filter((F.col("path") != "") & F.col("own").isNull()).select(directory.alias("of")).distinct(), "licence-of")
    depth = F.size(F.split("of", "/"))
    ancestors = dirs.select("of", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select(
        "of", "depth", F.array_join(F.slice(F.split("of", "/"), F.lit(1), F.col("depth")), "/").alias("dir")).distinct()
    near = (ancestors.join(per_dir, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir_license")).alias("top"))
            .select("of", F.col("top.dir_license").alias("inherited")))
    near = stage(near, "licence-near")
    out = out.withColumn("of", F.when((F.col("path") != "") & F.col("own").isNull(), directory)).join(near, "of", "left")
    counted = files.select("doc_id", "path", "_row").join(
        out.withColumnsRenamed({"doc_id": "_id", "path": "_path", "_row": "_key"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("path") == F.col("_path")) & (F.col("_row") == F.col("_key")), "left")
    return counted.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "own", "inherited",
                          F.coalesce("own", "inherited").alias("license"))
