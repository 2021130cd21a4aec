"""License scans by TF-IDF similarity to templates, with DataFrame functions only.

Headers (single lines) and licence files (whole texts) are compared with templates by the cosine of sparse
TF-IDF vectors.  Document frequencies of the templates' words come from all documents; any other word has
the weight of a word seen nowhere.  Lines and texts are scored if the words that they share with a template
are heavy enough to reach the threshold at all, which no other can (Cauchy-Schwarz), however common the words
are.  Documents without a licence of their own inherit that of the nearest ancestor directory with a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.common import cut, dealt_anew, documents

# Notices and headers of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
]
#: Least cosine of a header with a template, and of a whole text for it to be a licence file.
HEADER_COSINE, FILE_COSINE = 0.7, 0.35


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def template_words(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, word, tf): fixed rows, as many as the templates have words."""
    t = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    return t.select("template", "license", F.explode(tokens(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of whole licence texts, a file each, to add to TEMPLATES: a folder of some dozens, small by nature."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").orderBy("name")
    return [(re.sub(r"\.txt$", "", r["name"]), r["value"]) for r in rows.collect()]


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def shares(templates, idf: dict[str, float], cosine: float) -> list[dict[str, float]]:
    """For each template, the part that each of its words has of what the template needs for the cosine.

    What a text shares with a template must be at least cosine squared of the template's length squared, as the
    rest of either vector adds nothing to their product (Cauchy-Schwarz).  So texts whose words' parts sum up to
    less than 1 do not reach the template.
    """
    found = []
    for _, text in templates:
        squares = {w: (n * idf[w]) ** 2 for w, n in Counter(re.findall("[a-z0-9]+", text.lower())).items()}
        least = max(0.0, cosine - 1e-5) ** 2 * sum(squares.values())
        found.append({w: x / least if least else 1.0 for w, x in squares.items()})
    return found


def reaches(words: Column, of_templates: list[dict[str, float]]) -> Column:
    """Whether the words' parts sum up to 1 for some template; first for the largest part of each word in any."""

    def one(parts: dict[str, float]) -> Column:
        heaviest = sorted(parts.items(), key=lambda p: (-p[1], p[0]))
        of_word = F.create_map(*[F.lit(x) for pair in heaviest for x in pair])
        return F.aggregate(words, F.lit(0.0), lambda total, w: total + F.coalesce(F.try_element_at(of_word, w), F.lit(0.0))) >= 1 - 1e-9

    largest: dict[str, float] = {}
    for parts in of_templates:
        for w, x in parts.items():
            largest[w] = max(x, largest.get(w, 0.0))
    some = one(of_templates[0])
    for parts in of_templates[1:]:
        some = some | one(parts)
    return one(largest) & some


def licences(docs: DataFrame, templates=TEMPLATES, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """A row for each row of docs (doc_id, text, path): license, cosine, origin, line, from_doc_id, path.

    origin: 'file' if the whole text is like a template (line null), 'header' if a line is (line: the first
    such line's number from 0), 'inherited' from the licence file from_doc_id of the nearest ancestor
    directory, else 'none'.  The best cosine wins, ties by the first template and line.  Of several licence
    files in a directory the best one counts, ties by the lowest doc_id.  Null and empty texts have no
    licence of their own; a null path inherits none.  Texts are read whole, very long ones too.  Rows that repeat
    one have its result; rows with one doc_id, or none, are told apart by their texts.  An empty table gives no
    rows.  Columns other than these three, whatever their names, are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "path", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key"))
    words_of = template_words(spark, templates)
    vocabulary = sorted({r["word"] for r in words_of.select("word").distinct().collect()})  # fixed: the templates' words
    vocab = F.array(*map(F.lit, vocabulary))

    has = d.select(F.array_intersect(tokens(F.col("text")), vocab).alias("w"))
    found = has.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n_docs = d.count()
    df = {w: 0 for w in vocabulary} | {r["word"]: r["df"] for r in found.collect()}  # a row for each template word at most
    idf = {w: math.log((1 + n_docs) / (1 + n)) + 1 for w, n in df.items()}
    words = words_of.join(spark.createDataFrame(list(df.items()), "word string, df long"), "word").withColumn("idf", F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)
    norms = words.groupBy("template").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("t_norm"))
    words = F.broadcast(words.join(norms, "template").select("template", "license", "word", "idf", F.col("tf").alias("t_tf"), "t_norm"))
    idfs = F.broadcast(words.select("word", "idf").distinct())
    unseen = F.log(F.lit(1.0 + n_docs)) + 1

    # whole texts and lines that could reach their threshold; a text that could not as a whole has no such line
    of_texts, of_lines = (shares(templates, idf, c) for c in (file_cosine, header_cosine))
    none = F.array().cast("array<struct<line:bigint,w:array<string>>>")
    unit = lambda line, w: F.struct(line.cast("long").alias("line"), w.alias("w"))
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda u, i: unit(i, tokens(u))), lambda u: reaches(F.array_intersect(u["w"], vocab), of_lines))
    chosen = let(
        tokens(F.col("text")),
        lambda w: let(
            F.array_intersect(w, vocab),
            lambda of: F.concat(F.when(reaches(of, of_texts), F.array(unit(F.lit(-1), w))).otherwise(none), F.when(reaches(of, of_lines), lines).otherwise(none)),
        ),
    )
    units = d.select("key", F.explode(chosen).alias("u")).select("key", "u.line", "u.w")
    units = cut(units.withColumn("unit", F.monotonically_increasing_id()), "licence-units")
    counted = units.select("unit", "key", "line", F.explode("w").alias("word")).groupBy("unit", "key", "line", "word").agg(F.count("*").alias("tf"))
    weighted = counted.join(idfs, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen)).select("unit", "key", "line", "word", "w")
    unit_norms = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = weighted.join(words, "word").groupBy("unit", "key", "line", "template", "license", "t_norm").agg(F.sum(F.col("w") * F.col("t_tf") * F.col("idf")).alias("dot"))
    scored = dots.join(unit_norms, "unit").select("key", "line", "template", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
    hits = scored.filter(F.when(F.col("line") < 0, F.col("cosine") >= file_cosine).otherwise(F.col("cosine") >= header_cosine))
    order = F.struct((F.col("line") < 0).alias("whole"), "cosine", (-F.col("template")).alias("t"), (-F.col("line")).alias("l"))
    own = cut(hits.groupBy("key").agg(F.max_by(F.struct("license", "cosine", "line"), order).alias("own")), "licences")

    # directories with a licence file, then each directory's nearest ancestor among them
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    directory = F.when(F.startswith("path", F.lit("/")) & (directory == ""), "/").otherwise(directory)
    at = own.filter("own.line < 0").join(d.select("key", "doc_id", directory.alias("dir")), "key").filter("dir IS NOT NULL")
    files = at.groupBy("dir").agg(F.max_by(F.struct(F.col("own.license").alias("license"), F.col("doc_id").alias("from_doc_id")), F.struct("own.cosine", F.bitwise_not("doc_id").alias("d"))).alias("file"))
    dirs = d.select(directory.alias("dir")).filter("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("p")).select("dir", "depth", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("above"))
    above = above.withColumn("above", F.when((F.col("above") == "") & F.startswith("dir", F.lit("/")), "/").otherwise(F.col("above")))  # '' is above all relative paths, / above the others
    near = above.join(files.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("file", "depth").alias("file"))

    out = d.select("doc_id", "key", "path", directory.alias("dir")).join(own, "key", "left").join(near.select(dealt_anew("dir", "string"), "file"), "dir", "left")
    origin = F.when(F.col("own.line") < 0, "file").when(F.col("own").isNotNull(), "header").when(F.col("file").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id",
        F.coalesce("own.license", "file.license").alias("license"),
        F.col("own.cosine").alias("cosine"),
        origin.alias("origin"),
        F.when(F.col("own.line") >= 0, F.col("own.line")).alias("line"),
        F.when(F.col("own").isNull(), F.col("file.from_doc_id")).alias("from_doc_id"),
        "path",
    )


def with_path(docs: DataFrame) -> DataFrame:
    """documents has no paths: source/lang/thousand/doc_id stands in for one."""
    thousand = F.expr("cast(doc_id div 1000 as string)")
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), thousand, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(with_path(documents(spark, sf_dir)))
    return found.fillna({"line": -1, "from_doc_id": -1, "cosine": 0.0})


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP4_SQL = (
    "WITH templates(template, license, text) AS (VALUES "
    + ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))
    + rf"""),
tw AS (SELECT template, license, word, count(*) AS tf FROM (
  SELECT template, license, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM templates) GROUP BY ALL),
vocab AS (SELECT list(DISTINCT word) AS v FROM tw),
d AS (SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w,
  concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), (doc_id // 1000)::VARCHAR) AS dir FROM documents),
n AS (SELECT count(*) AS n FROM d),
dfs AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_intersect(w, v)) AS word FROM d, vocab) GROUP BY word),
idfs AS (SELECT word, coalesce(df, 0) AS df, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN dfs USING (word), n),
words AS (SELECT template, license, word, idf, tf AS t_tf, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS t_norm FROM tw JOIN idfs USING (word)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, unnest(range(len(string_split(text, chr(10))))) AS line FROM d),
units AS (
  SELECT row_number() OVER () AS unit, * FROM (
    SELECT doc_id, line, list_filter(string_split_regex(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines
    UNION ALL SELECT doc_id, -1, w FROM d)),
counted AS (SELECT unit, doc_id, line, word, count(*) AS tf FROM (SELECT unit, doc_id, line, unnest(w) AS word FROM units) GROUP BY ALL),
weighted AS (SELECT unit, doc_id, line, word, tf * coalesce(idf, ln(1.0 + n) + 1) AS w FROM counted LEFT JOIN idfs USING (word), n),
norms AS (SELECT unit, sqrt(sum(w ** 2)) AS norm FROM weighted GROUP BY unit),
dots AS (SELECT unit, doc_id, line, template, license, t_norm, sum(w * t_tf * idf) AS dot FROM weighted JOIN words USING (word) GROUP BY ALL),
scored AS (SELECT doc_id, line, template, license, round(dot / (norm * t_norm), 6) AS cosine FROM dots JOIN norms USING (unit)),
hits AS (SELECT * FROM scored WHERE cosine >= CASE WHEN line < 0 THEN {FILE_COSINE} ELSE {HEADER_COSINE} END),
own AS (SELECT doc_id, license, cosine, line FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line < 0 DESC, cosine DESC, template, line) = 1),
files AS (SELECT dir, license, doc_id AS from_doc_id FROM own JOIN d USING (doc_id) WHERE line < 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id) = 1),
near AS (SELECT dirs.dir, files.license, files.from_doc_id FROM (SELECT DISTINCT dir FROM d) dirs JOIN files ON dirs.dir = files.dir OR starts_with(dirs.dir, files.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY dirs.dir ORDER BY length(files.dir) DESC) = 1)
SELECT d.doc_id, coalesce(own.license, near.license) AS license, coalesce(own.cosine, 0.0) AS cosine,
  CASE WHEN own.line < 0 THEN 'file' WHEN own.line >= 0 THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.line >= 0 THEN own.line ELSE -1 END AS line, CASE WHEN own.license IS NULL THEN coalesce(near.from_doc_id, -1) ELSE -1 END AS from_doc_id,
  d.dir || '/' || d.doc_id || '.txt' AS path
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
"""
)
