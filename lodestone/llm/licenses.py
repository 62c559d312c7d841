"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

The lines of a whole text that speak of licences are its header; of a file
named like LICENSE or COPYING the whole text is. An SPDX tag names its licence
itself (of an expression, the first). A licence has several templates: a
sentence, the standard notice, the licence text, and the header lines of these.
Distinct headers are scored once: their terms, weighted by frequency and by the inverse
document frequency over all headers of the corpus, are joined to the terms of
the templates (a fixed table, so its broadcast is bounded), and products are
summed. The best template at ``threshold`` or more is the file's own licence.
A file without one takes that of its nearest ancestor directory that has a
licence file (by name or by the column ``is_licence_file``); directories, not files, are joined to their ancestors.

Cases: a null or empty text has no header. A null path has no directory and
inherits nothing. Ties between templates go to the smaller name, between
licence files of one directory to the smaller path. Repeated rows are judged
each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, words, written

#: Header forms of well-known licences (fixed values).
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0} as published by
the Free Software Foundation, either version {1} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {0} for more details.

You should have received a copy of the GNU {0}
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
#: Standard notices of file headers.
NOTICES = {
    "AGPL-3.0": _GNU.format("Affero General Public License", 3),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0": _GNU.format("General Public License", 2),
    "GPL-3.0": _GNU.format("General Public License", 3),
    "LGPL-2.1": _GNU.format("Lesser General Public License", 2.1),
    "LGPL-3.0": _GNU.format("Lesser General Public License", 3),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Licence texts by name; that of AGPL-3.0 is GPL-3.0 with the name exchanged.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
SPDX = r"(?i)SPDX-License-Identifier:[\s(]*([A-Za-z0-9.-]*[A-Za-z0-9])"
SPEAKS = r"(?i)licen[sc]e|copyright|\bspdx\b|public domain|all rights reserved|permission is hereby granted"
LICENCE_FILE = r"(?i)(?:^|/)(licen[sc]e|copying|unlicense|notice)([.-][^/]*)?$"


def header(text: Column) -> Column:
    """The lines of a text that speak of licences, joined."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(SPEAKS), F.array_join(F.filter(F.split(t, "\n"), lambda x: x.rlike(SPEAKS)), "\n")).otherwise(F.lit(""))


def terms(text: Column) -> Column:
    """Lower-case words and numbers with their dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def forms(spark: SparkSession) -> DataFrame:
    """(licence, form, body): every template as a whole and by its header lines."""
    bodies = [(k, b) for table in (TEMPLATES, NOTICES, TEXTS) for k, b in table.items()]
    t = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(i).alias("form"), F.lit(b).alias("body")) for i, (k, b) in enumerate(bodies)])))
    lines = t.select("licence", (-F.col("form") - 1).alias("form"), header(F.col("body")).alias("body"))
    return cut(t.unionByName(lines))


def scores(headers: DataFrame, spark: SparkSession, threshold: float = 0.7) -> DataFrame:
    """headers(header, n: files that bear it) -> (header, licence, score), the best template of each distinct header at the threshold or more."""
    tf = cut(headers.select("header", "n", F.explode(terms(F.col("header"))).alias("term")).groupBy("header", "n", "term").agg(F.count("*").cast("double").alias("tf")))
    total = headers.agg(F.sum("n")).first()[0] or 0
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    t = forms(spark)
    known = sorted({*TEMPLATES, *NOTICES, *TEXTS})
    names = F.create_map(*[F.lit(x) for k in known for e in ("", "-only", "-or-later") for x in ((k + e).lower(), k)])
    idf = F.log((F.lit(float(total)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    own = t.select("licence", "form", F.explode(terms(F.col("body"))).alias("term")).groupBy("licence", "form", "term").agg(F.count("*").cast("double").alias("tf"))
    own = own.join(df, "term", "left").select("licence", "form", "term", (F.col("tf") * idf).alias("tw"))
    own = own.join(own.groupBy("form").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn")), "form")
    weighted = tf.join(df, "term").select("header", "term", (F.col("tf") * idf).alias("w"))
    norms = weighted.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("hn"))
    dots = weighted.join(F.broadcast(own), "term").groupBy("header", "licence", "form").agg((F.sum(F.col("w") * F.col("tw")) / F.first("tn")).alias("d"))
    cos = dots.join(norms, "header").select("header", "licence", F.round(F.col("d") / F.col("hn"), 6).alias("score")).where(F.col("score") >= threshold)
    tagged = headers.select("header", F.element_at(names, F.lower(F.regexp_extract("header", SPDX, 1))).alias("licence"), F.lit(1.0).alias("score")).where("licence is not null")
    # A tag goes before every comparison.
    cos = cos.join(tagged.select("header"), "header", "left_anti").unionByName(tagged)
    return cos.groupBy("header").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best")).select("header", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"))


def scan(files: DataFrame, keep: tuple[str, ...] = ("path",), threshold: float = 0.7) -> DataFrame:
    """files(path, text, is_licence_file) -> the kept columns, own_licence, own_score, licence, how, inherited_from."""
    spark = files.sparkSession
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    head = F.when(named, F.coalesce("text", F.lit(""))).otherwise(header(F.col("text")))
    held = written(files.select(*dict.fromkeys((*keep, "path")), (F.coalesce("is_licence_file", F.lit(False)) | named).alias("is_licence_file"), head.alias("header")))
    best = cut(scores(held.where("header <> ''").groupBy("header").agg(F.count("*").alias("n")), spark, threshold))
    at = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    # Files without a header need no join; one empty key would gather most rows.
    bare = held.where("header = ''").withColumns({"licence": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    own = held.where("header <> ''").join(best, "header", "left").unionByName(bare).withColumn("dir", at).drop("header")
    given = own.where(F.col("is_licence_file") & F.col("licence").isNotNull() & F.col("dir").isNotNull())
    of_dir = given.groupBy("dir").agg(F.min(F.struct("path", "licence")).alias("g")).select(F.col("dir").alias("up"), F.col("g.licence").alias("dir_licence"))
    parts = F.split("dir", "/")
    ups = own.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("a")).select("dir", "a.*")
    near = cut(ups.join(of_dir, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_licence")).alias("m")).select("dir", F.col("m.up").alias("up"), F.col("m.dir_licence").alias("dir_licence")))
    out = own.join(near, "dir", "left")
    how = F.when(F.col("licence").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return out.select(*keep, F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "dir_licence").alias("licence"), how.alias("how"), F.when(F.col("licence").isNull(), F.col("up")).alias("inherited_from"))


def speaks_mostly(text: Column) -> Column:
    """Whether a text's lines about licences hold half of its words and more: a licence file by its content."""
    head = words(header(text))
    return (F.size(head) > 0) & (2 * F.size(head) >= F.size(words(text)))


def op2_license_scan(spark, sf_dir):
    """doc_id, own_licence, own_score, licence, how, inherited_from: one row for each document.

    The table has no paths, so a document lies at source/lang/doc_id; one whose
    words are mostly about licences counts as a licence file of its directory.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("-")))
    return scan(docs.select("doc_id", path.alias("path"), "text", speaks_mostly(F.col("text")).alias("is_licence_file")), keep=("doc_id",))


#: Licence files of ``licence_tree``, by the number of documents below them.
TREE = ("Apache-2.0", "MPL-2.0", "GPL-3.0")


def licence_tree(spark, sf_dir):
    """path, own_licence, licence, how, inherited_from of the documents as files of a tree, source/lang/part/doc_id.

    Every second source has a LICENSE, and every third of its languages a
    COPYING of its own, by the number of documents below; a file inherits from
    the nearest, whatever its neighbours say.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text").where("doc_id is not null and source is not null and lang is not null")
    files = docs.select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 5).cast("string"), F.col("doc_id").cast("string")).alias("path"), "text")
    body = lambda n: F.element_at(F.array(*[F.lit(NOTICES[k]) for k in TREE]), (n % len(TREE) + 1).cast("int"))
    tops = docs.groupBy("source").agg(F.count("*").alias("n")).where("n % 2 = 0").select(F.concat("source", F.lit("/LICENSE")).alias("path"), body(F.col("n")).alias("text"))
    inner = docs.groupBy("source", "lang").agg(F.count("*").alias("n")).where("n % 3 = 0").select(F.concat_ws("/", "source", "lang", F.lit("COPYING")).alias("path"), body(F.floor(F.col("n") / 3)).alias("text"))
    rows = files.unionByName(tops).unionByName(inner).withColumn("is_licence_file", F.lit(False))
    return scan(rows).select("path", "own_licence", "licence", "how", "inherited_from")
