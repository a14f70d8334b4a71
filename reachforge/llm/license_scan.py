"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

Notices of a file are its lines that speak of a licence, the headers (adjacent lines of a paragraph or comment, joined to one vector)
that do, the words "all rights reserved", and the whole text of a licence file, whatever it says. Lines and headers without any word of
NOTICE are prose, and not compared. Templates are one-line notices, headers and licence
texts. Distinct notices are compared to the templates as sparse TF-IDF vectors; a term's document frequency counts all notices of all
files and the templates. A file's own licence is that of its most similar notice; RESERVED only if no notice gives another, and like
any licence of its own it bars inheritance. Licence files, named so or given by the caller, speak for their directory: a file without a licence of its own takes the
one of the nearest directory above it that has one. Directories, not files, are joined to their ancestors, and then files to
directories, so that a directory may hold any share of the files.

Defined results: a null text has no notice; a null path lies in no directory and inherits nothing; of several licence files in a
directory the most similar one counts, RESERVED after all others, then the licence's name and the path; repeated rows each get their result; no rows give none;
other columns are ignored.
"""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, whole

THRESHOLD = 0.6
RESERVED = "All-Rights-Reserved"
#: A line or header with one of these is a notice.
NOTICE = r"(?i)\blicen[cs]e|copyright|spdx|creative commons|\bcc[ -]by\b|\bcc0\b|public domain|rights reserved|permission is hereby granted|permission to use, copy|redistribution and use|\b[al]?gpl\b|\bunder the terms of\b|\bterms of use\b"
RIGHTS = r"(?i)\ball rights reserved\b"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"

#: Notices of public licences, in the words in which files commonly carry them.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "May be used under the terms of the GPL, version 2"),
    ("GPL-3.0", "May be used under the terms of the GPL, version 3"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    (RESERVED, "All rights reserved"),
]

#: The headers that licences ask files to carry.
_FREE = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_HOPE = " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with {0}. If not, see <https://www.gnu.org/licenses/>."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
TEMPLATES += [
    (name, text.format("This program", title, version))
    for name, title, version in (("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"))
    for text in (_FREE, _FREE + _HOPE)
]
TEMPLATES += [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f'{_APACHE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Whole licences. That of the AGPL is made of the GPL's, whose wording it shares. Paragraphs that stand for a licence in files are templates too.
TEXTS = {n: (resources(__package__) / "license_texts" / f"{n}.txt").read_text("utf-8") for n in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")}
TEXTS["AGPL-3.0"] = TEXTS["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
TEMPLATES += sorted(TEXTS.items())
TEMPLATES += [(n, next(x for x in TEXTS[n].split("\n\n") if x.startswith("Permission "))) for n in ("ISC", "MIT")]

_LINE_COMMENT = r"[ \t]*(?:#|//|--|;|%)"


def terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def headers(text: Column) -> Column:
    """Adjacent lines, up to an empty line, the end of a comment, or a line that is no comment after those that are."""
    parted = F.regexp_replace(F.regexp_replace(text, rf"(?m)^({_LINE_COMMENT}[^\n]*)\n(?!{_LINE_COMMENT})", "$1\n\n"), r"(\*/|-->)[ \t\r]*\n", "$1\n\n")
    return F.split(parted, r"\n[ \t\r]*\n")


def notices(text: Column, speaks: Column) -> Column:
    """The distinct notices of a text: lines, headers, reserved rights, and all of a licence file."""
    says = lambda s: s.rlike(NOTICE)
    found = F.concat(F.filter(F.split(text, "\n"), says), F.filter(headers(text), says), F.when(text.rlike(RIGHTS), F.array(F.lit("All rights reserved"))).otherwise(F.array().cast("array<string>")), F.when(speaks, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.when(text.rlike(NOTICE) | speaks, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def tallied(words: Column) -> Column:
    """The distinct words, each with its number."""

    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf"))))

    return let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,tf:int>>")))


def scored(notices: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """notices (line): all of them, repeats included. Returns (line, license, score) of each distinct notice that is similar enough.

    Products with the templates need the weights of their words only. A notice whose other words, at the least weight there is, already
    make it too long a vector for any template is done; the weights of all words are joined to the rest."""
    spark = notices.sparkSession
    t = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, line string")
    texts = cut(notices.groupBy("line").agg(F.count(F.lit(1)).alias("times")).select(F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("key"), "line", "times", tallied(terms(F.col("line"))).alias("words")))
    total = texts.agg((F.coalesce(F.sum("times"), F.lit(0)) + F.lit(len(templates))).alias("total"))
    of = lambda df, words, *keys: df.select(*keys, F.explode(words).alias("x")).select(*keys, "x.term", "x.tf")
    by_line, by_template = of(texts, "words", "key", "times"), of(t, tallied(terms(F.col("line"))), "t", "license")
    df = by_line.select("term", "times").unionByName(by_template.select("term", F.lit(1).cast("long").alias("times"))).groupBy("term").agg(F.sum("times").alias("df"))
    idf = df.join(total, F.lit(True)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))  # total is one row
    b = idf.join(F.broadcast(by_template), "term").withColumn("w", F.col("tf") * F.col("idf"))  # the templates are a constant
    norm = b.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known = cut(b.join(norm, "t").groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("t", "license", (F.col("w") / F.col("norm")).alias("u"))).alias("by")))
    w = F.col("tf") * F.coalesce("idf", F.lit(1.0))  # no word weighs less than 1
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("t"), F.lit("").alias("license"), (w * w).alias("x"))), F.coalesce(F.transform("by", lambda o: F.struct(o["t"].alias("t"), o["license"].alias("license"), (F.col("tf") * F.col("idf") * o["u"]).alias("x"))), F.array().cast("array<struct<t:int,license:string,x:double>>")))
    sums = by_line.join(F.broadcast(known), "term", "left").select("key", F.explode(parts).alias("p")).groupBy("key", "p.t", "p.license").agg(F.sum("p.x").alias("x"))
    near = sums.groupBy("key").agg(F.max(F.when(F.col("t") < 0, F.col("x"))).alias("least"), F.collect_list(F.when(F.col("t") >= 0, F.struct("license", "x"))).alias("dots"))  # as many as there are templates at most
    near = near.select("key", F.filter("dots", lambda o: o["x"] / F.sqrt("least") >= THRESHOLD - 1e-6).alias("dots")).where(F.size("dots") > 0)
    near = cut(near)
    left = of(texts.join(near.select("key"), "key", "left_semi"), "words", "key")
    length = left.join(idf, "term").groupBy("key").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf") * F.col("idf") * F.col("idf"))).alias("norm"))
    score = F.round(F.col("o.x") / F.col("norm"), 9)
    best = near.join(length, "key").select("key", "norm", F.explode("dots").alias("o")).select("key", "o.license", score.alias("score")).where(F.col("score") >= THRESHOLD)
    one = best.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"))
    return texts.select("key", "line").join(one, "key").select("line", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def ancestors(directory: Column) -> Column:
    """The directory and those above it, up to the root ''."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def scan_licenses(files: DataFrame, licence_file: Column | None = None) -> DataFrame:
    """files: id, path, text. Per row: id, path, license, score, inherited, from_path; nulls where there is none. licence_file: which rows speak for their directory, by path if not given."""
    speaks = F.col("path").rlike(LICENCE_FILE) if licence_file is None else licence_file
    speaks = F.coalesce(speaks, F.lit(False))
    rows = cut(files.select("id", "path", F.regexp_replace(F.col("path"), "/?[^/]*$", "").alias("dir"), speaks.alias("speaks"), notices(whole("text"), speaks).alias("lines")))  # every text is read once
    lines = rows.where(F.size("lines") > 0).select("id", "path", F.explode("lines").alias("line"))
    found = lines.join(scored(lines.select("line")), "line")
    key = ["id", "path"]
    own = found.groupBy(*key).agg(F.min(F.struct((F.col("license") == RESERVED).alias("reserved"), (-F.col("score")).alias("s"), "license")).alias("own"))
    with_own = rows.select(*key, "dir", "speaks", (F.size("lines") > 0).alias("noticed"))
    mine = with_own.where("noticed").join(own, (with_own["id"].eqNullSafe(own["id"])) & (with_own["path"].eqNullSafe(own["path"])), "left").select(with_own["id"], with_own["path"], "dir", "speaks", "own")
    of_dir = mine.where("speaks AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct("own.reserved", "own.s", "own.license", "path")).alias("given"))
    dirs = with_own.where("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "above"))
    nearest = above.join(of_dir.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("given", "depth").alias("given"))
    every = with_own.where("NOT noticed").select(*key, "dir", F.lit(None).cast("struct<reserved:boolean,s:double,license:string>").alias("own")).unionByName(mine.select(*key, "dir", "own"))
    full = every.join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    pick = lambda a, b: F.when(has, a).otherwise(b)
    return full.select(*key, pick(F.col("own.license"), F.col("given.license")).alias("license"), pick(-F.col("own.s"), -F.col("given.s")).alias("score"), (~has & F.col("given").isNotNull()).alias("inherited"), pick(F.col("path"), F.col("given.path")).alias("from_path"))


def document_path() -> Column:
    """A directory tree for tables without one: by source, then by ids; documents whose ids are divisible by 100 stand a level higher, by 1000 two."""
    i = F.col("doc_id")
    base = F.coalesce("source", F.lit("_"))
    d2, d1 = F.concat(base, F.lit("/"), F.floor(i / 1000).cast("string")), F.concat(base, F.lit("/"), F.floor(i / 1000).cast("string"), F.lit("/"), F.floor(i / 100).cast("string"))
    return F.concat(F.when(i % 1000 == 0, base).when(i % 100 == 0, d2).otherwise(d1), F.lit("/"), i.cast("string"), F.lit(".txt"))
