"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Templates are statements, tag lines, the usual headers and the texts of short licences. Every line with a licence word is
compared, all such lines of a file together, and all lines in legal terms together, so one-line headers, headers of several
lines and whole licence files are found wherever they stand. Everything is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import settled

#: Identifiers of licences and statements that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike License, CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    *(
        (
            name,
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            f"documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
            "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
            "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        )
        for name, third in (
            ("BSD-2-Clause", ""),
            (
                "BSD-3-Clause",
                "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                "this software without specific prior written permission. ",
            ),
        )
    ),
)
#: Lines are compared if they have one of these words.
CUE = "(?i)licen[cs]|copyright|spdx|public domain"
#: Words of legal terms; all lines with one of them are compared together, in files that have a line with a cue.
LEGAL = CUE + "|permi(?:ssion|tted)|software|warrant|liab|redistribut|conditions|damages|infring|merchantab|disclaim|contributors|endorse"
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
THRESHOLD = 0.5
SHARES = 32
#: Terms in more than one of this many units are few (at most this many times the terms of a unit), so they are broadcast.
FREQUENT = 1000


def _terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner dots."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+(\\.[a-z0-9]+)*)"), F.lit(1))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def own_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score) of the files of which some unit reaches the threshold.

    Units are the lines with a cue, all of them together, and all lines in legal terms together. A term weighs
    tf * (1 + ln(units / units with it)) over all compared units, in units and templates alike; a template's term that no
    unit has weighs as much as the rarest. So a table that is copied as a whole keeps its scores. Of equal scores the first
    licence by name counts.
    """
    spark = files.sparkSession
    line = F.col("line")
    lines = files.where(F.col("text").rlike(CUE)).select("path", F.explode(F.split("text", "\n")).alias("line")).where(line.rlike(LEGAL))
    units = F.when(line.rlike(CUE), F.array(F.xxhash64("line").cast("string"), F.lit("cues"), F.lit("legal"))).otherwise(F.array(F.lit("legal")))
    terms = lines.select("path", units.alias("units"), F.explode(_terms(line)).alias("term")).select("path", F.explode("units").alias("unit"), "term")
    counts = settled(terms.groupBy("path", "unit", "term").agg(F.count("*").alias("tf")))
    total = counts.select("path", "unit").distinct().count()
    known = settled(counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", 1 + F.log(F.lit(float(total)) / F.col("df"))))
    rarest = known.agg(F.max("idf")).first()[0] or 1.0
    frequent = F.col("df") * FREQUENT > total
    numbered = [(i, name, text) for i, (name, text) in enumerate(templates)]
    wanted = spark.createDataFrame(numbered, "template int, license string, text string").select("template", F.explode(_terms(F.col("text"))).alias("term"))
    wanted = wanted.groupBy("template", "term").agg(F.count("*").alias("tf"))
    of_templates = known.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    weighted = wanted.join(F.broadcast(of_templates), "term", "left").select("template", "term", (F.col("tf") * F.coalesce("idf", F.lit(rarest))).alias("w"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # one row for each template term: its weight in each template, scaled to length 1
    scaled = weighted.join(F.broadcast(norms), "template").groupBy("term").agg(
        *(F.sum(F.when(F.col("template") == i, F.col("w") / F.col("norm"))).alias(f"t{i}") for i in range(len(templates)))
    )
    # frequent terms meet their weight without a shuffle, so that no term's rows gather in one task
    common = counts.join(F.broadcast(known.where(frequent).select("term", "idf")), "term")
    rare = counts.join(F.broadcast(known.where(frequent).select("term")), "term", "left_anti").join(known.where(~frequent).select("term", "idf"), "term")
    names = sorted({name for name, _ in templates})
    scores = [F.struct(F.round(F.coalesce(F.col(f"t{i}"), F.lit(0.0)) / F.col("norm"), 6).alias("score"), F.lit(-names.index(name)).alias("place")) for i, name in enumerate(n for n, _ in templates)]
    scored = (
        common.unionByName(rare)
        .join(F.broadcast(scaled), "term", "left")
        .withColumn("w", F.col("tf") * F.col("idf"))
        .groupBy("path", "unit")
        .agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.col("w") * F.col(f"t{i}")).alias(f"t{i}") for i in range(len(templates))))
        .select("path", F.array_max(F.array(*scores)).alias("best"))
        .where(F.col("best.score") >= threshold)
        .groupBy("path")
        .agg(F.max("best").alias("best"))
    )
    name = F.element_at(F.array(*map(F.lit, names)), 1 - F.col("best.place"))
    return settled(scored.select("path", name.alias("license"), F.col("best.score").alias("score")))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text") -> DataFrame:
    """One row for each row: doc_id, path, own_license, own_score, inherited_license, inherited_from, license.

    A file inherits from the nearest directory above it, its own included, that holds a licence file with a licence of
    its own; the file's own licence comes first. Rows of one path are parts of one file. A null path has neither own
    nor inherited licence, a null or empty text none of its own; null identifiers and repeated rows stay; other columns
    are not read; an empty table gives no rows.
    """
    read = files.select(F.col(id_column).cast("long").alias("doc_id"), F.col(path_column).cast("string").alias("path"), F.col(text_column).cast("string").alias("text"))
    own = own_licenses(read.where("path is not null and text is not null").select("path", "text"), templates, threshold)
    holders = own.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE)).select(_parent(F.col("path")).alias("above"), "license", "score")
    first = F.min(F.struct((-F.col("score")).alias("behind"), F.col("license")))
    offered = holders.groupBy("above").agg(first.alias("first")).select("above", "first.license")
    placed = read.select("doc_id", "path", _parent(F.col("path")).alias("directory"))
    directories = placed.where("path is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    ancestors = directories.select("directory", F.posexplode(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))).alias("depth", "above"))
    # the top above all, where paths are relative
    ancestors = ancestors.unionByName(directories.where("directory <> ''").select("directory", F.lit(-1).alias("depth"), F.lit("").alias("above")))
    # a directory near the top lies above many: its rows are dealt over shares
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    nearest = (
        ancestors.withColumn("share", F.pmod(F.xxhash64("directory"), F.lit(SHARES)).cast("int"))
        .join(offered.select("above", "license", share), ["above", "share"])
        .groupBy("directory")
        .agg(F.max_by(F.struct("license", "above"), "depth").alias("found"))
        .select("directory", F.col("found.license").alias("inherited_license"), F.col("found.above").alias("inherited_from"))
    )
    return (
        placed.join(own.select("path", F.col("license").alias("own_license"), F.col("score").alias("own_score")), "path", "left")
        .join(nearest, "directory", "left")
        .select("doc_id", "path", "own_license", "own_score", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))
    )
