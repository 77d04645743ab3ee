"""License scans: sparse TF-IDF cosine of lines to license templates, then inheritance down the directories.

Every line with a word that license notices use is a header candidate; its term
vector is compared with every template by an equi-join on terms. So are its
paragraph, which joins a header of several lines, and the whole document, with
the full license texts, the standard headers and the names of licenses; an SPDX
identifier is read as such. A document most
of whose words lie in recognised lines is a license file and speaks for its
directory. A document without a header of its own takes the license of the
nearest ancestor directory that has one, found by joining paths. DataFrame
operations only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stage

# Notices that stand for a license, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Standard headers, by SPDX identifier.
_APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the
License, or (at your option) any later version."""
_NO_WARRANTY = """{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with {0}. If not, see <https://www.gnu.org/licenses/>."""
HEADERS = (
    ("Apache-2.0", f'Licensed under the Apache License, Version 2.0 (the "License"); {_APACHE}'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    *(
        (name, text.format(thing, title, version))
        for name, thing, title, version in (("GPL-2.0", "This program", "General Public License", "2"), ("GPL-3.0", "This program", "General Public License", "3"), ("LGPL-3.0", "This library", "Lesser General Public License", "3"))
        for text in (_GNU, f"{_GNU} {_NO_WARRANTY}")
    ),
)
# How licenses are named in a line, by SPDX identifier; each also as "{}", "License: {}" and with the verbs of _SAYS.
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "BSD-3-Clause"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "CC0-1.0"),
    ("GPL-2.0", "GNU General Public License version 2"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GNU General Public License version 3"), ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GPL-3.0"), ("LGPL-3.0", "GNU Lesser General Public License version 3"), ("LGPL-3.0", "LGPL-3.0"), ("MIT", "MIT License"), ("MIT", "MIT"), ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "MPL-2.0"),
)
_SAYS = ("License: {}", "Licensed under the {}", "This work is licensed under {}", "Released under the {}")
#: The line of an SPDX identifier; of an expression the first license counts, and "only" or "or later" does not.
SPDX = r"(?i)spdx-license-identifier:[\x20\x09]*\(*[\x20\x09]*([a-z0-9][a-z0-9.-]*?)(?:-only|-or-later|\+)?(?![a-z0-9.+-])"
#: Paragraphs end at a line without characters.
_GAP = r"\n[\x20\x09\x0D]*\n"
#: A line is a candidate if it has one of these words.
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|creative commons|public domain|redistribution|\bcc[ -](by|0)"
LEAST_COSINE = 0.75
#: Share of a document's words in recognised lines that makes it a license file, in percent.
FILE_PERCENT = 50
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def full_templates() -> list[tuple[str, str]]:
    """(license, text) of the full texts beside this file, the standard headers and the names."""
    texts = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    said = [(name, say.format(title)) for name, title in NAMES for say in _SAYS]
    whole = [(name, title) for name, title in NAMES if " " in title]  # a bare identifier is no statement
    return [*texts, *HEADERS, *whole, *said]


def template_weights(templates: Sequence[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, license, term, weight over the norm), the inverse document frequency of each term, and that of unknown terms."""
    import re

    counted = [(name, Counter(re.findall(r"[a-z0-9]+", text.translate(str.maketrans(*_LOWER))))) for name, text in templates]
    n = len(counted)
    seen = Counter(t for _, c in counted for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in seen.items()}
    out = []
    for i, (name, c) in enumerate(counted):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        out += [(i, name, t, k * idf[t] / norm) for t, k in sorted(c.items())]
    return out, idf, math.log(1 + n) + 1


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def license_lines(documents: DataFrame, key: Sequence[str], text_col: str, templates: Sequence[tuple[str, str]] = TEMPLATES, least_cosine: float = 0.0) -> DataFrame:
    """(key, pos, words, license, cosine): the best template of every candidate line that has a term in common with one."""
    lines = documents.where(F.col(text_col).rlike(TRIGGER)).select(*key, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.col("line").rlike(TRIGGER))
    return _best(lines, [*key, "pos"], templates, least_cosine)


def _best(lines: DataFrame, key: Sequence[str], templates: Sequence[tuple[str, str]], least_cosine: float = 0.0) -> DataFrame:
    """(key, words, license, cosine): the best template of every line, or longer text in that column, that has a term in common with one.

    No cosine exceeds the share of a text's norm that lies in terms of templates, so
    texts in which that is below ``least_cosine`` meet no template.
    """
    weights, idf, unknown = template_weights(templates)
    spark = lines.sparkSession
    known = spark.createDataFrame(weights, "template int, license string, term string, weight double")
    ratios = spark.createDataFrame(list(idf.items()), "term string, idf double")
    terms = F.regexp_extract_all(F.translate("line", *_LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    # Words are counted before the terms are dealt out, or every term would count its text's words again.
    dealt = lines.select(*key, _words(F.col("line")).alias("words"), terms.alias("terms")).select(*key, "words", F.explode("terms").alias("term"))
    counted = stage(dealt.groupBy(*key, "words", "term").agg(F.count(F.lit(1)).alias("n")))
    # The templates are a fixed list, so both tables of terms are small by construction.
    weighed = counted.join(F.broadcast(ratios), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    square = F.col("w") * F.col("w")
    mass = weighed.groupBy(*key).agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("idf").isNotNull(), square).otherwise(0.0))).alias("known"))
    norm = stage(mass.where(F.col("known") >= (least_cosine - 1e-5) * F.col("norm")).select(*key, "norm"))
    dots = weighed.join(norm.select(*key), list(key), "left_semi").join(F.broadcast(known), "term").groupBy(*key, "words", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    best = F.max(F.struct("cosine", F.expr("transform(sequence(1, length(license)), i -> -ascii(substring(license, i, 1)))").alias("back"), "license"))
    found = scored.groupBy(*key, "words").agg(best.alias("best")).select(*key, "words", F.col("best.license").alias("license"), F.col("best.cosine").alias("cosine"))
    return stage(found, counted, norm)


def license_units(documents: DataFrame, key: Sequence[str], text_col: str, templates: Sequence[tuple[str, str]], least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(key, kind, pos, words, license, cosine) of candidate lines (kind 0), paragraphs (1) and whole documents (2); an SPDX identifier has the cosine 1."""
    texts = documents.where(F.col(text_col).rlike(TRIGGER))
    parts = lambda kind, of: texts.select(*key, F.lit(kind).alias("kind"), F.posexplode(of).alias("pos", "line")).where(F.col("line").rlike(TRIGGER))
    units = parts(0, F.split(text_col, "\n")).union(parts(1, F.split(text_col, _GAP))).union(parts(2, F.array(text_col)))
    names = documents.sparkSession.createDataFrame(sorted({(n.lower(), n) for n, _ in templates}), "low string, license string")
    tagged = units.where("kind = 0").withColumn("spdx", F.regexp_extract("line", SPDX, 1)).where("spdx != ''").withColumn("low", F.lower("spdx"))
    spdx = tagged.join(F.broadcast(names), "low", "left").select(*key, "kind", "pos", _words(F.col("line")).alias("words"), F.coalesce("license", "spdx").alias("license"), F.lit(1.0).alias("cosine"))
    return _best(units, [*key, "kind", "pos"], templates, least_cosine).unionByName(spdx)


def directory(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def scan_licenses(
    documents: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, least_cosine: float = LEAST_COSINE, file_percent: int = FILE_PERCENT,
) -> DataFrame:
    """Per document: id, path, own_license, cosine, is_file, inherited_license, license.

    own_license is the best license among the lines, paragraphs and whole texts
    whose cosine reaches ``least_cosine`` (the smaller name at a tie) and cosine its value; both are
    null without one, as for null or empty texts. A license file is a
    document with an own license of whose words at least ``file_percent`` percent
    lie in them; several in a directory: the best cosine, then the smaller
    name. inherited_license is that of the nearest directory at or above the
    document's, null if there is none or the path is null. license is the own one,
    else the inherited. Rows equal in id, path and text are each returned. Other
    columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "path", "text"))
    # Written once, as every kind of unit reads them; equal rows give equal lines.
    candidates = stage(rows.where(F.col("text").rlike(TRIGGER)).select("row", "text").dropDuplicates(["row"]))
    notices = license_lines(candidates, ["row"], "text", templates, least_cosine).select("row", F.lit(0).alias("kind"), "pos", "words", "license", "cosine")
    once = notices.unionByName(license_units(candidates, ["row"], "text", full_templates(), least_cosine)).where(F.col("cosine") >= least_cosine)
    top = F.max(F.struct("cosine", F.expr("transform(sequence(1, length(license)), i -> -ascii(substring(license, i, 1)))").alias("back"), "license"))
    units = once.groupBy("row", "kind", "pos").agg(top.alias("top"), F.first("words").alias("words"))
    kinds = units.groupBy("row", "kind").agg(F.max("top").alias("top"), F.sum("words").alias("words"))
    own = kinds.groupBy("row").agg(F.max("top").alias("top"), F.max("words").alias("license_words"))
    counted = candidates.select("row", _words(F.col("text")).alias("n_words")).join(own, "row")
    marked = rows.select("row", "path").join(counted, "row")
    is_file = 100 * F.col("license_words") >= file_percent * F.col("n_words")
    owned = marked.select("row", "path", F.col("top.license").alias("own_license"), F.col("top.cosine").alias("cosine"), is_file.alias("is_file")).distinct()
    owned = stage(owned, candidates)

    files = owned.where("is_file").select(directory(F.col("path")).alias("above"), F.struct(F.col("cosine"), F.expr("transform(sequence(1, length(own_license)), i -> -ascii(substring(own_license, i, 1)))").alias("back"), F.col("own_license")).alias("top"))
    speaks = files.groupBy("above").agg(F.max("top").alias("top")).select("above", F.col("top.own_license").alias("inherited_license"))
    folders = rows.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    ups = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above")).distinct()
    nearest = ups.join(speaks, "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "inherited_license")).alias("near"))
    inherited = nearest.select("folder", F.col("near.inherited_license").alias("inherited_license"))
    out = rows.select("id", "path", "row", directory(F.col("path")).alias("folder")).join(owned.drop("path"), "row", "left").join(inherited, "folder", "left")
    return out.select(
        F.col("id").alias(id_col), "path", "own_license", "cosine", F.coalesce("is_file", F.lit(False)).alias("is_file"), "inherited_license",
        F.coalesce("own_license", "inherited_license").alias("license"),
    )
