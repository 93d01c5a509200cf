"""Licence notices in texts by Dice's coefficient over word pairs, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.shared import ascii_lower, stored

#: fixed values: public licence notices
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause-line": "Use of this source code is governed by a BSD-style license.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def standard_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def _with_pairs(df: DataFrame, text: str, least: int = 1) -> DataFrame:
    """``df`` with ``pairs``: the set of pairs of neighbouring words of ``text``, as hashes.

    Words are runs of a-z and 0-9, A-Z lower-cased; rows with fewer than ``least`` pairs go early.
    The explodes of one array make Spark work out each step once, where it would put the whole
    expression into every place that uses it.
    """
    words = F.array_remove(F.split(ascii_lower(F.col(text)), "[^a-z0-9]+"), "")
    hashed = F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("words")
    df = df.select(*df.columns, hashed).filter(F.size("words") > least)
    pairs = F.zip_with(
        F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")),
        lambda a, b: F.xxhash64(a, b),
    )
    kept = [c for c in df.columns if c != "words"]
    return df.select(*kept, F.explode(F.array(F.array_distinct(pairs))).alias("pairs"))


def _telling_words(templates: DataFrame, per_cent: int) -> DataFrame:
    """Words of which every match holds one.

    A match shares at least ``per_cent / (200 - per_cent)`` of a template's pairs, so of any set of
    more pairs than may be missing it has one, and then that pair's longer word. The pairs with the
    longest words are taken, as these are rare in other texts.
    """
    words = F.array_remove(F.split(ascii_lower(F.col("text")), "[^a-z0-9]+"), "")
    pair = lambda a, b: F.when(F.length(a) >= F.length(b), F.struct(a.alias("w"), b.alias("v"), F.lit(0).alias("at")))
    pairs = F.array_distinct(F.zip_with(
        F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")),
        lambda a, b: pair(a, b).otherwise(F.struct(b.alias("w"), a.alias("v"), F.lit(1).alias("at"))),
    ))
    each = (
        templates.select(F.col("text"), words.alias("words")).filter(F.size("words") > 1).distinct()
        .select("text", pairs.alias("pairs"))
        .select("text", F.size("pairs").alias("size"), F.explode("pairs").alias("p"))
    )
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.length("p.w").desc(), "p"))
    missing = F.col("size") - F.ceil(F.col("size") * per_cent / (200 - per_cent))
    return each.withColumn("place", place).filter(F.col("place") <= missing + 1).select("p.w").distinct()


def _whole_words(words: list[str]) -> str:
    """A pattern for any of ``words`` (a-z, 0-9, in either case) as a whole word; none of none.

    Grouped by first letter after a look back, so that most places of a text fail at once.
    """
    tails: dict[str, list[str]] = {}
    for word in sorted(words):
        tails.setdefault(word[0], []).append(word[1:])
    if not tails:
        return "(?!)"
    either = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())
    return f"(?i)(?<![a-z0-9])(?=[{''.join(tails)}])(?:{either})(?![a-z0-9])"


def license_matches(
    docs: DataFrame, templates: DataFrame, per_cent: int = 85, broadcast_rows: int = 1_000_000,
    most_words: int = 2000,
) -> DataFrame:
    """Licences named in ``docs(doc_id, text)``: a row per document and template of ``templates(license, text)``.

    Compared are the whole text, its blocks between blank lines, its lines and its sentences, each
    once. Dice's coefficient 2|A & B| / (|A| + |B|) of the sets of word pairs must reach
    ``per_cent``. It cannot if the sizes differ too much, so a template meets only units with sizes
    in its bounds, and units outside of all bounds are left out before their pairs are looked at.
    Texts and units without any word that a match must hold are left out before they are cut up;
    if templates need more than ``most_words`` such words, this step is left out, with equal results.

    Returns doc_id, license, n_units (matching units, distinct texts), n_common and n_pairs (common
    and summed sizes of the best unit; dice = 2 n_common / n_pairs) and dice, rounded. Texts and
    templates with fewer than two words have no pairs and match nothing. Repeated rows of a doc_id
    count as one document, templates that share a name as one licence. Null and empty texts match
    nothing; empty tables give an empty result; other columns are ignored.
    """
    named = templates.select(F.col("license"), F.col("text"), F.xxhash64("license", "text").alias("template"))
    known = _with_pairs(named, "text").dropDuplicates(["template"])
    t = F.col("size")
    known = stored(known.select(
        "license", "template", F.size("pairs").alias("size"), F.explode("pairs").alias("pair")
    ).withColumns({
        "least": F.ceil(t * per_cent / (200 - per_cent)).cast("int"),
        "most": F.floor(t * (200 - per_cent) / per_cent).cast("int"),
    }))
    bounds = known.agg(F.min("least"), F.max("most"), F.count(F.lit(1))).first()
    near = F.broadcast if bounds[2] <= broadcast_rows else (lambda df: df)
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(
        F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, r"\n"), F.split(text, r"(?<=[.!?])\s+")
    ))
    told = [r.w for r in _telling_words(templates, per_cent).limit(most_words + 1).collect()]
    if len(told) > most_words:
        holds = lambda name: F.lit(True)
    else:
        holds = lambda name: F.col(name).rlike(_whole_words(told))
    each = docs.filter(holds("text")).select(F.col("doc_id"), F.explode(units).alias("unit")).filter(holds("unit"))
    each = each.filter(F.length("unit") > 2)
    sized = _with_pairs(each.withColumn("id", F.xxhash64("unit")), "unit", max(bounds[0] or 1, 1)).select(
        "doc_id", F.col("id").alias("unit"), F.size("pairs").alias("n"), "pairs"
    ).filter(F.col("n").between(bounds[0] or 0, bounds[1] or 0))
    rows = sized.select("doc_id", "unit", "n", F.explode("pairs").alias("pair"))
    fits = (rows.pair == known.pair) & rows.n.between(known.least, known.most)
    common = rows.join(near(known), fits).groupBy("doc_id", "unit", "n", "license", "template", "size").agg(
        F.countDistinct(rows.pair).alias("common")
    )
    good = common.filter(F.col("common") * 200 >= (F.col("n") + F.col("size")) * per_cent)
    dice = F.round(2 * F.col("common") / (F.col("n") + F.col("size")), 6)
    return good.groupBy("doc_id", "license").agg(
        F.countDistinct("unit").alias("n_units"),
        F.max(F.struct(dice.alias("dice"), "common", (F.col("n") + F.col("size")).alias("pairs"))).alias("b"),
    ).select("doc_id", "license", "n_units", F.col("b.common").cast("long").alias("n_common"),
             F.col("b.pairs").cast("long").alias("n_pairs"), F.col("b.dice").alias("dice"))
