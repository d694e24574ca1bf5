"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

Words are compared lower-cased and without punctuation. A template of up to
``c`` shingles (c a power of two) lies whole in one of the windows of ``2c``
shingles that start at every multiple of ``c``, so a text that holds 0.8 of it
has a window with a Jaccard similarity of at least 0.8t / (2c + 0.2t) to it;
``bands_for`` picks so many one-row bands that such a window collides with the
wanted probability. A window collides with a template in a band exactly if it holds
the template's smallest shingle of that band and no smaller one. So the band join is
done from the templates' side: their band shingles are looked up among all shingles
of all texts by a hash join, and the windows round each place they occur at show
whether one of the bands agrees. Only windows that collide are verified.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import cut, documents
from tripspark.llm.quality_rules import BLANKS

#: Words of a shingle; templates with fewer words are one shingle of all their words.
WIDTH = 5
#: Words of all templates up to which their tables (some 50 bytes a word) are broadcast.
BROADCAST_WORDS = 500_000

#: Names that SPDX lines are looked for with.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib Unlicense BSL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
#: Public wordings of common licence notices (id, licence, text).
TEMPLATES = [
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit-line", "MIT", "Released under the MIT License"),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ccby-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ccbync-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("reserved-line", "proprietary", "All rights reserved"),
    ("apache11-line", "Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("mit-disclaimer", "MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("bsd-disclaimer", "BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("bsd3-endorse", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl2-line", "GPL-2.0", "under the GNU General Public License, version 2"),
    ("gpl2-name", "GPL-2.0", "GNU General Public License v2.0"),
    ("gpl3-name", "GPL-3.0", "GNU General Public License v3.0"),
    ("lgpl2-line", "LGPL-2.0", "GNU Library General Public License, version 2"),
    ("lgpl21-line", "LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl3-line", "LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("lgpl-notice", "LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl3-line", "AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("agpl-notice", "AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl11-notice", "MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl2-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-line", "MPL-2.0", "Mozilla Public License, version 2.0"),
    ("epl1-line", "EPL-1.0", "Eclipse Public License v 1.0"),
    ("epl2-line", "EPL-2.0", "Eclipse Public License v 2.0"),
    ("boost-line", "BSL-1.0", "Boost Software License Version 1.0"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ccby3-line", "CC-BY-3.0", "Creative Commons Attribution 3.0 Unported License"),
    ("ccby-short", "CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("ccbysa-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("ccbysa3-name", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported"),
    ("ccbysa-name", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("ccbync-name", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("ccbynd-name", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("ccbyncsa-name", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("ccbyncnd-name", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("cc0-name", "CC0-1.0", "CC0 1.0 Universal"),
    ("cc0-waiver", "CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("mit-body", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-body", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd2-body", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    *((f"spdx-{x.lower()}", x, f"SPDX-License-Identifier: {x}") for x in SPDX),
]


def family(license: str) -> str | None:
    """The licence without its version, if it has one."""
    found = re.fullmatch(r"(.+?)-[0-9][0-9.]*(?:-only|-or-later)?", license)
    return found and found[1]


def bands_for(jaccard: float, recall: float) -> int:
    """Bands of one row each, so that windows of this similarity collide with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard))


def words_of(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(bare, BLANKS, -1), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """64-bit hashes of the runs of ``width`` words of an array, in order."""

    def of(w: Column) -> Column:
        runs = F.transform(F.slice(w, 1, F.size(w) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))
        return F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(runs)

    # the words are bound to a variable: a filter pushed below the projection would else split the text once a word
    return F.transform(F.array(words), of)[0]


def template_tables(spark: SparkSession, templates: list[tuple[str, str, str]], containment: float, recall: float) -> tuple[DataFrame, DataFrame, set[int], int]:
    """(templates, bands, widths, words).

    templates: template_id, license, family, width, size (a power of two), t (the
    shingles), version (those of them with its version). bands: a row for each
    template and shingle that is its smallest in a band: x (the shingle), template_id,
    size, and the bands (k, least) it gives.
    """
    rows = spark.createDataFrame(templates, "template_id string, license string, text string").withColumn("words", words_of(F.col("text"))).where("size(words) > 0")
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    pick = F.lit(None).cast("array<bigint>")
    for width in range(1, WIDTH + 1):
        pick = F.when(F.col("width") == width, shingles(F.col("words"), width)).otherwise(pick)
    found = rows.select("template_id", "license", "width", "words", pick.alias("all"), F.array_distinct(pick).alias("t")).collect()  # the caller's own list
    out, most = [], {}
    for r in found:
        size = 1 << max(0, (len(r.t) - 1).bit_length())
        named = family(r.license)
        version = {h for i, h in enumerate(r["all"]) if named and any(re.fullmatch(r"v?[0-9]+", w) for w in r.words[i : i + r.width])}
        out.append((r.template_id, r.license, named, r.width, size, list(r.t), sorted(version)))
        most.setdefault(size, []).append(len(r.t))
    bands = {size: bands_for(containment * min(n) / (2 * size + (1 - containment) * min(n)), recall) for size, n in most.items()}
    table = spark.createDataFrame(out, "template_id string, license string, family string, width int, size int, t array<bigint>, version array<bigint>")
    many = spark.createDataFrame(list(bands.items()), "size int, bands int")
    least = F.expr("explode(transform(sequence(0, bands - 1), k -> struct(k, array_min(transform(t, x -> struct(xxhash64(x, k) AS least, x))) AS m)))")
    keys = table.join(many, "size").select("template_id", "size", least.alias("b")).select("template_id", "size", F.col("b.m.x").alias("x"), F.struct(F.col("b.k").alias("k"), F.col("b.m.least").alias("least")).alias("band"))
    keys = keys.groupBy("template_id", "size", "x").agg(F.collect_list("band").alias("bands"))
    return table, keys, {r[3] for r in out}, sum(len(r.words) for r in found)


def windows_by_row(rows: DataFrame, keys: DataFrame, start: Column) -> DataFrame:
    """doc_id, template_id, size, bands, s, start where the keys are shuffled: single shingles go to the join, and a row's shingles, once, only to the windows found in it.

    A row is named by a hash of its content, which both sides work out alike; should two rows share
    it, a window is looked at in either, and containment is exact there.
    """
    numbered = rows.withColumn("row", F.xxhash64("doc_id", "s"))
    slim = numbered.select("row", F.posexplode("s").alias("pos", "x")).join(keys, "x")
    found = slim.select("row", "template_id", "size", "bands", start.alias("start")).distinct()
    return numbered.join(found, "row").select("doc_id", "template_id", "size", "bands", "s", "start")


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """One row per document and template found in it: doc_id, template_id, license, containment, window_word.

    A match without any of the words that give its licence's version is left out where
    it overlaps a fuller match of another version. ``containment`` is the largest share of the template's shingles in one window,
    ``window_word`` the first word of the first such window. Null and empty texts
    hold no template. Rows that repeat an id are one document; a null id is kept.
    An empty table, or no templates, gives no rows. Other columns are not read.
    Templates of up to BROADCAST_WORDS words together are broadcast; more are joined by
    whatever plan their size asks for, with the same result.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, template_id string, license string, containment double, window_word bigint"
    if not any(t.strip() for _, _, t in templates):
        return spark.createDataFrame([], schema)
    table, keys, widths, n_words = template_tables(spark, templates, containment, recall)
    table, keys = cut(table), cut(keys)
    if n_words <= BROADCAST_WORDS:
        table, keys = F.broadcast(table), F.broadcast(keys)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("doc_id", F.explode(F.array(*(shingles(F.col("words"), w) for w in sorted(widths)))).alias("s"))
    # the band join, from the templates' side: where the shingle of a band occurs, is it the smallest of a window there?
    start = F.explode(F.expr("array_distinct(array(pos - pos % size, greatest(0, pos - pos % size - size)))"))
    if n_words <= BROADCAST_WORDS:
        met = rows.select("doc_id", "s", F.posexplode("s").alias("pos", "x")).join(keys, "x")
        windows = met.select("doc_id", "template_id", "size", "bands", "s", start.alias("start"))
    else:
        windows = windows_by_row(rows, keys, start)
    windows = windows.select("doc_id", "template_id", "size", "bands", "start", F.expr("slice(s, start + 1, 2 * size)").alias("window"))
    collides = F.expr("exists(bands, b -> b.least = array_min(transform(window, x -> xxhash64(x, b.k))))")
    pairs = windows.where(collides).select("doc_id", "template_id", "start", "window").join(table, "template_id")
    share = F.size(F.array_intersect("window", "t")) / F.size("t")
    vague = (F.size("version") > 0) & ~F.arrays_overlap("window", "version")
    stop = F.col("start") + 2 * F.col("size") + F.col("width") - 1
    found = cut(pairs.select("doc_id", "template_id", "license", "family", "start", stop.alias("stop"), vague.alias("vague"), share.alias("share")).where(F.col("share") >= containment))
    exact = found.where("family IS NOT NULL AND NOT vague").select(*(F.col(c).alias(f"x_{c}") for c in ("doc_id", "license", "family", "start", "stop", "share"))).distinct()
    other = F.col("doc_id").eqNullSafe(F.col("x_doc_id")) & (F.col("family") == F.col("x_family")) & (F.col("license") != F.col("x_license"))
    over = (F.col("start") < F.col("x_stop")) & (F.col("x_start") < F.col("stop")) & (F.col("x_share") > F.col("share"))
    found = found.join(exact, F.col("vague") & other & over, "left_anti")
    return found.groupBy("doc_id", "template_id", "license").agg(
        F.round(F.max("share"), 6).alias("containment"),
        F.min("start").cast("bigint").alias("window_word"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: Every window against every template, without hashing.
ORACLE = f"""
WITH t0 AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in TEMPLATES)}) v(template_id, license, text)),
t1 AS (SELECT template_id, license, {NORM} AS ws FROM t0), t2 AS (SELECT *, least(len(ws), {WIDTH}) AS k FROM t1),
ts AS (SELECT DISTINCT template_id, license, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM t2, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
tn AS (SELECT template_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS c FROM ts GROUP BY template_id),
dw AS (SELECT doc_id, {NORM} AS ws FROM documents),
dg AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(ws[i:i + k - 1], ' ') AS g FROM dw, (SELECT DISTINCT k FROM t2), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
hit AS (SELECT doc_id, template_id, license, pos - pos % c AS s, n, c, g FROM dg JOIN ts USING (k, g) JOIN tn USING (template_id)),
win AS (SELECT doc_id, template_id, license, s, n, g FROM hit UNION ALL SELECT doc_id, template_id, license, greatest(s - c, 0), n, g FROM hit),
sh AS (SELECT doc_id, template_id, license, s, count(DISTINCT g) / n AS share FROM win GROUP BY doc_id, template_id, license, s, n)
SELECT doc_id, template_id, license, round(max(share), 6) AS containment, min(s) AS window_word FROM sh WHERE share >= 0.8 GROUP BY doc_id, template_id, license
"""
