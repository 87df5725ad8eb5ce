"""Licence scans by MinHash over text windows, in DataFrame functions alone.

A text's five-word shingles are hashed.  A window of ``WINDOW`` shingles begins every ``STRIDE``; its
MinHash signature is the ``KEEP`` first of its hashes in a fixed order of all hashes, and each is one
band.  A licence with a window that shares a band with one of the text is a candidate; so is one whose
bottom sketch, the first of its own hashes in the opposite order, shares a hash with the text.  A
candidate matches if the text holds at least the share ``least`` of its shingles, counted exactly.

How sure the bands are: of two windows of eight that share five shingles, each has at most three of
its own, so the first shared one is among the four first of both.  Licences have a window at every
offset.  Changing a word costs five shingles, so a licence of six or more shingles that was edited in
place and keeps a share of 0.8 keeps a run of five that lies in a window of the text and one of its own.
Shingles that lie apart in the text need not share a window with anything.  Therefore the sketch: of t
shingles at most t - ceil(least * t) may be lacking, so one more than that is its size, and at least
one of it is in every text that matches, wherever its shingles lie.  No match is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, WINDOW, STRIDE, KEEP = 5, 8, 4, 4
MAX_KEYS = 50_000  # keys of all templates that are held in the plan; more of them are joined
MAX_BROADCAST = 4_000_000  # keys of a table that each task holds; beyond that the join shuffles

# Public licence notices, first sentences of public licences, and whole short licences.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software"
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "AGPL-3.0-notice": _GNU.format(it="This program", name="Affero General Public License", version="3"),
    "0BSD": f"{_ISC_GRANT}. {_ISC_WARRANTY}",
    "BSD-2-Clause-text": f"{_BSD_TWO} {_BSD_WARRANTY}",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD-3-Clause-text": f"{_BSD_TWO} {_BSD_NAMES} {_BSD_WARRANTY}",
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including "
        "the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works "
        "of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty."
    ),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": _GNU.format(it="This program", name="General Public License", version="3"),
    "ISC": _ISC_GRANT,
    "ISC-text": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-notice": _GNU.format(it="This library", name="Lesser General Public License", version="3"),
    "MIT": "Released under the MIT License",
    "MIT-permission": _MIT_GRANT,
    "MIT-text": (
        f"{_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        f"permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def bound(value: Column) -> Column:
    """One row per value: the plan computes it once here, where inlining would repeat it in lambdas."""
    return F.explode(F.array(value))


def with_shingles(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep`` and ``_h``, the hashes of the text's five-word shingles in order; shorter texts go.

    Words are runs of a-z and 0-9 of the text in lower case.
    """
    names = [f"_c{i}" for i in range(len(keep))]
    split = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+")
    words = df.select(*[c.alias(n) for c, n in zip(keep, names)], bound(F.array_remove(split, "")).alias("_w")).where(F.size("_w") >= WORDS)
    hashed = words.select(*names, bound(F.transform("_w", lambda w: F.xxhash64(w))).alias("_w"))
    at = F.sequence(F.lit(0), F.size("_w") - WORDS)
    return hashed.select(*names, bound(F.transform(at, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WORDS)]))).alias("_h"))


def band_keys(stride: int) -> Column:
    """The bands of all windows over ``_h``: of each, its ``KEEP`` largest hashes (the fixed order is downwards)."""
    end = F.greatest(F.size("_h") - WINDOW, F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), end, F.lit(stride)), F.array(end))
    window = lambda i: F.sort_array(F.array(*[F.get("_h", i + k) for k in range(WINDOW)]), asc=False)  # noqa: E731  nulls last
    return F.array_compact(F.flatten(F.transform(starts, lambda i: F.slice(window(i), 1, KEEP))))


def templates_table(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    """``(license, hashes, band_keys, sketch)`` of each template of at least five words."""
    base = with_shingles(spark.createDataFrame(sorted(templates.items()), "license string, body string"), "body", F.col("license"))
    base = base.select(F.col("_c0").alias("license"), "_h", bound(F.array_distinct("_h")).alias("hashes"))
    t = F.size("hashes")
    return base.select("license", "hashes", F.array_distinct(band_keys(1)).alias("band_keys"), F.slice(F.sort_array("hashes"), 1, t - F.ceil(least * t - 1e-9).cast("int") + 1).alias("sketch"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``(id_col, license, n_shared, n_shingles, containment)`` for every text and licence that match.

    ``n_shared`` of the licence's ``n_shingles`` distinct shingles are anywhere in the text, at least
    the share ``least``.  Null, empty and short texts match nothing; a text of any length is scanned
    whole, as one row of one task (8 bytes a word).  Repeated rows and null ids each give their own
    rows.  Templates under five words are ignored.  Other columns of ``docs`` are not read, whatever
    their names.

    The templates are a small given table: their keys are constants of the plan while there are at
    most ``MAX_KEYS`` of them, and joined by key beyond that, to every task up to ``MAX_BROADCAST``.
    """
    spark = docs.sparkSession
    table = templates_table(spark, TEMPLATES if templates is None else templates, least)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, license string, n_shared long, n_shingles long, containment double"
    size = table.agg(F.coalesce(F.sum(F.size("band_keys") + F.size("sketch")), F.lit(0))).first()[0]
    if not size:
        return spark.createDataFrame([], schema)
    keyed = with_shingles(docs, text_col, F.col(id_col)).select(F.col("_c0").alias("_id"), "_h", bound(band_keys(STRIDE)).alias("_k"))

    def match(hashes: Column, mine: Column) -> Column:
        return F.size(F.array_intersect(hashes, mine))

    if size <= MAX_KEYS:
        rows = table.collect()
        bands, sketches = (sorted({k for r in rows for k in r[c]}) for c in ("band_keys", "sketch"))
        hit = keyed.select("_id", "_h", F.array_intersect("_k", F.lit(bands)).alias("_b"), F.array_intersect("_h", F.lit(sketches)).alias("_s"))
        hit = hit.where((F.size("_b") > 0) | (F.size("_s") > 0))
        known = F.array(*[F.struct(F.lit(r.license).alias("license"), *[F.lit(list(r[c])).alias(c) for c in ("hashes", "band_keys", "sketch")]) for r in rows])
        near = F.filter(known, lambda t: F.arrays_overlap(t["band_keys"], F.col("_b")) | F.arrays_overlap(t["sketch"], F.col("_s")))
        pairs = hit.select("_id", "_h", F.explode(near).alias("t")).select("_id", "_h", "t.license", "t.hashes")
    else:
        by_band, by_sketch = (table.select("license", F.explode(c).alias("key")) for c in ("band_keys", "sketch"))
        if size <= MAX_BROADCAST:
            by_band, by_sketch = F.broadcast(by_band), F.broadcast(by_sketch)
        # a row is known by its id and its shingles: equal rows have the same licences, and each keeps its own
        keyed = keyed.withColumn("_row", F.xxhash64("_h"))
        found = [keyed.select("_id", "_row", F.explode(c).alias("key")).join(keys, "key").select("_id", "_row", "license") for c, keys in (("_k", by_band), ("_h", by_sketch))]
        found = found[0].unionByName(found[1]).distinct().select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "license")
        pairs = keyed.join(found, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2"))).join(table.select("license", "hashes"), "license").select("_id", "_h", "license", "hashes")
    out = pairs.select(F.col("_id").alias(id_col), "license", match(F.col("_h"), F.col("hashes")).cast("long").alias("n_shared"), F.size("hashes").cast("long").alias("n_shingles"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= least)


def oracle(templates: dict[str, str] | None = None, least: float = 0.8) -> str:
    """DuckDB SQL of ``scan`` over ``documents``: exact containment of every licence in every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted((templates or TEMPLATES).items()))
    split = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    five = "unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i : i + 4], ' ')))"
    return f"""
WITH notices(license, body) AS (VALUES {values}),
notice_words AS (SELECT license, {split.format('body')} AS w FROM notices),
notice_shingles AS (SELECT DISTINCT license, {five} AS s FROM notice_words),
sizes AS (SELECT license, count(*) AS n_shingles FROM notice_shingles GROUP BY license),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {split.format('text')} AS w FROM documents),
doc_shingles AS (SELECT r, doc_id, {five} AS s FROM doc_words),
shared AS (
  SELECT r, any_value(doc_id) AS doc_id, license, count(DISTINCT s) AS n_shared
  FROM doc_shingles JOIN notice_shingles USING (s) GROUP BY r, license)
SELECT doc_id, license, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_shingles AS BIGINT) AS n_shingles,
  CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM shared JOIN sizes USING (license) WHERE CAST(n_shared AS DOUBLE) / n_shingles >= {least}"""
