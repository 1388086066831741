"""Finding license texts, in DataFrame functions only.

A text's words make five-word shingles, which are hashed once. Windows of shingles overlap by half, at three lengths. Each
window is reduced by one-permutation MinHash: hashes fall into bins by their highest bits and a bin keeps its least. Each bin
is a band of its own. A template is looked for at the length whose half holds it, so some window holds it wholly and is at
most a few times as long; a band misses it only if a foreign shingle is smaller in the same bin. The shortest windows have
65,536 bins for their 8 shingles, so that even a template of one shingle, alone in the one window at a text's end, is missed
in about 5 cases of 100,000; longer ones have a band for nearly each of their shingles. Templates longer than the longest windows are met by windows inside them,
where their least hashes stay the least. What the bands retrieve is verified by the share of the template's shingles that the
text holds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.words import dealt

#: Short public notices, opening passages and whole texts of widespread licenses.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved. No part of this publication may be reproduced"],
    "MIT-text": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "ISC-text": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "BSD-2-Clause-text": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "Zlib-text": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""],
    "Unlicense-text": ["""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""],
}
SHINGLE = 5
#: Half a window's length in shingles, and the highest bits that number its bins.
LEVELS = ((4, 16), (16, 8), (64, 6))


def _with(value: Column, body) -> Column:
    """body applied to value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the shingles of a text in order; of fewer than five words, of them all; none without words."""

    def hashed(w):
        last = F.greatest(F.size(w) - F.lit(SHINGLE - 1), F.lit(1))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))
        )

    return _with(words(F.coalesce(text, F.lit(""))), hashed)


def least_of_bins(hashes: Column, bits: int) -> Column:
    """The least hash of each bin that has any."""
    return _with(
        F.array_sort(hashes),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - bits) != F.shiftright(F.get(s, i - F.lit(1)), 64 - bits))),
    )


def bands(h: Column, half: int, bits: int) -> Column:
    """The bands of all windows of one length."""

    def windows(h):
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - F.lit(half), F.lit(1)), F.lit(half))
        return F.flatten(F.transform(starts, lambda i: least_of_bins(F.slice(h, i, F.lit(2 * half)), bits)))

    return _with(h, windows)


def level_of(n: int) -> int:
    return next((k for k, (half, _) in enumerate(LEVELS) if n <= half), len(LEVELS) - 1)


def prepared(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> list[tuple]:
    """(license, template number, shingles, level, bands) of each template, worked out by Spark. As many as are given."""
    rows = [(name, i, t) for name, texts in (templates or TEMPLATES).items() for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "license string, template int, words string")
    frame = frame.select("license", "template", F.array_distinct(shingles(F.col("words"))).alias("h")).where(F.size("h") > 0)
    out = []
    for r in frame.select("*", *[least_of_bins(F.col("h"), bits).alias(f"b{k}") for k, (_, bits) in enumerate(LEVELS)]).collect():
        level = level_of(len(r.h))
        out.append((r.license, r.template, r.h, level, r[f"b{level}"]))
    return sorted(out)


def _constant(value, kind: str) -> Column:
    """One literal of any kind and length, which the optimiser folds before it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _looked_up(keys: Column, values: Column):
    """A function from a key to the value at its place."""
    return lambda key: F.element_at(values, F.array_position(keys, key).cast("int"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least_share: float = 0.8) -> DataFrame:
    """One row per row of docs and license found in it: id_col, license, template int, containment double, first_word long.

    A license is found if a window's band retrieves one of its templates and the text holds at least least_share of that
    template's shingles. Of a license's templates the one held best is named (of equals the longest, then the first).
    first_word counts the words before the first of these shingles. Null, empty and blank texts have none; repeated rows
    each have their own; an empty table gives no rows; other columns are ignored. Rows are dealt over idle tasks only
    where the table has fewer splits than the cluster has cores; the templates travel in the plan as one literal, so their
    number, some thousands, is the caller's bound.
    """
    known = prepared(docs.sparkSession, templates)
    # exploding an array of one keeps the optimiser from working anything out anew wherever it is used
    rows = dealt(docs.select(id_col, text_col)).select(F.col(id_col), F.explode(F.array(shingles(F.col(text_col)))).alias("h")).where(F.size("h") > 0)
    hit, named = F.lit(False), [F.array().cast("array<int>")]
    for k, (half, bits) in enumerate(LEVELS):
        owners: dict[int, list[int]] = {}
        for i, (*_, level, own) in enumerate(known, 1):
            for band in own if level == k else ():
                owners.setdefault(band, []).append(i)
        if owners:
            wanted, of = _constant(sorted(owners), "array<bigint>"), _constant([owners[b] for b in sorted(owners)], "array<array<int>>")
            rows = rows.select("*", F.explode(F.array(F.array_intersect(bands(F.col("h"), half, bits), wanted))).alias(f"met{k}"))
            hit = hit | (F.size(f"met{k}") > 0)
            named.append(F.flatten(F.transform(f"met{k}", _looked_up(wanted, of))))
    texts = _constant([{"license": license, "template": number, "h": h} for license, number, h, *_ in known], "array<struct<license:string,template:int,h:array<bigint>>>")

    def verified(i):
        def compared(t):
            both = F.array_intersect(F.col("h"), t["h"])  # in order of the text
            held = F.size(both) / F.size(t["h"])
            at = F.array_position("h", F.element_at(both, 1)) - F.lit(1)
            return F.struct(t["license"].alias("license"), (-held).alias("order"), (-F.size(t["h"])).alias("n"), t["template"].alias("template"), held.alias("containment"), at.cast("long").alias("first_word"))

        return _with(F.element_at(texts, i), compared)

    retrieved = rows.where(hit).select(id_col, "h", F.explode(F.array(F.array_distinct(F.concat(*named)))).alias("candidates"))
    found = F.array_sort(F.filter(F.transform("candidates", verified), lambda x: x["containment"] >= least_share))
    best = _with(found, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["license"] != F.get(a, i - F.lit(1))["license"])))
    return retrieved.select(id_col, F.explode(best).alias("f")).select(id_col, "f.license", "f.template", "f.containment", "f.first_word")


def brute_force_sql(least_share: float = 0.8) -> str:
    """DuckDB SQL over a table documents for what scan finds: every template against every text."""
    values = ", ".join("('{}', {}, '{}')".format(name, i, t.replace("'", "''")) for name, texts in TEMPLATES.items() for i, t in enumerate(texts))
    cut = lambda text: rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = lambda table, keys: f"SELECT {keys}, p - 1 AS place, array_to_string(words[p:p + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM {table} WHERE len(words) > 0)"
    return f"""
        WITH t AS (SELECT license, template, {cut('body')} AS words FROM (VALUES {values}) v(license, template, body)),
        tg AS (SELECT license, template, gram, count(*) OVER (PARTITION BY license, template) AS n FROM (SELECT DISTINCT license, template, gram FROM ({grams('t', 'license, template')}))),
        d AS (SELECT doc_id, {cut('text')} AS words FROM documents),
        dg AS (SELECT doc_id, gram, min(place) AS place FROM ({grams('d', 'doc_id')}) GROUP BY doc_id, gram),
        m AS (SELECT doc_id, license, template, count(*) / any_value(n)::DOUBLE AS containment, min(place)::BIGINT AS first_word, any_value(n) AS n
              FROM dg JOIN tg USING (gram) GROUP BY doc_id, license, template HAVING count(*) / any_value(n)::DOUBLE >= {least_share}),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, n DESC, template) AS k FROM m)
        SELECT doc_id, license, template::INTEGER AS template, containment, first_word FROM r WHERE k = 1
    """
