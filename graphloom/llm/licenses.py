"""License scans by MinHash bands over overlapping windows. DataFrame and SQL functions only.

Templates are grouped by width: the least power of two W that holds their shingles. For
each width a text's shingles are cut into windows of 2 W, one every W, so that a stretch
of a template's length lies whole in a window. A window that shares no shingle with any
template of its width can't contain one and is left out. The others get `BANDS` MinHash
values, one a band. A window that holds a share c of a template's n > W / 2 shingles is
alike to it by c n / (2 W + (1 - c) n), over 0.19 for c = 0.8, and misses all 64 bands with
a chance under 0.81 ** 64 = 2e-6. What a band retrieves is verified: at least 0.8 of the
template's distinct shingles are in the window.

The template list is a parameter (a tuple, or a table of license and text) and no part of the corpus. Its shingles
are literals of the plan, MOST_LITERALS at a time. Identifier lines are too short for a shingle: they are
found as they are written.

Defined results: a null or empty text, or one with fewer words than a shingle, has no
matches; repeated rows each match; an empty table gives no rows; whole texts are read;
other columns aren't looked at. A document without a match has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE, LEAST, BANDS = 5, 0.8, 64
# Notices and short texts as their licenses publish them. Names are SPDX identifiers, with the part where it isn't the whole.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0-header-end", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause-conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0-header", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("BSL-1.0-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ODbL-1.0", "is made available under the Open Database License"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)
#: Shingles of all templates together that a plan takes as literals; a longer list is scanned in several passes.
MOST_LITERALS = 20_000
_IDENTIFIER = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"


def _shingles(text: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles, in order. Words: runs of a-z and 0-9 after lower-casing A-Z."""
    lower = F.lower(text)
    words = F.split(F.regexp_replace(lower, "^[^a-z0-9]+|[^a-z0-9]+$", ""), "[^a-z0-9]+")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))))[0]


def templates(spark: SparkSession, listed: tuple | DataFrame = TEMPLATES, k: int = SHINGLE) -> DataFrame:
    """license, h (its distinct shingles), width."""
    rows = listed.select("license", "text") if isinstance(listed, DataFrame) else spark.createDataFrame(list(listed), "license string, text string")
    rows = rows.select("license", F.array_distinct(_shingles(F.col("text"), k)).alias("h")).where("h is not null")
    return rows.withColumn("width", F.pow(F.lit(2), F.ceil(F.log2(F.size("h")))).cast("int"))


def _bands(h: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, j))).alias("least")))


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, license, lines: what SPDX identifier lines name, as it is written."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_IDENTIFIER), F.lit(1))).alias("license")).groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("lines"))


def scan(docs: DataFrame, listed: tuple | DataFrame = TEMPLATES, k: int = SHINGLE, least: float = LEAST, bands: int = BANDS, most: int = MOST_LITERALS) -> DataFrame:
    """docs with doc_id, text -> doc_id, license, first_word (of the first window; null for identifier lines alone), windows (and identifier lines), containment (the greatest)."""
    known = templates(docs.sparkSession, listed, k)
    sizes = sorted(known.groupBy("license").agg(F.sum(F.size("h"))).collect())  # the list itself
    passes, held = [[]], 0
    for name, n in sizes:
        if held and held + n > most:
            passes, held = [*passes, []], 0
        passes[-1].append(name)
        held += n
    lines = identifiers(docs).select("doc_id", "license", F.lit(None).cast("long").alias("first_word"), F.col("lines").alias("windows"), F.lit(1.0).alias("containment"))
    for names in passes:
        if names:
            lines = lines.union(_scan(docs, known.where(F.col("license").isin(names)), k, least, bands))
    return lines.groupBy("doc_id", "license").agg(F.min("first_word").alias("first_word"), F.sum("windows").alias("windows"), F.max("containment").alias("containment"))


def _scan(docs: DataFrame, known: DataFrame, k: int, least: float, bands: int) -> DataFrame:
    by_width = {w: sorted(h) for w, h in known.groupBy("width").agg(F.array_distinct(F.flatten(F.collect_list("h")))).collect()}  # MOST_LITERALS, or one template
    literal = lambda hs: F.array(*[F.lit(x) for x in hs])
    every = literal(sorted({x for h in by_width.values() for x in h}))
    texts = docs.select("doc_id", _shingles(F.col("text"), k).alias("h")).where(F.col("h").isNotNull()).where(F.arrays_overlap("h", every))
    starts = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / w).cast("int") + 1), lambda i: F.struct(F.lit(w).alias("width"), (i * w - w).alias("start")))
    cuts = F.explode(F.flatten(F.array(*map(starts, by_width))))
    part = F.slice("h", F.greatest(F.col("cut.start"), F.lit(0)) + 1, F.col("cut.width") * 2 + F.least(F.col("cut.start"), F.lit(0)))
    windows = texts.select("doc_id", "h", cuts.alias("cut")).select("doc_id", "cut.width", F.greatest(F.col("cut.start"), F.lit(0)).alias("start"), part.alias("h"))
    own = F.coalesce(*[F.when(F.col("width") == w, F.arrays_overlap("h", literal(h))) for w, h in by_width.items()])
    windows = windows.where(own)
    found = windows.select("doc_id", "width", "start", "h", F.explode(_bands(F.col("h"), bands)).alias("b")).select("doc_id", "width", "start", "h", "b.*")
    wanted = known.select("license", F.col("h").alias("t"), F.col("width").alias("w"), F.explode(_bands(F.col("h"), bands)).alias("b")).select("license", "t", "w", F.col("b.band").alias("tb"), F.col("b.least").alias("tl"))
    met = found.join(wanted, (found.width == wanted.w) & (found.band == wanted.tb) & (found.least == wanted.tl))
    share = F.size(F.array_intersect("t", "h")) / F.size("t")
    met = met.select("doc_id", "license", "start", share.alias("share")).where(F.col("share") >= least)
    once = met.groupBy("doc_id", "license", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(F.min("start").cast("long").alias("first_word"), F.count(F.lit(1)).alias("windows"), F.max("share").alias("containment"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    listed = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in TEMPLATES)
    words = lambda t: f"string_split_regex(regexp_replace(lower({t}), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '[^a-z0-9]+')"
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(SHINGLE))
    return f"""
    with tpl as (select license, {words('t')} as w from (values {listed}) v(license, t)),
    tsh as (select distinct license, {shingle} as s from (select license, w, unnest(range(1, len(w) - {SHINGLE - 2})) as i from tpl)),
    tn as (select license, count(*) as n, (2 ** ceil(log2(count(*))))::INT as width from tsh group by license),
    dw as (select doc_id, {words('text')} as w from documents),
    dsh as (select doc_id, i - 1 as p, {shingle} as s from (select doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) as i from dw where len(w) >= {SHINGLE})),
    hit as (select doc_id, license, n, width, s, unnest([p // width - 1, p // width]) as c from dsh join tsh using (s) join tn using (license)),
    win as (select doc_id, license, greatest(c * width, 0) as start, count(distinct s) / n as share from (select * from hit where c >= -1) group by doc_id, license, c, width, n),
    ok as (select doc_id, license, start, max(share) as share from win where share >= {LEAST} group by all),
    spdx as (select doc_id, unnest(regexp_extract_all(text, '{_IDENTIFIER}', 1)) as license from documents),
    every as (select doc_id, license, start, share from ok union all select doc_id, license, null, 1.0 from spdx)
    select doc_id, license, min(start)::BIGINT as first_word, count(*)::BIGINT as windows, max(share)::DOUBLE as containment from every group by doc_id, license"""


QUERIES = {"op5_license_scan": op5_license_scan}
SQL = {"op5_license_scan": _sql()}
