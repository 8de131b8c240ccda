"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. Each trigger word of a file is laid on the first one of each template, and the words in the
template's length around it, with or without trigger words and across line ends, form a block; so what stands beside a
notice does not dilute it. Term vectors are compared by array functions, with the weights of the (fixed, small) templates as
literals; a term that no template has gets the largest weight. The best block counts, if it names its licence or is close to a
long text of it: what several licences say alike names none of them. Licence files give their licence to their directory;
a file without a licence of its own takes that of the nearest directory above it.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import hot_join, settle, table, temporary

#: Notices by SPDX id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software, you can redistribute it under the terms of the GNU General Public License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Whole short licences, whole standard headers, titles of long licences and SPDX lines, for the blocks.
TEXTS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "BSD-3-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    # neighbours, so that a block of theirs is not taken for one of the above
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "MPL-1.1": [
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.',
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
        "Mozilla Public License Version 1.1",
        "SPDX-License-Identifier: MPL-1.1",
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal.", "This work is licensed under a Creative Commons CC0 1.0 Universal License.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL-1.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc.",
        "SPDX-License-Identifier: GPL-1.0-only",
        "SPDX-License-Identifier: GPL-1.0-or-later",
    ],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "GFDL-1.3": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc.",
        "SPDX-License-Identifier: GFDL-1.3-only",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
    ],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc.",
        "SPDX-License-Identifier: LGPL-2.0-only",
        "SPDX-License-Identifier: LGPL-2.0-or-later",
    ],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
}
TRIGGER = "licen[sc]e|copyright|spdx|redistribution"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
#: Least cosine, in thousandths, for a match.
THRESHOLD = 300
#: A block near a template of at most SHORT words must also hold a name that the template has; a longer one must reach CLOSE
#: and have at least half as many words as the template.
NAMES, SHORT, CLOSE = "apache|^mit$|^isc$|gnu|gpl|bsd|^cc|commons|mozilla|^mpl|gfdl", 30, 600
_TERM = "[^a-z0-9.-]+"


def _terms(text: str) -> list[str]:
    return [t for t in (x.strip(".-") for x in re.split(_TERM, text.lower())) if t]


def template_sentences() -> dict[str, list[str]]:
    """Each sentence of a template, and the whole, is a template; a file may quote either."""
    return {k: [v, *(s for s in re.split(r"(?<=\.) ", v) if re.search(TRIGGER, s.lower()))] for k, v in TEMPLATES.items()}


def block_templates() -> dict[str, list[str]]:
    """The templates of the blocks: those above, and the whole texts."""
    old = template_sentences()
    return {k: list(dict.fromkeys((*old.get(k, ()), *v))) for k, v in TEXTS.items()}


def laid() -> list[tuple[str, list[str], int]]:
    """Of each template its licence, its terms and the place of its first trigger word."""
    rows = [(k, _terms(s)) for k, all_ in block_templates().items() for s in all_]
    return [(k, terms, next(i for i, t in enumerate(terms) if re.search(TRIGGER, t))) for k, terms in rows]


def weights() -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequency of the terms, the weight of any other term, and the unit vector of each template."""
    rows = [terms for _, terms, _ in laid()]
    n = len(rows)
    idf = {t: math.log((1 + n) / (1 + sum(t in terms for terms in rows))) + 1 for t in sorted({t for terms in rows for t in terms})}
    out = []
    for terms in rows:
        v = {t: terms.count(t) * idf[t] for t in sorted(set(terms))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return idf, math.log(1 + n) + 1, out


def _lower(text: Column) -> tuple[Column, Column]:
    """The text in lower case, and whether it can hold a trigger word."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    # plain searches are cheap, and few texts get further
    return lower, lower.contains("licen") | lower.contains("copyright") | lower.contains("spdx") | lower.contains("redistribution")


def _split(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _TERM), lambda x: F.regexp_replace(x, r"^[.-]+|[.-]+$", "")), lambda x: x != "")


def blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """`files` with ``__l_block``: (c: less the best cosine in thousandths, k: its licence) over all blocks, or null."""
    idf, other, vectors = weights()
    rows = [{"k": k, "q": hit, "n": len(terms), "v": v, "names": [t for t in v if re.search(NAMES, t)]} for (k, terms, hit), v in zip(laid(), vectors, strict=True)]
    # one literal each, so that plans stay small
    known, table_ = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in ((rows, "array<struct<k: string, q: int, n: int, v: map<string, double>, names: array<string>>>"), (idf, "map<string, double>")))
    lower, any_ = _lower(F.col(text))
    weighed = F.transform("__l_all", lambda t: F.struct(t.alias("t"), F.coalesce(F.element_at(table_, t), F.lit(other)).alias("w")))
    hits = F.filter(F.transform("__l_all", lambda t, i: F.when(t.rlike(TRIGGER), i + 1)), lambda i: i.isNotNull())

    def add(a: Column, x: Column) -> Column:
        # equal terms stand side by side: s is the weight of the term so far, n the square of the length
        s = F.when(x["t"] == a["t"], a["s"]).otherwise(F.lit(0.0))
        return F.struct(x["t"].alias("t"), (s + x["w"]).alias("s"), (a["n"] + x["w"] * (2 * s + x["w"])).alias("n"))

    def scored(p: Column, t: Column) -> Column:
        start = p - t["q"]
        block = F.slice("__l_at", F.greatest(start, F.lit(1)), t["n"] + F.least(start - 1, F.lit(0)))
        dot = F.aggregate(block, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at(t["v"], x["t"]), F.lit(0.0)))
        norm = F.aggregate(F.array_sort(block), F.struct(F.lit("").alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), add, lambda a: F.sqrt(a["n"]))
        c = F.floor(dot / norm * 1000 + 0.5).cast("int")
        named = F.exists(block, lambda x: F.array_contains(t["names"], x["t"]))
        ok = F.when(t["n"] <= SHORT, named).otherwise((c >= CLOSE) & (2 * F.size(block) >= t["n"]))
        return F.when(ok, F.struct((-c).alias("c"), t["k"].alias("k")))

    each = F.transform("__l_hits", lambda p: F.array_min(F.transform(known, lambda t: scored(p, t))))
    out = files.withColumn("__l_all", F.when(any_, _split(lower)).otherwise(F.array().cast("array<string>")))
    return out.withColumns({"__l_at": weighed, "__l_hits": hits}).withColumn("__l_block", F.array_min(each)).drop("__l_all", "__l_at", "__l_hits")


def scanned(files: DataFrame, text: str = "text") -> DataFrame:
    """`files` with ``own_license`` and ``cosine_milli`` (thousandths), null where nothing matches. Narrow.

    Null and empty texts match nothing; texts are read whole. Of licences with equal cosines the first by name counts.
    Repeated rows give a row each, an empty table none. Columns of the input that bear a result's name give way.
    """
    has = blocks(files, text)
    ok = F.col("__l_block")["c"] <= -THRESHOLD
    return has.withColumns({"own_license": F.when(ok, F.col("__l_block")["k"]), "cosine_milli": F.when(ok, -F.col("__l_block")["c"])}).drop("__l_block")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """`files` (scanned) with ``license``, ``license_from`` (null for an own licence, else the directory) and ``depth``.

    Directories resolve their licence once, however many files they hold: distinct directories meet the licences of
    their ancestors in a join on the directory, and the deepest ancestor wins. A directory with several licence files
    takes the one with the largest cosine, of equals the first by name. Null paths have no directory and inherit nothing.
    Repeated rows get a row each; an empty table gives none. Columns of the input that bear a result's name give way,
    all others stay, whatever their name. `files` is read several times and should be a settled table.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    dir_ = F.when(F.col(path).contains("/"), F.regexp_replace(F.col(path), "/[^/]*$", "")).otherwise("")
    f = files.drop("license", "license_from", "depth").withColumn("__l_dir", F.when(F.col(path).isNotNull(), dir_))
    given = f.where(name.rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    best = given.groupBy(F.col("__l_dir").alias("__l_up")).agg(F.min(F.struct((-F.col("cosine_milli")).alias("c"), F.col("own_license").alias("k"))).alias("b")).select("__l_up", F.col("b")["k"].alias("__l_given"))
    dirs = settle(f.where("__l_dir is not null").groupBy("__l_dir").agg(F.count("*").alias("__l_files")), "dirs")
    steps = F.split("__l_dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))
    above = settle(dirs.select("__l_dir", F.explode(up).alias("u")).select("__l_dir", "u.depth", F.col("u.up").alias("__l_up")), "above")
    # a directory near the root stands above many; how many is known before the join
    best = settle(above.groupBy("__l_up").agg(F.count("*").alias("__l_below")).join(best, "__l_up"), "best")
    near = hot_join(above, best, ["__l_up"], "__l_below").groupBy("__l_dir").agg(F.max(F.struct("depth", "__l_up", "__l_given")).alias("__l_near"))
    near = settle(dirs.join(near, "__l_dir", "left"), "near")
    found = hot_join(f.where("__l_dir is not null"), near, ["__l_dir"], "__l_files")
    out = found.unionByName(f.where("__l_dir is null").withColumn("__l_near", F.lit(None).cast(near.schema["__l_near"].dataType)))
    own, at = F.col("own_license").isNotNull(), F.col("__l_near")
    return out.withColumns(
        {"license": F.coalesce("own_license", at["__l_given"]), "license_from": F.when(~own, at["__l_up"]), "depth": F.when(~own, at["depth"])}
    ).drop("__l_dir", "__l_near")


#: A file tree over `documents`: directories by source, language and id, with every seventh licensed file a licence file.
_PATH = "concat(source, '/', CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 < 4 THEN concat(lang, '/') ELSE concat(lang, '/', cast(doc_id % 97 as {string}), '/') END, CASE WHEN doc_id % 7 IN (0, 1, 4) AND lower(text) LIKE '%license%' THEN 'LICENSE' ELSE concat(cast(doc_id as {string}), '.txt') END)"


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document in a file tree derived from source, language and id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_PATH.format(string="string")).alias("path"))
    with temporary(spark) as done:
        # small rows, written once: the inheritance reads them three times
        found = settle(scanned(docs).select("doc_id", "path", "own_license", "cosine_milli"), "scanned")
        return done(settle(inherit(found).select("doc_id", "path", "own_license", "cosine_milli", "license", "license_from", "depth"), "licenses"))


def _sql() -> str:
    idf, other, vectors = weights()
    q = lambda s: "'" + s + "'"
    idf_rows = ", ".join(f"({q(t)}, {w!r}::DOUBLE)" for t, w in idf.items())
    vec_rows = ", ".join(f"({i}, {q(t)}, {w!r}::DOUBLE, {bool(re.search(NAMES, t))})" for i, v in enumerate(vectors) for t, w in v.items())
    tpl_rows = ", ".join(f"({i}, {q(k)}, {hit}, {len(terms)})" for i, (k, terms, hit) in enumerate(laid()))
    return f"""WITH idf(t, w) AS (VALUES {idf_rows}), vec(i, t, w, name) AS (VALUES {vec_rows}), tpl(i, k, q, n) AS (VALUES {tpl_rows}),
d AS (SELECT doc_id, text, {_PATH.format(string="varchar")} AS path FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '{_TERM}'), lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g')), lambda t: t <> '') AS w FROM d WHERE regexp_matches(lower(text), 'licen|copyright|spdx|redistribution')),
h AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda p: regexp_matches(w[p], '{TRIGGER}'))) AS p FROM w),
b AS (SELECT doc_id, p, i, k, n, w[greatest(p - q, 1) : p - q + n - 1] AS block FROM h, tpl),
v AS (SELECT doc_id, p, i, any_value(k) AS k, any_value(n) AS n, t, count(*) AS c FROM (SELECT doc_id, p, i, k, n, unnest(block) AS t FROM b) GROUP BY doc_id, p, i, t),
cos AS (SELECT doc_id, p, v.i, any_value(k) AS k, any_value(n) AS n, bool_or(coalesce(name, false)) AS named, sum(v.c) AS words,
  CAST(floor(sum(v.c * coalesce(idf.w, {other!r}::DOUBLE) * coalesce(vec.w, 0)) / sqrt(sum((v.c * coalesce(idf.w, {other!r}::DOUBLE)) ** 2)) * 1000 + 0.5) AS INTEGER) AS c
  FROM v LEFT JOIN idf ON idf.t = v.t LEFT JOIN vec ON vec.t = v.t AND vec.i = v.i GROUP BY doc_id, p, v.i),
best AS (SELECT doc_id, k, c FROM cos WHERE c >= {THRESHOLD} AND CASE WHEN n <= {SHORT} THEN named ELSE c >= {CLOSE} AND 2 * words >= n END QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, k) = 1),
f AS (SELECT doc_id, path, k AS own_license, c AS cosine_milli, regexp_replace(path, '/[^/]*$', '') AS dir FROM d LEFT JOIN best USING (doc_id)),
given AS (SELECT dir AS up, own_license AS k FROM f WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine_milli DESC, own_license) = 1),
near AS (SELECT x.dir, given.up, given.k, len(string_split(given.up, '/')) AS depth FROM (SELECT DISTINCT dir FROM f) x JOIN given ON x.dir = given.up OR starts_with(x.dir, given.up || '/')
  QUALIFY row_number() OVER (PARTITION BY x.dir ORDER BY len(given.up) DESC) = 1)
SELECT doc_id, path, own_license, cosine_milli, coalesce(own_license, k) AS license, CASE WHEN own_license IS NULL THEN up END AS license_from,
  CAST(CASE WHEN own_license IS NULL THEN depth END AS INTEGER) AS depth FROM f LEFT JOIN near ON near.dir = f.dir"""


OP10_SQL = _sql()
