"""Licence scan with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

A text is split into sentences and lines. Those that hold a licence cue, and what stands between two of them that are at
most ``gap`` pieces apart (a wrapped notice has lines without a cue), make a header; pieces that begin with a copyright
line name holders, not licences, and are left out of it. A header and a template are vectors of term frequency times
inverse document frequency; document frequencies of all terms are counted over all documents. The file's own licence is
the template with the highest cosine over its headers, if that is min_cosine or more. Licences share much of their wording,
so a header counts for a licence only if it also holds, word for word, one of the phrases that name it or grant it
(IDENTITY): older versions and neighbours are templates of their own, and a text near a licence that isn't here has none.
SPDX tags state the licence outright; of several different ones all hold (AND).

A file without one inherits from the nearest directory, its own or above, that holds a licence file (LICENSE, LICENCE,
COPYING, NOTICE or UNLICENSE, whatever the case, alone or before a dot or dash) with a licence of its own; of several such
files there the best cosine decides, then the smaller path, then the smaller id. Directories are joined, not files'
ancestors: a directory's ancestors are listed once.

Null text: no licence of its own. Null path: no directory, so nothing is inherited. Repeated rows are files each on their
own. Very long texts are split like others; nothing is cut off. Other columns, whatever their names, aren't read. Terms are runs of a-z and 0-9 after A-Z are lowered; other bytes
divide them. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.spark import cut, named, table

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_MIT = f"{_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_GNU = (
    ("GPL-2.0", "General Public License", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "General Public License", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "Lesser General Public License", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Affero General Public License", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-1.0", "General Public License", "1", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("LGPL-2.0", "Library General Public License", "2", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
)
_CC = (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"))
#: Notices as their licences ask for them or as projects commonly write them, and whole texts of short licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."), ("MIT", _GRANT), ("MIT", _MIT), ("MIT", f"MIT License {_MIT} {_AS_IS}"), ("MIT", "Licensed under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    *((name, f"This work is licensed under the GNU {title}, version {n}.") for name, title, n, _ in _GNU), *((name, f"Licensed under the GNU {title}, version {n}.") for name, title, n, _ in _GNU),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.") for name, title, n, _ in _GNU),
    *((name, f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details.") for name, title, n, _ in _GNU),
    *((name, f"{head} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.") for name, _, _, head in _GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"), ("MPL-1.1", "Mozilla Public License Version 1.1"),
    *((f"GFDL-{n}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {n} or any later version published by the Free Software Foundation") for n in ("1.1", "1.2", "1.3")),
    ("BSD-2-Clause", _BSD_2), ("BSD-2-Clause", f"{_BSD_2} {_BSD_AS_IS}"), ("BSD-3-Clause", _BSD), ("BSD-3-Clause", _BSD_3), ("BSD-3-Clause", f"{_BSD_3} {_BSD_AS_IS}"),
    ("ISC", _ISC), ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."), ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"), ("0BSD", f"{_ISC}. {_ISC_AS_IS}"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"), ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((name, f"Licensed under CC {name[3:-4]} 4.0.") for name, _ in _CC), *((name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.") for name, kind in _CC), ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
_GIVEN = "as published by the Free Software Foundation either version"
#: What a header of each licence must hold, one of them at least.
IDENTITY = {
    "MIT": ("MIT License", _GRANT), "Apache-2.0": ("Apache License Version 2.0",), **{name: (f"GNU {title} version {n}", f"GNU {title} {_GIVEN} {n}") for name, title, n, _ in _GNU},
    "MPL-2.0": ("Mozilla Public License v. 2.0", "Mozilla Public License Version 2.0"), "MPL-1.1": ("Mozilla Public License Version 1.1",), **{f"GFDL-{n}": (f"GNU Free Documentation License Version {n}",) for n in ("1.1", "1.2", "1.3")},
    "BSD-2-Clause": (_BSD,), "BSD-3-Clause": (_BSD,), "ISC": (_ISC,), "0BSD": (_ISC,), "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications",), "BSL-1.0": ("Boost Software License, Version 1.0",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "Eclipse Public License, Version 2.0"), **{name: (f"CC {name[3:-4]} 4.0", f"Creative Commons {kind} 4.0 International") for name, kind in _CC}, "CC0-1.0": ("CC0 1.0",), "Unlicense": ("free and unencumbered software released into the public domain",),
}
CUES = ("licen", "copyright", "redistribut", "public domain", "permission", "creative commons", "mozilla public", "warrant", "liable")
HOLDER = r"^[^a-z0-9]*(?:copyright|\(c\)|©) "
#: What a header of a licence must not hold, as a neighbour with one more clause does.
FOREIGN = {"BSD-2-Clause": "be used to endorse or promote products derived from this software", "ISC": "Redistribution and use in source and binary forms"}
GAP = 8
_ID = r"(?:\(\x20*)*[A-Za-z0-9.+:-]+(?:\x20*\))*"
SPDX = rf"SPDX-License-Identifier:\x20*({_ID}(?:\x20+(?:OR|AND|WITH)\x20+{_ID})*)"
LICENSE_FILE = r"^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
BREAK = r"\n|[.;!?]\x20"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _words(text: str) -> str:
    return f" {' '.join(_terms(text))} "


def _has_cue(col: Column) -> Column:
    out = F.lit(False)
    for cue in CUES:
        out |= F.contains(col, F.lit(cue))
    return out


def tags(text: Column) -> Column:
    """What the text's SPDX tags state together; null without a tag."""
    found = F.regexp_extract_all(text, F.lit(SPDX), 1)
    # A pair of brackets about the whole says nothing.
    found = F.array_sort(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"^\(([^()]*)\)$", "$1"))))
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, F.array_join(F.transform(found, lambda t: F.when(F.contains(t, F.lit(" OR ")), F.concat(F.lit("("), t, F.lit(")"))).otherwise(t)), " AND "))


def headers(low: Column, gap: int = GAP) -> Column:
    """The headers of a lowered text, each as its terms between single spaces, a space before and after."""
    step = lambda acc, x: F.when(
        _has_cue(x),
        F.struct(
            F.when(acc["apart"] < gap, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["text"]))).alias("done"),
            F.concat(F.when(acc["apart"] < gap, F.concat(acc["text"], acc["since"])).otherwise(F.lit("")), _held(x)).alias("text"),
            F.lit("").alias("since"), F.lit(0).alias("apart"),
        ),
    ).otherwise(F.struct(acc["done"].alias("done"), acc["text"].alias("text"), F.when(acc["apart"] < gap, F.concat(acc["since"], _held(x))).otherwise(F.lit("")).alias("since"), (acc["apart"] + 1).alias("apart")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit("").alias("since"), F.lit(gap).alias("apart"))
    found = F.aggregate(F.split(low, BREAK), start, step, lambda acc: F.concat(acc["done"], F.array(acc["text"])))
    return F.filter(F.transform(found, lambda t: F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(" "))), lambda t: t != "  ")


def _held(piece: Column) -> Column:
    """The piece as it stands in a header: without lines that name a holder."""
    return F.when(piece.rlike(HOLDER), F.lit(" ")).otherwise(F.concat(F.lit(" "), piece))


def document_frequency(low: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """term, idf for each of the terms (distinct), over the texts of all n_docs documents. Counts are summed in each task before they are shuffled."""
    held = low.select(F.explode(F.array_distinct(F.split("low", "[^a-z0-9]+"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(held, "term", "left").select("term", (F.log(F.lit(n_docs + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))


def own_licenses(docs: DataFrame, min_cosine: float, gap: int = GAP) -> DataFrame:
    """docs: rid, text. rid, license, cosine of the files that state one. Texts are read twice: for tags and headers, and for frequencies."""
    spark = docs.sparkSession
    low = docs.select("rid", "text", F.translate("text", _UPPER, _LOWER).alias("low"))
    rows = [(i, name, t, text.count(t)) for i, (name, terms) in enumerate((n, _terms(x)) for n, x in TEMPLATES) for t in sorted(set(terms)) for text in [terms]]
    templates = spark.createDataFrame(rows, "template int, license string, term string, tf int")
    # What follows reads only the files' tags and headers, which are few beside the texts. A tag holds a cue.
    stated = cut(low.where(_has_cue(F.col("low"))).select("rid", tags(F.col("text")).alias("tag"), headers(F.col("low"), gap).alias("headers")))
    tagged = stated.where("tag IS NOT NULL").select("rid", F.col("tag").alias("license"))
    texts = stated.where("tag IS NULL").select("rid", F.posexplode("headers").alias("header", "words"))
    holds = lambda phrase: F.contains(F.col("words"), F.lit(_words(phrase)))
    own = lambda name: reduce(or_, map(holds, IDENTITY[name])) & (~holds(FOREIGN[name]) if name in FOREIGN else F.lit(True))
    named = F.array_compact(F.array(*(F.when(own(name), F.lit(name)) for name in IDENTITY)))
    texts = cut(texts.select("rid", "header", "words", named.alias("named")).where(F.size("named") > 0))
    found = texts.select("rid", "header", "named", F.explode(F.split(F.trim("words"), " ")).alias("term")).groupBy("rid", "header", "named", "term").agg(F.count("*").alias("tf"))
    terms = found.select("term").unionByName(templates.select("term")).distinct()
    weights = cut(document_frequency(low, terms, docs.count()))
    templates = templates.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # The list of templates bounds these broadcasts.
    templates = templates.join(F.broadcast(norms), "template").select("term", "license", "template", (F.col("w") / F.col("norm")).alias("w"))
    found = cut(found.join(weights, "term").withColumn("weight", F.col("tf") * F.col("idf")).select("rid", "header", "named", "term", "weight"))
    lengths = found.groupBy("rid", "header").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = found.join(F.broadcast(templates), "term").where(F.array_contains("named", F.col("license"))).groupBy("rid", "header", "template", "license").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    scored = dots.join(lengths, ["rid", "header"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= min_cosine).select("rid", "license", "cosine")
    # A tag outweighs any cosine.
    scored = scored.withColumn("by", F.lit(1)).unionByName(tagged.withColumns({"cosine": F.lit(1.0), "by": F.lit(0)}))
    best = scored.groupBy("rid").agg(F.min(F.struct("by", (-F.col("cosine")).alias("minus"), "license")).alias("best"))
    return best.select("rid", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("cosine"))


def license_scan(files: DataFrame, id_col: str = "doc_id", min_cosine: float = 0.6) -> DataFrame:
    """files: id, path, text. id, path, own_license, cosine, license, licensed_by (the directory it is inherited from)."""
    numbered = named(files.select(F.col(id_col).alias("id"), "path", "text"))
    own = own_licenses(numbered.select("rid", "text"), min_cosine)
    cut_at = F.length("path") - F.length(F.substring_index("path", "/", -1))
    placed = numbered.select("rid", "id", "path", F.substring_index("path", "/", -1).alias("name"), F.when(cut_at > 0, F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise(F.when(F.col("path").isNotNull(), "")).alias("dir"))
    known = placed.join(own, "rid", "left")
    by_dir = known.where(F.lower("name").rlike(LICENSE_FILE) & F.col("own_license").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "path", "id", "own_license")).alias("best"))
    by_dir = by_dir.select(F.col("dir").alias("licensed_by"), F.col("best.own_license").alias("inherited"))
    depth = F.size(F.split("dir", "/"))
    above = F.concat(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/")), F.array(F.lit("")))
    dirs = placed.select("dir").where(F.col("dir").isNotNull()).distinct().select("dir", F.explode(F.array_distinct(above)).alias("licensed_by"))
    nearest = dirs.join(by_dir, "licensed_by").groupBy("dir").agg(F.max(F.struct(F.length("licensed_by").alias("n"), "licensed_by", "inherited")).alias("up"))
    out = known.join(nearest, "dir", "left")
    stated = F.col("own_license").isNotNull()
    return out.select(F.col("id").alias(id_col), "path", "own_license", "cosine", F.coalesce("own_license", "up.inherited").alias("license"), F.when(~stated, F.col("up.licensed_by")).alias("licensed_by"))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files: a directory per source and hundred of ids; every 50th id is its source's licence file, every 10th its hundred's."""
    source, i = F.coalesce("source", F.lit("_")), F.col("doc_id")
    name = F.when(i % 50 == 0, "LICENSE").when(i % 10 == 0, F.concat((i / 100).cast("long").cast("string"), F.lit("/LICENSE")))
    return docs.select("doc_id", F.concat_ws("/", source, F.coalesce(name, F.concat(F.expr("cast(doc_id div 100 as string)"), F.lit("/"), i.cast("string"), F.lit(".txt")), F.lit("_"))).alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(document_paths(table(spark, sf_dir, "documents")))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


_CUED = " OR ".join(f"contains({{0}}, '{c}')" for c in CUES)
_PIECES = "regexp_split_to_array(low, '\\n|[.;!?]\\x20')"
OP5_SQL = f"""
WITH tmpl(template, license, txt) AS (VALUES {_values([(i, n, " ".join(_terms(x))) for i, (n, x) in enumerate(TEMPLATES)])}),
files AS (
  SELECT doc_id, coalesce(source, '_') || '/' || CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' WHEN doc_id % 10 = 0 THEN (doc_id // 100) || '/LICENSE' ELSE (doc_id // 100) || '/' || doc_id || '.txt' END AS path,
    translate(text, '{_UPPER}', '{_LOWER}') AS low, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{SPDX}', 1), lambda t: regexp_replace(t, '^\\(([^()]*)\\)$', '\\1')))) AS tags FROM documents),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(string_split(txt, ' ')) AS term FROM tmpl) GROUP BY ALL),
pieces AS (SELECT *, {_CUED.format("piece")} AS cue FROM (SELECT doc_id, unnest({_PIECES}) AS piece, generate_subscripts({_PIECES}, 1) AS pos FROM files WHERE {_CUED.format("low")})),
edged AS (SELECT *, max(CASE WHEN cue THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior, max(CASE WHEN cue THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN cue THEN pos END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cued AS (SELECT doc_id, pos, piece, sum(CASE WHEN cue AND (before IS NULL OR pos - before > {GAP}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS header FROM edged WHERE cue OR nxt - prior <= {GAP}),
joined AS (SELECT doc_id, header, ' ' || trim(regexp_replace(string_agg(piece, ' ' ORDER BY pos), '[^a-z0-9]+', ' ', 'g')) || ' ' AS words FROM cued WHERE NOT regexp_matches(piece, '{HOLDER}') GROUP BY ALL),
foreign_to(license, phrase) AS (VALUES {_values([(name, _words(x)) for name, x in FOREIGN.items()])}),
named(license, phrase) AS (VALUES {_values([(name, _words(x)) for name, phrases in IDENTITY.items() for x in phrases])}),
holds AS (SELECT DISTINCT doc_id, header, license FROM joined JOIN named n ON contains(words, phrase) WHERE NOT EXISTS (FROM foreign_to f WHERE f.license = n.license AND contains(words, f.phrase)) AND doc_id IN (SELECT doc_id FROM files WHERE coalesce(len(tags), 0) = 0)),
ht AS (SELECT doc_id, header, term, count(*) AS tf FROM (SELECT doc_id, header, unnest(string_split(trim(words), ' ')) AS term FROM joined WHERE (doc_id, header) IN (SELECT (doc_id, header) FROM holds)) GROUP BY ALL),
voc AS (SELECT term FROM tt UNION SELECT term FROM ht),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(low, '[^a-z0-9]+'))) AS term FROM files) WHERE term IN (FROM voc) GROUP BY term),
n AS (SELECT count(*) AS n_docs FROM files),
idf AS (SELECT term, ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM voc LEFT JOIN df USING (term), n),
tw AS (SELECT term, license, template, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM tt JOIN idf USING (term)),
hw AS (SELECT doc_id, header, term, tf * idf AS weight FROM ht JOIN idf USING (term)),
norms AS (SELECT doc_id, header, sqrt(sum(weight * weight)) AS norm FROM hw GROUP BY ALL),
scored AS (SELECT doc_id, license, round(sum(weight * w) / any_value(norm), 6) AS cosine, 1 AS by_text FROM hw JOIN tw USING (term) JOIN norms USING (doc_id, header) JOIN holds USING (doc_id, header, license) GROUP BY doc_id, header, template, license HAVING round(sum(weight * w) / any_value(norm), 6) >= 0.6 UNION ALL SELECT doc_id, CASE len(tags) WHEN 1 THEN tags[1] ELSE array_to_string(list_transform(tags, lambda t: CASE WHEN contains(t, ' OR ') THEN '(' || t || ')' ELSE t END), ' AND ') END, 1.0, 0 FROM files WHERE len(tags) > 0),
own AS (SELECT doc_id, license AS own_license, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY by_text, cosine DESC, license) = 1),
known AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, own_license, cosine FROM files LEFT JOIN own USING (doc_id)),
by_dir AS (SELECT dir AS licensed_by, own_license AS inherited FROM known WHERE regexp_matches(lower(name), '{LICENSE_FILE}') AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, doc_id) = 1),
up AS (SELECT d.dir, licensed_by, inherited FROM (SELECT DISTINCT dir FROM known) d JOIN by_dir b ON d.dir = b.licensed_by OR starts_with(d.dir, b.licensed_by || '/') QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(licensed_by) DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, inherited) AS license, CASE WHEN own_license IS NULL THEN licensed_by END AS licensed_by FROM known LEFT JOIN up USING (dir)
"""
