"""HTML, Jaccard join, licences, packing, top-k, mixing and the pipeline, against brute force."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeaudit.llm import html_cut, jaccard_join, license_scan, max_score, mixing, packing
from lakeaudit.llm.components import components
from lakeaudit.llm.secret_links import numbered
from lakeaudit.llm.spark import named

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cost(odds, edges, labels):
    return sum(max(0, z) if not x else max(0, -z) for z, x in zip(odds, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_minimum_cut_is_least():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 8)
        odds, edges = [r.gauss(0, 1) for _ in range(n)], [(i, j, r.random() * 1.5) for i in range(n) for j in range(i) if r.random() < 0.5]
        least = min(cost(odds, edges, [bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(odds, edges, html_cut.min_cut(odds, edges)) == pytest.approx(least)
    n = 30_000
    odds = [r.gauss(0.2, 1) for _ in range(n)]
    assert len(html_cut.min_cut(odds, [(i, i + 1, 0.6) for i in range(n - 1)])) == n


def test_main_text(spark):
    body = "A first long paragraph of plain text. It has two sentences, and words."
    pages = [
        f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; line</h1><p>{body}<p>Short&nbsp;<b>one</b><br>more</article><section id=comments><p>Great article, I liked it. Thanks a lot.</p></section><footer>c</footer></body></html>",
        f"<div><p>{body}</p><p>Tiny.</p><p>{body}</p></div><form><label>Name</label><input><button>Send</button></form><!-- <p>x</p> -->", "", None, "<nav><a>Only</a><a>links</a></nav>", "plain <unclosed",
    ]
    df = spark.createDataFrame([(i, None if i == 1 else "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("text", "n_chars", "n_moved")})
    got = {r.page_id: r for r in html_cut.extract(df, ["page_id", "url"]).collect()}
    assert got[0].text == f"Head & line {body} Short one more" and got[1].text == f"{body} Tiny. {body}"
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[0].n_chars == len(got[0].text) and len(got) == 6
    assert html_cut.extract(df.limit(0), ["page_id"]).count() == 0


PROSE = "A first long paragraph of plain text. It has two sentences, and words enough."
MORE = "Another paragraph follows the first, with some more to say. It ends here."
ARTICLE = f"<h1>My title here</h1><p>{PROSE}</p><p>Tiny.</p><p>{MORE}</p><p><a href=z>A link alone</a></p><p>{PROSE}</p>"
WANT = f"My title here {PROSE} Tiny. {MORE} A link alone {PROSE}"
MENU = "<ul class=menu><li><a href=x>Home</a><li><a href=y>News</a><li>About</ul>"
COMMENTS = "".join(f"<div class=x{i}><b>Bob</b><p>Great article, I liked it. Thanks a lot.</p></div>" for i in range(4))


@pytest.mark.parametrize(
    "page",
    [
        f"{MENU}<div class=zz>{ARTICLE}</div><div class=discussion>{COMMENTS}</div>",
        f"<div class=q1>{MENU}</div><div class=q2>{ARTICLE}</div><div class=q3><h3>Comments</h3>{COMMENTS}</div><div class=q4>Copyright 2024 Foo. All rights reserved.</div>",
        f"{MENU}<div class=share-story>{ARTICLE}</div><div class=share><a>FB</a> <a>TW</a></div>",
        f"<article><div class=post-header><h1>My title here</h1></div>{ARTICLE.split('</h1>')[1]}<aside><p>{MORE}</p></aside><div class=comments>{COMMENTS}</div></article><footer>x. y.</footer>",
        f"<header><h1>Site</h1>{MENU}</header><div id=page class='wrap has-sidebar'>{ARTICLE}</div><div class=sidebar><h3>Popular</h3><p>{MORE}</p></div>",
        f"<main><article>{ARTICLE}</article><section class=related><h2>Related</h2><ul><li><a>{MORE}</a></ul></section></main><div id=cookie-notice>We use cookies here. Do you mind? <button>OK</button></div>",
        f"<div class=comments-enabled><noscript>Turn it on. It is good.</noscript>{ARTICLE}</div><form>Mail <input></form>",
    ],
)
def test_main_text_of_varied_pages(page):
    assert html_cut.main_text(page)[0] == WANT


LONG = f"{PROSE} {MORE}"


@pytest.mark.parametrize(
    "inside, kept",
    [
        (f"<section class=discussion><h2>Discussion</h2><p>{LONG}</p><p>{PROSE}</p></section>", f"Discussion {LONG} {PROSE}"), (f"<div class=thread-content><p>{LONG}</p><p>{PROSE}</p></div>", f"{LONG} {PROSE}"), (f"<p class=wp-ad-free>{LONG}</p>", LONG), (f"<p class='sponsored reply'>{LONG}</p><p>{PROSE}</p>", f"{LONG} {PROSE}"),
        (f"<div class=zq>{COMMENTS}</div>", ""), (f"<div class=discussion>{COMMENTS}</div>", ""), ("<div class=ad-slot><a href=x>Buy it now</a> <a href=y>Or later</a></div>", ""), ("<div class=thread><p>Ann</p><p>I liked it. Thanks a lot for it.</p><p>Bob</p><p>I did not like it. Sorry about that.</p></div>", ""),
    ],
)
def test_names_count_where_the_text_agrees(inside, kept):
    page = f"{MENU}<article><h1>My title here</h1><p>{PROSE}</p><p>{MORE}</p>{inside}</article>"
    assert html_cut.main_text(page)[0] == f"My title here {PROSE} {MORE} {kept}".strip()


def test_nested_articles_are_linear():
    text, n, _ = html_cut.main_text("<article><p>Some words here.</p>" * 30_000)
    assert n == 30_000


def test_smoothness_decides():
    page = f"{MENU}<div class=zz>{ARTICLE}</div>"
    nodes, found = html_cut.blocks(page)
    odds = html_cut.log_odds(nodes, found)
    alone = " ".join(b.text for b, z in zip(found, odds, strict=True) if z > 0)
    assert alone != WANT and "A link alone" not in alone and html_cut.main_text(page)[0] == WANT and html_cut.main_text(page)[2] > 0


def test_bad_markup_takes_linear_time():
    import time

    n = 100_000
    pages = ['<a "' * n, '<a x="' * n, "<div>" * n + "</x>" * n + "</div>" * n, "<!--" * n, "<script>" * n, "</p" * n, "<li>" * n, "<a" + " " * n, "<" * n, "&amp" * n, f"<p>{PROSE}" * 2000]
    began = time.perf_counter()
    for page in pages:
        html_cut.main_text(page)
    assert time.perf_counter() - began < 60
    assert html_cut.main_text("a < b and <unclosed")[0] in ("", "a < b and")
    long = "A sentence of it. " * 50_000
    assert html_cut.main_text(f"<p>{long}</p>")[0] == long.strip()


@needs_tables
def test_main_text_is_the_article_of_the_tables():
    import html

    import pyarrow.parquet as pq

    for page in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        inner = re.search("<article>(.*?)</article>", page["html"], re.S)[1]
        assert html_cut.main_text(page["html"])[0] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


def plain_components(texts, size=3, percent=90):
    sets, root = [shingles(t, size) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


def near_copies(r, groups, each, words, edits):
    out = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 4000)}" for _ in range(words)]
        for _ in range(each):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(words)] = f"e{r.randint(0, 10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("longest", [3, 64])
def test_jaccard_join(spark, longest):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n", "a", "A", "a b", "x y z", "X y Z"] + near_copies(r, 6, 7, 120, 4) + near_copies(r, 1, 60, 90, 6) + [passage + " " + " ".join(f"q{r.randint(0, 999)}" for _ in range(n)) for n in (1, 2, 3, 5, 200, 201)] + ["same text again and again here"] * 9
    sizes, want = plain_components(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {x.id: x for x in jaccard_join.jaccard_join(numbered(docs), longest=longest).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes and [got[i].component_id for i in range(len(texts))] == want
    kept = {x.doc_id for x in jaccard_join.keep_one(docs, longest=longest).collect()}
    assert kept == {i for i, c in enumerate(want) if i == c}


def test_jaccard_join_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "z z z z y"), (None, None)], "doc_id long, text string")
    got = sorted((x.id is None, x.n_shingles, x.component_id) for x in jaccard_join.jaccard_join(numbered(docs)).collect() if x.n_shingles == 2 and x.component_id)
    assert got == [(False, 2, 7), (False, 2, 7), (True, 2, 7)]
    assert jaccard_join.keep_one(docs).count() == 3 and jaccard_join.jaccard_join(numbered(docs.limit(0))).count() == 0


def test_parity_never_rules_out_a_link():
    r = np.random.default_rng(1)
    for n in (10, 70, 500, 1100):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for lost in range(0, n // 10, max(1, n // 40)):
            b = np.unique(np.concatenate([a[lost:], r.integers(0, 2**63, lost // 2).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            link = 100 * inter >= 90 * (len(a) + len(b) - inter)
            assert jaccard_join.probe(a, b, 90) == link
            assert not link or jaccard_join.may_link(jaccard_join.parity(a), len(a), jaccard_join.parity(b), len(b), 90)


def test_block_links_are_whole():
    r = np.random.default_rng(3)
    for _ in range(30):
        base = np.unique(r.integers(0, 400, 60))
        sets = [np.unique(np.append(r.permutation(base)[: len(base) - r.integers(0, 9)], r.integers(400, 900, r.integers(0, 5)))) for _ in range(40)] + [np.unique(r.integers(0, 900, 30)) for _ in range(10)]
        asks = r.random(len(sets)) < 0.6
        found = jaccard_join.block_links(asks, np.array([len(s) for s in sets]), np.concatenate(sets), 90)
        links = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and asks[i] and 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - both)]
        assert set(found) <= set(links) and len(found) < len(sets)
        joined = lambda pairs: sorted(map(sorted, _groups(len(sets), pairs)))
        assert joined(found) == joined(links)


def _groups(n, pairs):
    group = {i: {i} for i in range(n)}
    for i, j in pairs:
        if group[i] is not group[j]:
            both = group[i] | group[j]
            for k in both:
                group[k] = both
    return {id(g): g for g in group.values()}.values()


def test_large_group_of_short_near_copies(spark):
    r, words = np.random.default_rng(4), [f"w{i}" for i in range(12)]
    places = r.integers(0, 13, 20_000)
    texts = [" ".join([*words[:k], f"x{i}", *words[k:]]) for i, k in enumerate(places.tolist())]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = jaccard_join.jaccard_join(numbered(docs), percent=80).select("id", "component_id").toPandas().sort_values("id")
    ends = np.isin(places, (0, 12))  # only a word put in at an end leaves 10 of 12 shingles
    assert (got["component_id"].to_numpy() == np.where(ends, np.flatnonzero(ends)[0], np.arange(len(texts)))).all()


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}


def test_licenses_inherit(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "nothing here"), (3, "a/b/c/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (4, "a/b/c/y.py", None), (5, "z/q.py", "# Licensed under the Apache License, Version 2.0."), (6, "top.py", ""), (7, None, "x"), (8, "a/b/x.py", "nothing here"),
    ]
    got = {r.doc_id: (r.license, r.licensed_by) for r in license_scan.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "a"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", "a/b/c"), 5: ("Apache-2.0", None), 6: (None, None), 7: (None, None), 8: ("MIT", "a")}


MIT_TEXT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD_2_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD_3_TEXT = BSD_2_TEXT + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
LGPL_HEADER = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""


def test_licenses_of_real_notices(spark):
    files = [
        (1, "m/LICENSE.md", MIT_TEXT), (2, "m/src/a.py", "x = 1"), (3, "b/LICENSE-BSD.txt", BSD_2_TEXT), (4, "c/COPYING.LESSER", BSD_3_TEXT), (5, "d/a.c", LGPL_HEADER), (6, "e/a.go", "// SPDX-License-Identifier: MIT OR Apache-2.0\n// Licensed under the GNU General Public License, version 3.\n"),
        (7, "f/Licence", "// Copyright 2024 Foo Project Authors, All rights reserved\n// Licensed under the Apache License, Version 2.0\n"), (8, "f/unlicensed.txt", "some words"), (9, "g/LICENSED", "Released under the MIT License."), (10, "g/x", "y"), (11, "h/a.txt", "word " * 200_000 + ". Released under the MIT License. " + "word " * 200_000),
    ]
    want = {1: ("MIT", None), 2: ("MIT", "m"), 3: ("BSD-2-Clause", None), 4: ("BSD-3-Clause", None), 5: ("LGPL-2.1", None), 6: ("MIT OR Apache-2.0", None), 7: ("Apache-2.0", None), 8: ("Apache-2.0", "f"), 9: ("MIT", None), 10: (None, None), 11: ("MIT", None)}
    docs = spark.createDataFrame(files, "doc_id long, path string, text string").withColumns({c: F.lit(c) for c in ("rid", "id", "name", "dir", "license", "term", "cosine")})
    more = spark.range(20_000).selectExpr("id + 1000 AS doc_id", "concat('z/', id) AS path", "concat('plain words of no licence, project ', id, ' rights and all') AS text")
    for df in (docs, docs.select("doc_id", "path", "text").unionByName(more)):
        out = license_scan.license_scan(df).where("doc_id < 1000")
        assert {r.doc_id: (r.license, r.licensed_by) for r in out.collect()} == want
    assert license_scan.license_scan(docs.limit(0)).count() == 0


WHOLE = "/usr/share/common-licenses"
#: The name that each text may be given; no other.
WHOLE_NAMES = {
    "Apache-2.0": "Apache-2.0", "Artistic": None, "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@needs_tables
@pytest.mark.skipif(not os.path.isdir(WHOLE), reason="no licence texts")
def test_whole_licences_have_their_own_name_or_none(spark):
    names = [n for n in WHOLE_NAMES if os.path.isfile(f"{WHOLE}/{n}")]
    files = [(i, f"x{i}/COPYING", open(f"{WHOLE}/{n}", encoding="utf-8", errors="replace").read()) for i, n in enumerate(names)]
    more = license_scan.document_paths(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("doc_id", F.col("doc_id") + 1000)
    got = {r.doc_id: r.own_license for r in license_scan.license_scan(spark.createDataFrame(files, more.schema).unionByName(more)).where("doc_id < 1000").collect()}
    wrong = {n: got[i] for i, n in enumerate(names) if got[i] not in (None, WHOLE_NAMES[n])}
    assert not wrong
    assert sum(v is not None for v in got.values()) >= 6


def test_spdx_tags(spark):
    texts = {
        "SPDX-License-Identifier: (GPL-2.0 OR MIT)": "GPL-2.0 OR MIT", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */": "GPL-2.0-only WITH Classpath-exception-2.0",
        "SPDX-License-Identifier: MIT\nx\nSPDX-License-Identifier: Apache-2.0\nSPDX-License-Identifier: MIT": "Apache-2.0 AND MIT", "SPDX-License-Identifier: (MIT OR Zlib)\nSPDX-License-Identifier: ISC": "ISC AND (MIT OR Zlib)",
        "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR (Apache-2.0 AND ISC)": "(MIT AND BSD-3-Clause) OR (Apache-2.0 AND ISC)", "SPDX-License-Identifier:": None, "// SPDX-License-Identifier: (MIT": "(MIT",
    }
    got = license_scan.license_scan(spark.createDataFrame([(i, f"d{i}/a", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.own_license for r in got} == dict(enumerate(texts.values()))


@needs_tables
def test_licenses_equal_their_sql(spark):
    import duckdb

    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = sql.execute(license_scan.OP5_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(str([dict(zip(names, x))[c] for c in sorted(names)]) for x in cur.fetchall())
    df = license_scan.op5_license_scan(spark, SF)
    assert sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect()) == want


def test_first_fit_decreasing_is_first_fit():
    r = np.random.default_rng(0)
    size = r.integers(1, 101, 300)
    bins, offset = packing.first_fit_decreasing(size, 100)
    used, want = [], {}
    for i in np.argsort(-size, kind="stable"):
        k = next((k for k, u in enumerate(used) if u + size[i] <= 100), len(used))
        used += [0] * (k == len(used))
        want[i] = (k, used[k])
        used[k] += size[i]
    assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offset, strict=True))} == want


def test_places_do_not_hang_on_order():
    r = np.random.default_rng(5)
    group = pd.DataFrame({"row": r.permutation(400) // 2, "start": np.tile([0, 64], 200), "length": r.integers(1, 9, 400), "group": 3}).drop_duplicates(["row", "start"])
    want = packing.place(group, 64).sort_values(["row", "start"]).to_numpy().tolist()
    for seed in range(5):
        assert packing.place(group.sample(frac=1, random_state=seed), 64).sort_values(["row", "start"]).to_numpy().tolist() == want


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", None, "Hello, world! don't…", "<|endoftext|> A<|ENDOFTEXT|>", "é́ ΑΣ. x" * 3, "many words, here. " * 4000, "naïve,café;ok", "a b c", "same", "same", "😀,!? 12,345.6"]
    docs = spark.createDataFrame([(i % 9, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = packing.pack(docs, with_ids=True, length=512).collect()
    found = defaultdict(list)
    for x in got:
        found[x.doc_id].append((x.start, x.ids))
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length
    want = defaultdict(list)
    for i, x in enumerate(texts):
        want[i % 9] += t.encode(x or "", add_special_tokens=False).ids + [packing.END]
    assert all(sorted(sum((ids for _, ids in found[i]), [])) == sorted(want[i]) for i in range(9))
    assert sum((ids for _, ids in sorted(found[5])), []) == want[5]
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert packing.pack(docs.limit(0)).count() == 0


def test_ids_of_whole_batches():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, path, r = Tokenizer.from_file(packing.tokenizer_path()), packing.tokenizer_path(), random.Random(11)
    cases = [["one two", ".net core", "A full stop. Here."], ["Plain sentence. Two."], ["End. Fine.", "ab", ".net core"], ["é", ".x", "a.", ",", "", "!", None, "b?c"]]
    for _ in range(400):
        cases.append(["".join(r.choice([".", ",", ";", ":", "!", "?", " ", "\n", "a", "B", "é", "×", "1", "'s", "-", "ü.", "ß", "word"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 60))])
    for texts in cases:
        ids, bounds = packing.token_ids(pa.array(texts, pa.string()), path)
        want = [e.ids + [packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


@pytest.mark.parametrize("scale", [1.0, 2e4, 2e5])
def test_max_score(spark, scale):
    r = random.Random(6)
    vecs = [(i, [r.gauss(0, 1) * scale for _ in range(12)]) for i in range(300)] + [(300 + i, [0.25] * 12) for i in range(40)]
    vecs += [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0] * 5), (950, []), (None, [9.0] * 12), (7, vecs[7][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("row", F.lit(1))
    got = defaultdict(list)
    for x in max_score.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=64, block_rows=3).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vecs if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for i, v in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)[:10]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert set(got) == {i for i, _ in ok if i % 50 == 0} and 950 in got
    assert max_score.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_are_not_clamped(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2e6]), (2, [1e6]), (3, [3e11]), (4, [-3e11])], "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in max_score.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(3, 2**20 * 3 * 10**11), (1, 2**20 * 2 * 10**6), (2, 2**20 * 10**6), (4, -(2**20) * 3 * 10**11)]
    with pytest.raises(Exception, match="64 bits"):
        max_score.top_k(df, F.col("vec_id") == 3).collect()


def test_mix_meets_targets(spark):
    r = random.Random(3)
    data = [(i, "w " * r.randint(0, 80), "en", r.choice(["a", "b", "c", None] + ["hot"] * 4), 0) for i in range(500)] + [(None, None, "en", "a", 0), (3, "x y", "en", "b", 0)]
    docs = spark.createDataFrame(data, DOCS)
    taken, plan = mixing.mix(docs)
    rows = taken.collect()
    sizes, got, targets = defaultdict(int), defaultdict(int), {}
    for x in rows:
        sizes[x.source] += x["size"]
        got[x.source] += x.taken
        targets[x.source] = x.target
        assert x.taken <= 2 * x["size"] and x.source_size
    names = sorted(s for s in sizes if s) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    assert len(rows) == len(data) and all(targets[s] == pytest.approx(want[s]) for s in names)
    assert all(abs(got[s] - want[s]) <= 0.01 * want[s] + 8 for s in names)
    assert plan.groupBy("slot").count().where("count > 1").count() == 0
    again = sorted((x.doc_id or -1, x["size"], x.taken) for x in mixing.mix(docs.repartition(3))[0].collect())
    assert again == sorted((x.doc_id or -1, x["size"], x.taken) for x in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(WORD.findall(x.text)) for x in mixed.collect()) == sum(got.values())
    assert mixing.mix(docs.limit(0))[0].count() == 0


def test_mix_meets_small_targets(spark):
    data = [(i, "w " * 1000, "en", "a", 0) for i in range(300)] + [(1000 + i, "w " * 10, "en", "b", 0) for i in range(100)] + [(2000 + i, "w " * 999, "en", "c", 0) for i in range(40)] + [(3000, "", "en", "d", 0)]
    docs = spark.createDataFrame(data, DOCS)
    taken, plan = mixing.mix(docs, slots_per_source=1)
    got = {x.source: x for x in taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert plan.agg(F.max("words")).first()[0] == 4096 and got["b"].target == 2000
    assert {s: x.taken for s, x in got.items()} == {s: round(x.target) for s, x in got.items()}
    assert plan.groupBy("slot").count().where("count > 1").count() == 0 and plan.agg(F.sum("words")).first()[0] == sum(x.taken for x in got.values())


def test_mix_of_one_huge_and_many_tiny_sources(spark):
    data = [(i, "w " * 40, "en", "big", 0) for i in range(3000)] + [(9000 + i, "w " * 20, "en", f"tiny{i}", 0) for i in range(5)] + [(9100, "w", "en", None, 0)]
    docs = spark.createDataFrame(data, DOCS)
    taken, plan = mixing.mix(docs)
    rows = sorted((x.doc_id, x.source or "", x.target, x.taken) for x in taken.collect())
    got = defaultdict(int)
    for _, source, _, n in rows:
        got[source] += n
    assert {s: got[s] for s in got} == {s: round(t) for _, s, t, _ in rows} and all(got[f"tiny{i}"] == 40 for i in range(5)) and got[""] == 2
    # The same by windows over a few sources at a time.
    again, plan_again = mixing.mix(docs, per=2)
    assert sorted((x.doc_id, x.source or "", x.target, x.taken) for x in again.collect()) == rows
    assert plan_again.count() == plan.count()


def test_running_sums_by_ranges(spark):
    from lakeaudit.llm.spark import running

    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long")
    for per in (10, 1000):
        got = sorted(tuple(x) for x in running(df, [F.col("k").desc()], {"before": "v"}, 101, per).collect())
        rows, total = [], 0
        for at, (k, v) in enumerate(sorted(((i * 7 % 101, i) for i in range(101)), reverse=True)):
            rows.append((k, v, at, total))
            total += v
        assert got == sorted(rows)


@needs_tables
def test_pipeline_stages_of_empty_tables(spark):
    import corpus_pipeline
    from lakeaudit.llm.spark import table

    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline
    from lakeaudit.llm.spark import table

    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "near_copies":
            _, want = plain_components([r.text for r in docs.orderBy("doc_id").collect()], 5, 80)
            assert out.count() == len(set(want))
        if name == "secrets":
            assert out.count() == docs.count() and out.where(F.col("text").rlike('token = "[0-9a-f]{32}')).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_pipeline_near_copies_of_five_words(spark):
    import corpus_pipeline

    r = random.Random(12)
    texts = near_copies(r, 8, 3, 100, 2) + near_copies(r, 4, 3, 60, 3)
    for n in (8, 12, 15, 30):  # a paragraph appended to 100 words
        base = [f"a{r.randint(0, 9999)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base + [f"b{r.randint(0, 9999)}" for _ in range(n)])]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    near, strict, root = 0, [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                near += 10 * len(strict[i] & strict[j]) < 9 * len(strict[i] | strict[j])
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert near > 5
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, SF).collect()} == {i for i in range(len(texts)) if root[i] == i}


def test_clashing_columns(spark):
    from lakeaudit.llm import secret_links

    names = ("rid", "size", "words", "spans", "rank", "row", "start", "n", "id", "label", "short", "at")
    data = [(1, "a b c d e f g h i j", "s"), (2, "A b c d e f g h i j", "s"), (3, "token=abcdefgh1", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    for f in (jaccard_join.keep_one, secret_links.redact, mixing.mixed_documents):
        out = f(docs)
        assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in names)
    assert packing.pack(docs).count() == 3 and mixing.mix(docs)[0].count() == 3
    assert max_score.top_k(docs.withColumn("embedding", F.array(F.lit(1.0))), F.col("doc_id") == 1, id_col="doc_id").count() == 2


@pytest.fixture
def files(spark, tmp_path):
    """A table of many small files, which Spark packs into partitions by the number that minPartitionNum asks for."""
    r, rows = random.Random(8), []
    for i in range(400):
        words = [f"w{r.randrange(4000)}" for _ in range(30)]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join(words[:-1] + ["x"]), "en", "s1", 1))
    rows += [(2000 + i, "Licensed under the MIT license. " + f"q{i}", "en", "s1", 1) for i in range(9)]
    r.shuffle(rows)
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, DOCS).repartition(24).write.parquet(folder)
    yield folder
    spark.conf.unset("spark.sql.files.minPartitionNum")


def moved(spark, monkeypatch, module, run):
    """run() with its input cut otherwise into partitions after the first intermediate result."""
    own = module.cut

    def cut(df):
        out = own(df)
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        return out

    spark.conf.set("spark.sql.files.minPartitionNum", "3")
    want = sorted(map(str, run().collect()))
    with monkeypatch.context() as m:
        m.setattr(module, "cut", cut)
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        got = sorted(map(str, run().collect()))
    assert got == want and want


def test_row_names_survive_other_partitions(spark, monkeypatch, files):
    read = lambda: spark.read.parquet(files)
    spark.conf.set("spark.sql.files.minPartitionNum", "3")
    name = named(read())
    first = {r.rid: r.doc_id for r in name.select("rid", "doc_id").collect()}
    spark.conf.set("spark.sql.files.minPartitionNum", "20")
    assert first == {r.rid: r.doc_id for r in name.select("rid", "doc_id").where("doc_id >= 0").collect()} and len(first) == read().count()
    moved(spark, monkeypatch, jaccard_join, lambda: jaccard_join.jaccard_join(named(read())).drop("rid"))
    moved(spark, monkeypatch, jaccard_join, lambda: jaccard_join.keep_one(read(), size=5, percent=80))
    moved(spark, monkeypatch, mixing, lambda: mixing.mixed_documents(read()))
    moved(spark, monkeypatch, license_scan, lambda: license_scan.license_scan(license_scan.document_paths(read())))


def test_names_of_rows_that_are_no_files(spark, files):
    read = spark.read.parquet(files)
    assert "rid" in named(read.select("doc_id").where("doc_id > 5")).columns
    twice = read.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))  # a row of a file is two rows here
    for df in (twice, read.unionByName(read), read.groupBy("doc_id").count(), spark.range(9)):
        rows = named(df).select("rid").collect()
        assert len({r.rid for r in rows}) == len(rows) == df.count()
    one = read.coalesce(1)
    assert named(one).count() == one.count()


@pytest.mark.parametrize("percent, pairs", [(50, [(1, 2), (2, 3), (2, 4), (3, 3)]), (66, [(2, 3)])])
def test_small_sets_link_at_low_shares(spark, percent, pairs):
    """Sets whose required overlap is one or two shingles, as single words."""
    for m, n in pairs:
        need = jaccard_join.required(m, n, percent)
        a, b = [f"a{i}" for i in range(m - need)], [f"b{i}" for i in range(n - need)]
        both = [f"c{i}" for i in range(need)]
        docs = named(spark.createDataFrame([(1, " ".join(both + a)), (2, " ".join(both + b)), (3, "zz yy"), (4, "d e f g h")], "doc_id long, text string"))
        got = {r.id: r.component_id for r in jaccard_join.jaccard_join(docs, size=1, percent=percent).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4}
