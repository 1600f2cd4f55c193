"""Cases in which an operator once did less than the whole job."""
import collections
import random

import numpy as np
import pandas as pd
import pytest

from keyforge.llm import html_text, licences, quality_rules, shards, vector_search


# ---- 1 ----

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, ARE DISCLAIMED.
"""
APACHE = """# Copyright 2020 The Authors
# Licensed under the Apache License, Version 2.0 (the "License"); you may not
# use this file except in compliance with the License. You may obtain a copy
# of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL = """/*
 * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
"""


def test_wrapped_licences(spark):
    rows = {
        "MIT": MIT, "MIT ": MIT.replace("\n", "\r\n"), "BSD-3-Clause": BSD, "BSD-2-Clause": BSD[:BSD.index("3. ")], "Apache-2.0": APACHE,
        "GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2), "MIT  ": "The MIT License\n" + MIT[MIT.index("Perm"):],
        "MIT OR Apache-2.0": "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main()", "GPL-2.0-only WITH Linux-syscall-note": "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */",
        "proprietary": "Kept. all rights\n * reserved"}
    docs = spark.createDataFrame(list(enumerate(rows.values())), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licences.document_licences(docs).collect()}
    for i, name in enumerate(rows):
        assert (got[i]["licences"], got[i]["n_matches"]) == (name.strip(), 1) and got[i]["n_unknown"] <= 1, got[i]
    assert "Apache2Ref;Apache2NotUse;Apache2Copy;Address;Apache2AsIs;Apache2See" in got[4]["sentence_ids"]


# ---- 2 ----

@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>t</title><meta charset=x><body><article><p>a</p></article></body></html>", "a"),
    ("<head><title>t</title><article><p>a</p></article>", "a"),
    ("<head><title>t</title>words<p>more", "words\nmore"),
    ("<body><div class='site has-sidebar'><article><p>a</p></article></div></body>", "a"),
    ("<div id='toolbar-page'><article><p>a</p></article></div>", "a"),
    ("<div class=sidebar><main><p>a</p></main></div>", "a"),
    ("<div class=widget><article><p>the article</p></article></div><p>end</p>", "the article"),
    ("<article class='post comments-open'><p>a</p><div class='comment-list'><p>no</p></div></article>", "a"),
    ("<form action=x><nav>n</nav><article><p>a</p><form><p>no</form></article></form>", "a"),
    # What is furniture stays so.
    ("<article><p>a</p><div class='cookie-banner'>no</div></article><div class=related><article><p>card</p></article></div>", "a"),
    ("<div><p>" + "text " * 40 + "</p></div><div class=sidebar><article><p>card</p></article></div>", ("text " * 40).strip()),
    ("<aside><article><p>card</p></article></aside><main><p>a</p><article class=comment><p>no</p></article></main>", "a"),
])
def test_wrapped_articles(page, text):
    assert html_text.main_text(page) == text


# ---- 7 ----

def test_single_defects_on_a_mostly_clean_table(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    lines = lambda: [" ".join(prose(8)) for _ in range(10)]
    made = {
        "clean": lambda: "\n".join(lines()),
        "adjacent": lambda: " ".join(x for w in prose(80) for x in ([w, w] if rng.random() < 0.4 else [w])),
        "lines": lambda: "\n".join(lines() + ["ab cd"] * 6),
        "repeats": lambda: " ".join(prose(54) + 3 * prose_once(15)),
        "word_length": lambda: " ".join("".join(prose(4)) for _ in range(80)),
        "symbols": lambda: " ".join(w + "#" for w in prose(80)),
    }
    prose_once = lambda n: rng.sample(words, n)
    rows = [(kind, text()) for kind, text in made.items() for _ in range(900 if kind == "clean" else 30)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, kind string, text string")
    got = quality_rules.document_quality(df).join(df, "doc_id").collect()
    kept, n = collections.Counter(r["kind"] for r in got if r["kept"]), collections.Counter(r["kind"] for r in got)
    assert kept["clean"] == n["clean"] and not any(r["base_failed"] for r in got)
    assert all(kept[kind] <= 0.1 * n[kind] for kind in made if kind != "clean"), kept


# ---- 8 ----

@pytest.mark.parametrize(("groups", "noise"), [(40, 0.02), (40, 0.001), (8, 0.001)])
def test_neighbours_in_groups_of_near_copies(spark, groups, noise):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = (centres[rng.integers(0, groups, 8000)] + noise * rng.normal(size=(8000, 64))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(8000), "embedding": list(x)}), "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(set)
    for r in vector_search.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    shares = []
    for q in range(0, 8000, 50):
        s = vector_search.cosines(x, x[q])
        s[q] = -2
        shares.append(len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert np.mean(shares) >= 0.99 and min(shares) > 0


def test_equal_scores_go_by_id(spark):
    """The unit vectors are equally near to the vector of ones, whatever their place in the graph."""
    rows = [(0, [1.0] * 120)] + [(1 + i, [float(i == j) for j in range(120)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_search.nearest(df, every=500).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


# ---- 9 ----

def test_buckets_by_bytes_and_whole_records_written(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * 10_000, "en") for i in range(100)], "doc_id bigint, text string, lang string")
    assert shards.n_buckets(docs, 20_000, 50_000, 4) in range(20, 23) and shards.n_buckets(docs, 10, 1 << 30, 4) == 10
    assert shards.n_buckets(docs.where("false"), 10, 10, 4) == 4
    seen = []
    write = shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda records, path, *a, **kw: (write(records, path, *a, **kw), seen.append(path)))
    got = shards.document_shards(docs, least_buckets=4, bucket_bytes=50_000).collect()
    held = spark.read.parquet(seen[0])
    assert held.select("rec.*").columns == docs.columns and held.select("rec.*").exceptAll(docs).count() == 0 and len(got) == held.count() == 100
    assert {(r["doc_id"], r["size"]) for r in got} == {(i, len(f"{i} ") + 10_001) for i in range(100)}
