"""Small fixtures with nulls, ties, repeated rows, empty tables and clashing
columns; brute-force versions of what SQL cannot express."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import (decontaminate, licenses, lm, mixing, neardup, quality, repeats, shards, tokencount,
                           toxicity)
from sparkprep.llm.queries import tokenizer

PROSE = " ".join(f"word{i % 97}x{i * 7 % 31}" for i in range(400))
ROWS = [
    (0, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, PROSE.replace("word5x4", "other"), "en", "b", 1),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "de", None, 3), (6, "one two", "de", "c", 7),
    (7, "Licensed under the MIT License.\nAll rights reserved.", "en", "a", 2),
    (None, "a text without an id, you stupid idiot!", "en", "a", 5), (8, "x" * 5000, "en", "a", 5),
    (9, PROSE[:900] + " tail " + "y z " * 300, "en", "c", 9), (9, PROSE[:900] + " tail " + "y z " * 300, "en", "c", 9),
    (10, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("n_words", "slot", "component_id", "score", "kept", "key", "band", "row", "text_hash", "_id", "size")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("other") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(11)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "The quick brown cat jumps over the lazy dog and runs far away from home"),
                                  (2, None), (3, "too short")], "item_id long, text string")


def run_all(d, labels, bench):
    piece = tokenizer("piece_bpe_32k.model")
    return {"op1": licenses.scan(d), "op2": mixing.mix(d), "op3": neardup.groups(d),
            "op4": tokencount.token_counts(d, piece), "op5": decontaminate.contaminated(d, bench),
            "op6": quality.judge(d), "op7": repeats.remove_repeats(d), "op8": lm.scored(d),
            "op9": toxicity.scored(d, labels), "op10": shards.materialise(d, piece, length=16, per_shard=8)}


def test_empty_tables(empty, labels, bench):
    for name, d in run_all(empty, labels.limit(0), bench.limit(0)).items():
        assert d.count() == 0, name


def test_odd_rows_and_clashing_columns(docs, clashing, labels, bench):
    plain, odd = run_all(docs, labels, bench), run_all(clashing, labels, bench)
    for name in plain:
        a, b = plain[name], odd[name]
        assert a.columns == b.columns, name
        if name not in ("op5", "op10"):
            assert a.count() == len(ROWS), name
        if name != "op10":      # the order of sequences follows the input's tasks
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_pipeline_stages_keep_columns(clashing, labels, bench):
    for d in (toxicity.clean(clashing, labels), neardup.one_of_each(clashing), decontaminate.clean(clashing, bench),
              mixing.mixed_rows(clashing)):
        assert d.columns == clashing.columns
        assert d.count() > 0


def test_license_cues_cover_sentences_and_rules_name_known_ids():
    import re
    known = {i for i, _ in licenses.SENTENCES}
    for _, s in licenses.SENTENCES:
        assert re.search("|".join(licenses.CUES), s), s
        assert s == re.sub("[^a-z0-9]+", " ", s).strip()
    for _, p in licenses.RULES:
        assert set(re.findall("<([^>]+)>", p)) <= known


def test_license_wrapped_sentence_and_rule_order(spark):
    grant, notice = (s for i, s in licenses.SENTENCES if i in ("MITgrant", "MITnotice"))
    wrapped = grant.replace(" to ", "\n# to ") + ":\n\n" + notice.upper() + ".\nNo end here\nAll rights reserved"
    r = licenses.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).first()
    # "All rights reserved" beside an open licence names no licence of its own
    assert r.sentence_ids == "MITgrant,MITnotice,ALLRIGHTS" and r.licenses == "MIT" and r.unmatched == ""


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.
"""
ENDORSE = """4. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def gnu(what, name, end, version):
    return f"""    This {what} is free software{':' if version == 3 else ';'} you can redistribute it and/or modify
    it under the terms of the GNU {name} as published by
    the Free Software Foundation{end} either version {version} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {name} for more details.

    You should have received a copy of the GNU {name}
    along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""


HEADERS = [
    ("BSD-4-Clause", BSD_2 + ADVERT + ENDORSE), ("BSD-3-Clause", BSD_2 + ENDORSE), ("BSD-2-Clause", BSD_2),
    ("MIT", MIT_GRANT + AS_IS),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""),
    ("LGPL-2.1-or-later", gnu("library", "Lesser General Public License", ";", 2.1)),
    ("LGPL-2.1-or-later", gnu("library", "Lesser General Public License", ",", 2.1)),
    ("GPL-3.0-or-later", gnu("program", "General Public License", ",", 3)),
    ("GPL-3.0-or-later", gnu("program", "General Public License", ";", 3)),
    ("GPL-2.0-or-later", gnu("program", "General Public License", ";", 2)),
    ("GPL-2.0-or-later", gnu("program", "General Public License", ",", 2)),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Proprietary", "Copyright 2020 Example. All rights reserved.\n"),
]


def test_license_rules_on_published_headers(spark):
    assert {name for name, _ in HEADERS} == {name for name, _ in licenses.RULES}
    # the same in a comment block; sentences that span lines begin after an end or an empty line
    texts = [(name, t) for name, t in HEADERS] + [(name, "# " + t.replace("\n", "\n# ").replace("# \n", "\n")) for name, t in HEADERS]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert [(texts[r.doc_id][0], r.unmatched) for r in got] == [(r.licenses, "") for r in got]


def test_rights_line_of_a_published_header_is_no_licence(spark):
    texts = ["Copyright (c) 2019, The Authors\nAll rights reserved.\n\n" + t for name, t in HEADERS if name != "Proprietary"]
    texts += [t + "\nAll rights reserved.\n" for name, t in HEADERS if name != "Proprietary"]
    names = [name for name, _ in HEADERS if name != "Proprietary"] * 2
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(names[r.doc_id], r.unmatched) for r in got] == [(r.licenses, "") for r in got]


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d)
    for r in out.groupBy("source").agg(F.first("source_size").alias("z"), F.first("target").alias("t"),
                                       F.sum("taken").alias("k")).collect():
        assert r.t <= 2 * r.z + 1e-6 and abs(r.k - r.t) <= 50
    assert out.filter("taken > 2 * size").count() == 0
    total = out.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("z")).agg(
        F.sum("t"), F.sum("z")).first()
    assert math.isclose(total[0], 1.5 * total[1], rel_tol=1e-9)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(d.repartition(5)).collect()))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 85 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    import random
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"t{rng.randrange(4000)}" for _ in range(rng.choice([6, 40, 150]))]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
            rows.append((g * 100 + k, " ".join(w)))
    rows.append((5000, rows[3][1]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_pipeline_links_pairs_of_80_percent(spark):
    import corpus_pipeline
    assert (neardup.agree(85), neardup.agree(80)) == (85, 77)
    rows = []
    for g in range(20):         # 100 shingles each, of which the copy lacks 9 or 10 and has as many others
        base = [f"g{g}w{k}" for k in range(104)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:94 + g % 2] + [f"n{k}" for k in range(10 - g % 2)]))]
    rows += [(100, " ".join(f"far{k}" for k in range(104))), (101, " ".join(f"far{k}" for k in range(80)))]
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    like = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (*range(0, 40, 2), 100)]
    assert all(.8 <= x < .85 for x in like[:-1]) and like[-1] < .8
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_per_group(spark, d, "").collect())
    assert kept == [*range(0, 40, 2), 100, 101]


def test_block_links_are_exact(monkeypatch, spark):
    monkeypatch.setattr(neardup, "STRIP", 7)
    rows = [(i, i, 0, " ".join(f"a{j}" for j in range(i // 2, 120)).encode()) for i in range(30)]
    links = neardup.block_links(rows)
    want = brute_components([(i, t.decode()) for i, _, _, t in rows])
    root = {i: i for i in range(30)}
    for a, b in links:
        ra, rb = root[a], root[b]
        root = {k: (ra if v == rb else v) for k, v in root.items()}
    assert len(set(root.values())) == len({c for _, c in want.values()})


def test_pre_token_counts_equal_the_tokenizer(spark):
    import sentencepiece
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" ", "  ", "a ", "a  b", "\n a\n", "▁x a▁b", " ▁ x", "<s> </s> <unk>", "a 　b", "é x", "tab\tx  y\r\n", "🙂 🙂🙂",
             PROSE, "", "\x00 a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for head in (0, 3, 10_000):
        got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(d, path, head=head).collect()}
        assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_decontamination_tolerates_substitutions(spark):
    item = [f"q{i}" for i in range(40)]
    noisy = list(item)
    for i in (4, 15, 26, 37):
        noisy[i] = "changed"
    d = spark.createDataFrame([(1, "some words before " + " ".join(noisy) + " and after"), (2, "clean " * 50),
                               (3, " ".join(item[:6]) + " else " * 30)], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item).upper())], "item_id long, text string")
    # the two words after the last substitution do not pay for it
    assert [(r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(d, b).collect()] == [(1, 7, 34)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [2, 3]


def test_sketch_quantiles_and_merge(spark):
    d = spark.createDataFrame([(i, " ".join("w" * (1 + i % 12) + f"{i}{k}" for k in range(40)), "en", "s")
                               for i in range(400)], "doc_id long, text string, lang string, source string")
    m = quality.measures(d).cache()
    whole = quality.sketches(m)
    parts = quality.sketches(m.filter("doc_id < 100")).union(quality.sketches(m.filter("doc_id >= 100"))) \
        .groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    q = quality.quantiles(whole, {"m": 0.5}).filter("measure = 'word_len'").first().m
    exact = m.select((F.col("word_chars") / F.col("n_words")).alias("x")).agg(F.percentile("x", 0.5)).first()[0]
    assert abs(q - exact) <= 2 * quality.ACCURACY * exact


def test_quality_limits_follow_the_data_in_both_directions(spark):
    def text(i, size):      # 40 words of about this length, all different
        return " ".join(f"{i}x{k}".ljust(int(size * (1 + i % 20 / 100) + k % 10 / 10), "w") for k in range(40))
    rows = [(i, text(i, 6), "en", "s") for i in range(200)] + [(1000 + i, text(i, 20), "long", "s") for i in range(200)]
    rows += [(500, text(500, 13), "en", "s"), (501, text(501, 13), "en", "tiny"), (1500, text(5, 8), "long", "s")]
    kept = {r.doc_id: r.kept for r in quality.judge(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    # words of 13 are below the former fixed 15, also in a group of one text;
    # words of 20 are above it but usual in their language, words of 8 are not
    assert sorted(i for i, k in kept.items() if not k) == [500, 501, 1500]


def brute_repeats(rows):
    count = Counter(t[k:k + 400] for t in rows for k in range(len(t) - 399))
    out = []
    for t in rows:
        cover = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k:k + 400]] > 1:
                cover[k:k + 400] = b"\x01" * 400
        kept = bytes(c for c, m in zip(t, cover) if not m)
        out.append((len(t), sum(cover), sum(1 for x in bytes(cover).split(b"\x00") if x), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [8000, 3])
def test_repeats_against_brute_force(spark, monkeypatch, split):
    import random
    monkeypatch.setattr(repeats, "SPLIT_PIECES", split)
    monkeypatch.setattr(repeats, "BATCH_PIECES", 10)
    rng = random.Random(3)
    r = lambda n: "".join(rng.choice("abcde éñ") for _ in range(n))
    common, long = r(500), r(1500)
    texts = [r(rng.randrange(0, 300)) + common[:rng.randrange(380, 500)] + r(rng.randrange(0, 300)) for _ in range(25)]
    texts += [long, long, r(200) + long[300:1100] + r(90), "ab" * 700, r(50) + "ab" * 300, r(399), "z" * 401, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(d).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts])


def test_lm_base_and_probabilities(spark):
    rows = [(i, " ".join(f"k{(i * j) % 23}" for j in range(60)) + (" rare%d" % i)) for i in range(60)]
    out = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*t.split(), None])
    n, v = sum(c.values()), len(c)
    for r in out:
        w = [*dict(rows)[r.doc_id].split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_lm_long_unknown_words_cost_all_their_bytes(spark):
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, " ".join(f"k{(i * j) % 23}" for j in range(60)) + f" rare{i}") for i in range(60)]
    rows += [(i, ("qzj" * n)[:n]) for i, n in zip(held, (5000, 10_000))]
    out = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short, long = (out[i] for i in held)
    assert short.score < -1000 and 1.9 < long.score / short.score < 2.1
    assert math.isclose(short.bits_per_byte, long.bits_per_byte, rel_tol=0.05)


def test_lm_words_and_decisions_are_found_array_wise():
    import numpy as np
    import pyarrow as pa
    texts = [" A  b\x0bA\x1cé É\n", "", None, " \t ", "b\u00a0b b\u2003A a", "x" * 3000]
    at, distinct, n = lm.coded(pa.array(["left out", *texts])[1:])
    want = [(t or "").encode().lower().split() for t in texts]
    assert [distinct[k].as_py() for k in at.tolist()] == [w for ws in want for w in ws]
    assert n.tolist() == [len(ws) for ws in want]
    symbols, n = lm.with_ends(at, n, 99)
    assert symbols.tolist() == [x for ws in want for x in [*(distinct.index(pa.scalar(w, pa.binary())).as_py() for w in ws), 99]]
    for most in (1, 5, 100):        # whole sequences, as many as fit
        parts = list(lm._pieces(symbols, n, most))
        assert np.concatenate([p[0] for p in parts]).tolist() == symbols.tolist()
        assert all(p[1].sum() == len(p[2]) and (len(p[2]) == 1 or p[2].sum() <= most) for p in parts)
    tree = lm.Tree([5, 1, 1, 9, 3])
    s = np.array([3, 0, 3, 4, 2, 1])
    node, _, bit, length = tree.decisions(s)
    assert np.bincount(2 * node + bit, minlength=2 * tree.n_nodes).tolist() == tree.counts(np.bincount(s, minlength=5)).tolist()
    assert length.tolist() == tree.length[s].tolist()


def test_lm_costs_equal_a_plain_sum_over_decisions():
    import numpy as np
    rng = np.random.default_rng(8)
    tree = lm.Tree([50, 20, 9, 3, 1])
    counts = [rng.integers(0, 9, (2, z)).astype(float) for z in [tree.n_nodes] + [lm.SLOTS] * lm.ORDERS]
    model = lm.Mixer(tree, counts).finish(None, np.sort(rng.integers(0, 50, (2, lm.GATES * lm.BUCKETS)), axis=0)[::-1])
    texts = [rng.integers(0, 5, k).tolist() for k in (1, 40, 7)]
    symbols, n = np.concatenate(texts), np.array([len(t) for t in texts])
    got = lm.cost_of(model, symbols, n)
    for t, value in zip(texts, got.tolist()):
        total, ctx = 0.0, lm.contexts(np.array(t), np.arange(len(t)) == 0)
        for i, x in enumerate(t):
            node, spread, bit, _ = tree.decisions(np.array([x]))
            for j in range(len(node)):
                at = [int(lm.slots(c[i:i + 1], spread[j:j + 1], np.array([1]))[0]) for c in ctx]
                n0, n1 = zip(*((c[0][a], c[1][a]) for c, a in zip(counts, [node[j], *at])))
                conf = [min(int(math.log2(a + b + 1)), 3) for a, b in zip(n0, n1)]
                gate = conf[1] + 4 * conf[2]
                z = sum(w * math.log((b + .4) / (a + .4)) for w, a, b in zip((.8, .3, .2, .2), n0, n1))
                z = min(max(z, -12), 12)
                place = (z + 12) * (lm.BUCKETS - 1) / 24
                lo = min(int(place), lm.BUCKETS - 2)
                low, high = model.refined[gate * lm.BUCKETS + lo:][:2].astype(float)
                p = .5 * (1 / (1 + math.exp(-z)) + low + (high - low) * (place - lo))
                p = min(max(p, 1e-6), 1 - 1e-6)
                total += math.log10(p if bit[j] else 1 - p)
        assert math.isclose(value, total, rel_tol=1e-5)


def test_lm_token_table_counts_across_its_sums(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 10)
    rows = [(f"w{i % 7} W{i % 5} once{i}", i % 3 == 0) for i in range(600)] + [(None, False), ("", True)]
    got = {bytes(r.token): (r.c, r.freq) for r in lm.token_table(spark.createDataFrame(rows, "text string, held_out boolean")).collect()}
    c, freq = Counter(), Counter()
    for t, held in rows:
        ws = (t or "").encode().lower().split()
        freq.update(ws)
        c.update([] if held else ws)
    assert got == {w: (c[w], f) for w, f in freq.items()}


def test_tree_codes_are_complete():
    tree = lm.Tree([5, 1, 1, 9, 3])
    assert math.isclose(sum(2.0 ** -n for n in tree.length.tolist()), 1.0)


def test_toxicity_finds_held_out_texts(spark):
    rows = [(i, ("you are a stupid idiot and a loser " if i % 4 == 1 else "the river runs through a quiet valley ") * 3
             + f"number {i}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, 0, int(i % 4 == 1)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(d, y).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.doc_id % 4 == 1) for r in out if r.held_out)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    import numpy as np
    slots = shards.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 100 or shards.feistel(np.arange(n), n, key=5).tolist() != slots.tolist()


def test_shards_round_trip(spark, tmp_path):
    import sentencepiece
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    d = spark.createDataFrame([(i, (PROSE[i * 3:i * 3 + 5 + i * 11] + "  é ")) for i in range(60)], "doc_id long, text string")
    out = str(tmp_path / "shards")
    m = shards.materialise(d.coalesce(1), path, out=out, length=32, per_shard=16).collect()
    assert sorted(r.slot for r in m) == list(range(len(m)))
    n_shards = -(-len(m) // 16)
    read = dict(x for k in range(n_shards) for x in shards.read_shard(spark, out, k, length=32, per_shard=16).collect())
    assert len(read) == len(m)
    for r in m:
        ids = read[r.slot]
        assert zlib.crc32(b"".join(x.to_bytes(2, "little") for x in ids)) == r.crc
        assert r.shard == r.slot // 16 and r.offset == r.slot % 16 * shards.stride(32)
    # the stream in index order is every text's ids and its end id
    import numpy as np
    slot_of = shards.feistel(np.arange(len(m)), len(m)).tolist()
    stream = [x for i in range(len(m)) for x in read[slot_of[i]]]
    want = [x for r in sorted(d.collect()) for x in [*sp.encode(r.text), shards.END]]
    assert stream[:len(want)] == want and set(stream[len(want):]) <= {shards.PAD}
    assert shards.read_shard(spark, out, 1, first=20, length=32, per_shard=16).collect() == [
        (k, read[k]) for k in range(20, 32)]
