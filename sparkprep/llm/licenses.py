"""Licence scan by sentence rules (JVM only).

Each text is cut into sentences, each sentence is normalised and looked up in a
table of known licence sentences, and the sequence of identifiers found is
matched against ordered rules; a rule that matches consumes its identifiers, so
an earlier, more specific rule hides a later one. All work is done inside the
row: no shuffle, no broadcast.

Nulls and empty texts have no sentences; repeated rows are scanned alike;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

# Sentences of public licence texts, normalised (lower case,
# every run of other characters than a-z and 0-9 as one space).
SENTENCES = [
    ("MITgrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITnotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITasis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MITliability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("MITref", "released under the mit license"),
    ("MITref", "licensed under the mit license"),
    ("MITref", "this project is licensed under the mit license"),
    ("BSDgrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDsource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDbinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDendorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDadvert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD2ref", "licensed under the bsd 2 clause license"),
    ("BSD3ref", "licensed under the bsd 3 clause license"),
    ("APACHE2ref", "licensed under the apache license version 2 0"),
    ("APACHE2ref", "licensed under the apache license version 2 0 the license"),
    ("APACHE2ref", "released under the apache license version 2 0"),
    ("APACHE2may", "you may not use this file except in compliance with the license"),
    ("APACHE2copy", "you may obtain a copy of the license at"),
    ("APACHE2asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("APACHE2see", "see the license for the specific language governing permissions and limitations under the license"),
    ("GPL3only", "this work is licensed under the gnu general public license version 3"),
    ("GPL3only", "licensed under the gnu general public license version 3"),
    ("GPL2only", "this work is licensed under the gnu general public license version 2"),
    ("GPL2only", "licensed under the gnu general public license version 2"),
    ("GPL3later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPLwarranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLdetails", "see the gnu general public license for more details"),
    ("GPLreceived", "you should have received a copy of the gnu general public license along with this program"),
    ("LGPL21later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("LGPL3ref", "licensed under the gnu lesser general public license version 3"),
    ("AGPL3ref", "licensed under the gnu affero general public license version 3"),
    ("MPL2ref", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL2copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("ISCgrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZLIBasis", "this software is provided as is without any express or implied warranty"),
    ("ZLIBgrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("BOOSTref", "distributed under the boost software license version 1 0"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("CC0ref", "licensed under cc0 1 0"),
    ("CCBY4ref", "licensed under cc by 4 0"),
    ("CCBYSA4ref", "licensed under cc by sa 4 0"),
    ("CCBYNC4ref", "licensed under cc by nc 4 0"),
    ("CCBYND4ref", "licensed under cc by nd 4 0"),
    ("CCBYNCSA4ref", "licensed under cc by nc sa 4 0"),
    ("CCBYNCND4ref", "licensed under cc by nc nd 4 0"),
    ("CCBY4ref", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CCBYSA4ref", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CCBYNC4ref", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("ALLRIGHTS", "all rights reserved"),
]

# Published wordings that hold a sentence end inside: the cutter below makes
# several sentences of each, with an identifier in turn (None: the sentence has
# no letters and names no licence). The keys above match wordings without one.
_FREE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
PUBLISHED = [
    (("GPLfree", "GPL3later"), _FREE.format("program", "", ",", "3")),
    (("GPLfree", "GPL2later"), _FREE.format("program", "", ",", "2")),
    (("LGPLfree", "LGPL21later"), _FREE.format("library", "Lesser ", ",", "2.1")),
    (("GPLfree", "GPLterms", "V3later"), _FREE.format("program", "", ";", "3")),
    (("GPLfree", "GPLterms", "V2later"), _FREE.format("program", "", ";", "2")),
    (("LGPLfree", "LGPLterms", "V21later"), _FREE.format("library", "Lesser ", ";", "2.1")),
    (("GPLwarranty", "GPLimplied"), "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    (("MPL2ref", None), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def keys(raw: str) -> list[str]:
    """The normalised sentences of a licence text, cut as ``sentences`` cuts."""
    cut = re.sub(r"\n[ \t\x0B\f\r]*\n", "\x01", re.sub(r"([.!?:;])[ \t\n\x0B\f\r]+", "\\1\x01", raw.lower()))
    return [re.sub("[^a-z0-9]+", " ", s).strip() for s in cut.split("\x01")]


_seen = {s for _, s in SENTENCES}
for _ids, _raw in PUBLISHED:
    for _id, _key in zip(_ids, keys(_raw), strict=True):
        if _id and _key not in _seen:
            _seen.add(_key)
            SENTENCES.append((_id, _key))

# Ordered rules over the identifier sequence, written "<A><B><C>": the licence
# and a pattern whose matches it consumes (first rule first).
RULES = [
    ("BSD-4-Clause", "<BSDgrant><BSDsource><BSDbinary><BSDadvert>(<BSDendorse>)?"),
    ("BSD-3-Clause", "<BSDgrant><BSDsource><BSDbinary><BSDendorse>|<BSD3ref>"),
    ("BSD-2-Clause", "<BSDgrant><BSDsource><BSDbinary>|<BSD2ref>"),
    ("MIT", "<MITgrant><MITnotice>(<MITasis>)?(<MITliability>)?|<MITref>"),
    ("ISC", "<ISCgrant>(<MITasis>)?"),
    ("Zlib", "<ZLIBasis><ZLIBgrant>"),
    ("Apache-2.0", "<APACHE2ref>(<APACHE2may>)?(<APACHE2copy>)?(<APACHE2asis>)?(<APACHE2see>)?"),
    ("LGPL-2.1-or-later", "(<LGPLfree>)?(<LGPL21later>|<LGPLterms><V21later>)(<GPLwarranty>)?(<GPLimplied>)?"),
    ("GPL-3.0-or-later", "(<GPLfree>)?(<GPL3later>|<GPLterms><V3later>)(<GPLwarranty>)?(<GPLimplied>)?(<GPLdetails>)?(<GPLreceived>)?"),
    ("GPL-2.0-or-later", "(<GPLfree>)?(<GPL2later>|<GPLterms><V2later>)(<GPLwarranty>)?(<GPLimplied>)?(<GPLdetails>)?(<GPLreceived>)?"),
    ("GPL-3.0-only", "<GPL3only>"),
    ("GPL-2.0-only", "<GPL2only>"),
    ("LGPL-3.0-only", "<LGPL3ref>"),
    ("AGPL-3.0-only", "<AGPL3ref>"),
    ("MPL-2.0", "<MPL2ref>(<MPL2copy>)?"),
    ("BSL-1.0", "<BOOSTref>"),
    ("Unlicense", "<UNLICENSE>"),
    ("CC0-1.0", "<CC0ref>"),
    ("CC-BY-NC-SA-4.0", "<CCBYNCSA4ref>"),
    ("CC-BY-NC-ND-4.0", "<CCBYNCND4ref>"),
    ("CC-BY-NC-4.0", "<CCBYNC4ref>"),
    ("CC-BY-SA-4.0", "<CCBYSA4ref>"),
    ("CC-BY-ND-4.0", "<CCBYND4ref>"),
    ("CC-BY-4.0", "<CCBY4ref>"),
    ("Proprietary", "<ALLRIGHTS>"),
]
# This rule names no licence where another rule did: open licences are headed by the same line.
ALONE = "Proprietary"

# A text without any of these has no known sentence (a test checks that every
# sentence above holds one), so it is not cut into sentences at all.
CUES = ["licen[cs]e", "copyright", "permission", "redistribut", "warrant", "public domain",
        "terms of", "advertising", "rights reserved", "licensed under", "mpl", "free software"]

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CUT = "\x01"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences of a lower-cased text: ends are .!?:; before white space, or
    an empty line. A sentence that spans lines is followed by its lines, so a
    licence line below an unfinished line is seen too."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([.!?:;])[ \t\n\x0B\f\r]+", "$1" + CUT),
                           r"\n[ \t\x0B\f\r]*\n", CUT)
    return F.flatten(F.transform(F.split(cut, CUT), lambda s: F.when(
        F.instr(s, "\n") > 0, F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))


def scan(docs: DataFrame, known=SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_known (long), sentence_ids and licenses
    (comma-joined, in order of the text and of the rules; '' for none), and
    unmatched (known sentences that no rule took)."""
    lookup = F.map_from_arrays(F.array(*[F.lit(s) for _, s in known]),
                               F.array(*[F.lit(i) for i, _ in known]))
    low = F.translate("text", *_LOWER)
    hit = F.coalesce(F.col("low").rlike("|".join(CUES)), F.lit(False))
    found = F.when(hit, F.filter(F.transform(sentences(F.col("low")),
                                             lambda s: F.element_at(lookup, _normal(s))),
                                 lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    rule_rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in rules])

    def apply(state: Column, rule: Column) -> Column:
        return F.struct(
            F.regexp_replace(state.seq, rule.pattern, F.lit("")).alias("seq"),
            F.when(F.rlike(state.seq, rule.pattern) & ((rule["name"] != ALONE) | (F.size(state.lic) == 0)),
                   F.concat(state.lic, F.array(rule["name"])))
            .otherwise(state.lic).alias("lic"))

    d = (id_text(docs).withColumn("low", low)
         .select("doc_id", found.alias("ids")))
    seq = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("lic"))
    end = F.when(F.size("ids") > 0, F.aggregate(rule_rows, start, apply))
    d = d.withColumn("end", end)
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.coalesce(F.array_join("end.lic", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.col("end.seq"), F.lit("")).alias("unmatched"))


def oracle(known=SENTENCES, rules=RULES) -> str:
    """The same scan in DuckDB SQL over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keys = ", ".join(q(s) for _, s in known)
    vals = ", ".join(q(i) for i, _ in known)
    steps = ["""d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)""",
             r"""s AS (SELECT doc_id, CASE WHEN low IS NULL THEN [] ELSE string_split(regexp_replace(regexp_replace(low,
  '([.!?:;])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), '\n[ \t\v\f\r]*\n', chr(1), 'g'), chr(1)) END AS p FROM d)""",
             """l AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN contains(x, chr(10)) THEN list_concat([x], string_split(x, chr(10))) ELSE [x] END)) AS p FROM s)""",
             f"""k AS (SELECT doc_id, list_filter(list_transform(p, lambda x: map_extract(MAP([{keys}], [{vals}]), trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')))[1]), lambda y: y IS NOT NULL) AS ids FROM l)""",
             """r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN '<' || array_to_string(ids, '><') || '>' ELSE '' END AS seq, CAST([] AS VARCHAR[]) AS lic FROM k)"""]
    for n, (name, pattern) in enumerate(rules):
        alone = " AND len(lic) = 0" if name == ALONE else ""
        steps.append(f"""r{n + 1} AS (SELECT doc_id, ids, regexp_replace(seq, {q(pattern)}, '', 'g') AS seq,
  CASE WHEN regexp_matches(seq, {q(pattern)}){alone} THEN list_append(lic, {q(name)}) ELSE lic END AS lic FROM r{n})""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(lic, ','), '') AS licenses, seq AS unmatched FROM r{len(rules)}"""
