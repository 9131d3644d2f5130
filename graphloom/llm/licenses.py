"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, everything but a-z and 0-9 to single spaces) and looked up
among known licence sentences; what is found forms the text's sequence of sentence identifiers. Ordered rules over such
sequences name the licences: at each place the first rule that matches takes its identifiers. A sentence may run over
lines, and ends before a line without a letter or digit; one that is unknown as a whole is looked up line by line. Known sentences without a
rule stay unnamed. Where more than BETWEEN words of unknown sentences lie between two known ones, a mark parts them, so no rule reaches across.

Only texts that hold one of STEMS are cut at all: every known sentence holds one. The table of sentences is fixed and
small, and is looked up by a checksum first: a slot holds the few sentences of one remainder. Every stem is one word, so a line's end does not part it. Cases: null and empty texts have no licence; repeated rows give repeated rows; texts of any length are scanned
whole, within their row; columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences in short notices, and the sentences of licence headers as published.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
}
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
                    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NOTICES = ["Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "This work is licensed under {}", "This project is licensed under {}",
           "This software is licensed under {}", "This file is licensed under {}", "This document is licensed under {}", "This text is licensed under {}",
           "This work is released under {}", "This project is released under {}", "This software is released under {}", "License: {}"]
SENTENCES = {
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
                     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use these files except in compliance with the License'],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
                     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
                  "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                  "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
              "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                      "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                   "and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                  "without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                  "copyright notice and this permission notice appear in all copies"],
    "gpl2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                   "Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                   "Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl21-grant": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                     "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "agpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
                    "Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gnu-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
                 "FOR A PARTICULAR PURPOSE", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                 "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gnu-see": [f"See the GNU {k}General Public License for more details" for k in ("", "Lesser ", "Affero ")],
    "gnu-copy": ["You should have received a copy of the GNU General Public License along with this program"],
    "mpl-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "public-domain": ["This work is in the public domain", "This text is in the public domain", "Released into the public domain", "This work has been released into the public domain"],
    "all-rights": ["All rights reserved", "Copyright. All rights reserved"],
}
#: (licence, pattern over identifiers written as <id>), the first that matches at a place wins.
RULES = [
    ("Apache-2.0", "<apache-grant>(<apache-copy>)?(<apache-basis>)?(<apache-see>)?"),
    ("Apache-2.0", "(<apache-copy>)?<apache-basis>(<apache-see>)?"),
    ("MIT", "<mit-grant>(<mit-notice>)?(<as-is>)?(<mit-liability>)?"),
    ("MIT", "<mit-notice><as-is>(<mit-liability>)?"),
    ("BSD-3-Clause", "<bsd-grant>(<bsd-source>)?(<bsd-binary>)?<bsd-names>"),
    ("BSD-2-Clause", "<bsd-grant>(<bsd-source>)?(<bsd-binary>)?"),
    ("ISC", "<isc-grant>"),
    ("GPL-3.0-or-later", "<gpl3-grant>(<gnu-hope>)?(<gnu-see>)?(<gnu-copy>)?"),
    ("GPL-2.0-or-later", "<gpl2-grant>(<gnu-hope>)?(<gnu-see>)?(<gnu-copy>)?"),
    ("LGPL-2.1-or-later", "<lgpl21-grant>(<gnu-hope>)?(<gnu-see>)?"),
    ("AGPL-3.0-or-later", "<agpl3-grant>(<gnu-hope>)?(<gnu-see>)?"),
    ("MPL-2.0", "<mpl-subject>"),
    ("Unlicense", "<unlicense-grant>"),
    ("public-domain", "<public-domain>"),
]
STEMS = ["licen", "permission", "redistribut", "warrant", "copyright", "public", "reserved", "released", "distributed", "available"]
#: Ends of sentences, and of lines.
SENTENCE, LINE = r"[.!?]+[ \t\r\n]+|\n[^A-Za-z0-9\n]*\n", r"\n"
#: Words of unknown sentences that may lie between two sentences of one notice, and the mark where more do.
BETWEEN, APART = 60, "~"
#: Slots of the table of known sentences.
SLOTS = 2048


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def notices() -> dict[str, str]:
    """Normalised short notices, each to its licence: every name with every notice, with and without an article."""
    names = dict(NAMES)
    for code, words in CREATIVE_COMMONS.items():
        for version in ("3.0", "4.0"):
            names[f"CC-{code}-{version}"] = [f"CC {code} {version}", f"CC-{code}-{version}", f"Creative Commons {words} {version}", f"Creative Commons {words} {version} International License"]
    out = {}
    for licence, forms in names.items():
        out[normal(f"SPDX-License-Identifier: {licence}")] = licence
        for form in forms:
            for notice in NOTICES:
                for article in ("", "the ", "a "):
                    out[normal(notice.format(article + form))] = licence
    return out


def known() -> dict[str, str]:
    """Normalised sentences to their identifiers; a short notice's identifier is its licence after 'says-'."""
    out = {s: f"says-{licence}" for s, licence in notices().items()}
    return out | {normal(s): i for i, forms in SENTENCES.items() for s in forms}


def rules() -> list[tuple[str, str]]:
    return RULES + [(licence, f"<says-{re.escape(licence)}>".replace(r"\-", "-")) for licence in sorted(set(notices().values()))]


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _known(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    slots: list[list[tuple[str, str]]] = [[] for _ in range(SLOTS)]
    for s, i in sorted(known().items()):
        slots[zlib.crc32(s.encode()) % SLOTS].append((s, i))
    empty = F.expr("cast(map() as map<string,string>)")
    table = F.array(*[F.create_map(*[F.lit(x) for pair in slot for x in pair]) if slot else empty for slot in slots])
    return F.element_at(F.get(table, F.crc32(sentence.cast("binary")) % SLOTS), sentence)


def _identifiers(text: Column) -> Column:
    def piece(sentence: Column) -> Column:
        return F.struct(_known(sentence).alias("id"), F.when(sentence == "", 0).otherwise(F.size(F.split(sentence, " "))).alias("words"))

    def of(sentence: Column) -> Column:
        whole = piece(_normal(sentence))
        return F.when(whole["id"].isNotNull(), F.array(whole)).otherwise(F.transform(F.split(sentence, LINE), lambda line: piece(_normal(line))))

    def step(state: Column, x: Column) -> Column:
        far = (state["between"] > BETWEEN) & (F.size(state["ids"]) > 0)
        ids = F.concat(state["ids"], F.when(far, F.array(F.lit(APART), x["id"])).otherwise(F.array(x["id"])))
        return (F.when(x["id"].isNull(), F.struct(state["ids"].alias("ids"), (state["between"] + x["words"]).alias("between")))
                .otherwise(F.struct(ids.alias("ids"), F.lit(0).alias("between"))))

    pieces = F.flatten(F.transform(F.split(text, SENTENCE), of))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("ids"), F.lit(0).alias("between"))
    return F.aggregate(pieces, start, step, lambda state: state["ids"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (in order, distinct), n_notices and sentence_ids of each row of (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in STEMS])
    none = F.expr("cast(array() as array<string>)")
    out = docs.select("doc_id", F.when(may, _identifiers(text)).otherwise(none).alias("ids"))
    sequence = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    named = F.filter("ids", lambda i: i != APART)
    out = out.select("doc_id", "ids", F.regexp_extract_all(sequence, F.lit("|".join(f"(?:{p})" for _, p in rules())), F.lit(0)).alias("found"))

    def name(run: Column) -> Column:
        first, *others = rules()
        case = F.when(run.rlike(f"^(?:{first[1]})$"), first[0])
        for licence, pattern in others:
            case = case.when(run.rlike(f"^(?:{pattern})$"), licence)
        return case

    return out.select("doc_id", F.concat_ws(",", F.array_distinct(F.transform("found", name))).alias("licenses"), F.size("found").cast("long").alias("n_notices"), F.concat_ws(" ", named).alias("sentence_ids"))


def oracle() -> str:
    """The same rows in DuckDB."""
    table = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in sorted(known().items())) + "}"
    norm = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    case = "CASE " + " ".join(f"WHEN regexp_full_match(r, '(?:{p})') THEN '{licence}'" for licence, p in rules()) + " END"
    every = "|".join(f"(?:{p})" for _, p in rules())
    sentence, line = SENTENCE, LINE
    return rf"""
WITH known AS MATERIALIZED (SELECT unnest(map_keys(m)) AS s, unnest(map_values(m)) AS id FROM (SELECT {table} AS m)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT rid, regexp_split_to_array(text, '{sentence}') AS ss FROM d)),
whole AS (SELECT rid, i, s.s, id FROM s LEFT JOIN known k ON k.s = {norm.format('s.s')}),
l AS (SELECT rid, i, unnest(ls) AS l, generate_subscripts(ls, 1) AS j FROM (SELECT rid, i, regexp_split_to_array(s, '{line}') AS ls FROM whole WHERE id IS NULL)),
parts AS (SELECT rid, i, 0 AS j, id, 0 AS words FROM whole WHERE id IS NOT NULL UNION ALL
    SELECT rid, i, j, k.id, CASE WHEN k.id IS NOT NULL OR l.n = '' THEN 0 ELSE len(string_split(l.n, ' ')) END FROM (SELECT *, {norm.format('l')} AS n FROM l) l LEFT JOIN known k ON k.s = l.n),
run AS (SELECT *, sum(words) OVER (PARTITION BY rid ORDER BY i, j) AS so_far FROM parts),
ids AS (SELECT rid, i, j, id, so_far - lag(so_far) OVER (PARTITION BY rid ORDER BY i, j) AS between FROM run WHERE id IS NOT NULL),
q AS (SELECT rid, string_agg(CASE WHEN between > {BETWEEN} THEN '<{APART}>' ELSE '' END || '<' || id || '>', '' ORDER BY i, j) AS q, string_agg(id, ' ' ORDER BY i, j) AS sentence_ids FROM ids GROUP BY rid),
f AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, regexp_extract_all(coalesce(q, ''), '{every}') AS found FROM d LEFT JOIN q USING (rid))
SELECT doc_id, sentence_ids, len(found)::BIGINT AS n_notices,
    coalesce(array_to_string(list_filter(names, lambda n, i: list_position(names, n) = i), ','), '') AS licenses
FROM (SELECT *, list_transform(found, lambda r: {case}) AS names FROM f)"""
