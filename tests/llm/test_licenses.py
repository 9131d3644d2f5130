import re

from graphloom.llm import licenses

SCHEMA = "doc_id long, text string, ids string, found int"
MIT = "\n".join(licenses.SENTENCES[k][0] + "." for k in ("mit-grant", "mit-notice", "as-is", "mit-liability")).replace(":.", ":\n")
APACHE = """Some words first.
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at

 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
"""
GPL = """# Copyright 2024 Someone
#
# This program is free software: you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by the Free
# Software Foundation, either version 3 of the License, or (at your option)
# any later version.
#
# This program is distributed in the hope that it will be useful, but WITHOUT
# ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
# FOR A PARTICULAR PURPOSE.
"""
BSD = [licenses.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
TEXTS = {
    "": "", "No notice here, though it speaks of a license. And of warranty.": "",
    "Some words.\nReleased under the MIT License.\nMore words": "MIT",
    "A title without a stop\nLicensed under CC BY-NC 4.0.\nmore": "CC-BY-NC-4.0",
    "x\nThis work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    APACHE: "Apache-2.0", MIT: "MIT",
    f"{MIT}\n\nReleased under the BSD 3-Clause License. Released under the MIT License.": "MIT,BSD-3-Clause",
    "// SPDX-License-Identifier: LGPL-3.0": "LGPL-3.0",
    GPL: "GPL-3.0-or-later",
    BSD[0] + ".\n" + BSD[3] + ".": "BSD-3-Clause",
    BSD[0] + ".\n" + "Something else is said here at length. " * 2000 + BSD[3] + ".": "BSD-2-Clause",
    BSD[0] + ".\n" + "one two three four five\n" * 12 + BSD[3] + ".": "BSD-3-Clause",
    BSD[0] + ".\n" + "one two three four five\n" * 13 + BSD[3] + ".": "BSD-2-Clause",
    "You may obtain a copy. See the License for the specific language governing permissions and limitations under the License.": "",
}


def brute(text):
    known, ids, sequence, between = licenses.known(), [], "", 0
    for s in re.split(licenses.SENTENCE, text or ""):
        n = licenses.normal(s)
        for piece in [n] if n in known else [licenses.normal(x) for x in s.split("\n")]:
            if piece not in known:
                between += len(piece.split())
                continue
            sequence += ("<~>" if ids and between > licenses.BETWEEN else "") + f"<{known[piece]}>"
            ids.append(known[piece])
            between = 0
    names, at = [], 0
    while at < len(sequence):
        for name, pattern in licenses.rules():
            if m := re.compile(pattern).match(sequence, at):
                names.append(name)
                at = m.end()
                break
        else:
            at += 1
    return ",".join(dict.fromkeys(names)), len(names), " ".join(ids)


def test_known_texts_and_brute_force(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(90, None, None, None), (91, "word " * 40_000 + "\nReleased under the MIT License.", None, None), (None, "MIT", None, None), (91, "", None, None)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.licenses, r.n_notices, r.sentence_ids) for r in got) == sorted((str(i), *brute(t)) for i, t, *_ in rows)
    by = {r.doc_id: r.licenses for r in got}
    assert [by[i] for i in range(len(TEXTS))] == list(TEXTS.values())
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_known_sentence_passes_the_first_look():
    raw = [s for forms in licenses.SENTENCES.values() for s in forms] + [n.format(f) for n in licenses.NOTICES for forms in licenses.NAMES.values() for f in forms] + ["SPDX-License-Identifier: MIT"]
    assert all(any(stem in s.lower() for stem in licenses.STEMS) for s in raw)
