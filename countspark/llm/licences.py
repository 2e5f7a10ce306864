"""Licences by sentence rules: known sentences become identifiers, and sequences of identifiers are matched against ordered rules.

A text is cut into sentences, each is normalised and looked up. Neighbouring identifiers form a sequence (unknown sentences between
them are a gap), in which the rules are tried in order, the longest first; what a rule has matched is not matched again. Texts are
cut twice, with and without regarding line ends, because licences stand on one line each or wrapped over many.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Sentences of published licence texts and headers, as they are written there.
SENTENCES = {
    "MIT-GRANT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                 "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                 "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-AS-IS": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
                 "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MIT-LIABILITY": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
                     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
                 "and this permission notice appear in all copies.",
    "ISC-AS-IS": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "ISC-LIABILITY": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
                     "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-GRANT": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
                  "materials provided with the distribution.",
    "BSD-AS-IS": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
                 "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "APACHE-UNDER": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "APACHE-COMPLY": "you may not use this file except in compliance with the License.",
    "APACHE-COPY": "You may obtain a copy of the License at",
    "APACHE-URL": "http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-BASIS": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                    "CONDITIONS OF ANY KIND, either express or implied.",
    "APACHE-SEE": "See the License for the specific language governing permissions and limitations under the License.",
    "GNU-FREE": "This program is free software:",
    "GNU-LIB-FREE": "This library is free software;",
    "GPL-2-TERMS": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; ",
    "GPL-2-LATER": "either version 2 of the License, or (at your option) any later version.",
    "GPL-3-TERMS": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                   "License, or (at your option) any later version.",
    "LGPL-TERMS": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "LGPL-2.1-LATER": "either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3-TERMS": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
                    "the License, or (at your option) any later version.",
    "GNU-HOPE": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GNU-LIB-HOPE": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "MPL-2-TERMS": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ZLIB-AS-IS": "This software is provided 'as-is', without any express or implied warranty.",
    "ZLIB-LIABILITY": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "ZLIB-GRANT": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
                  "following restrictions:",
    "UNLICENSE-DOMAIN": "This is free and unencumbered software released into the public domain.",
    "DOMAIN": "This work is in the public domain.",
    "ALL-RIGHTS": "All rights reserved.",
}
#: Names of licences as they follow the phrases below, with their identifiers.
NAMES = {
    "MIT License": "MIT", "MIT licence": "MIT", "ISC License": "ISC", "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "Apache 2.0 License": "Apache-2.0",
    "GNU General Public License, version 2": "GPL-2.0", "GNU General Public License, version 3": "GPL-3.0", "GNU GPL v3": "GPL-3.0", "GNU GPL v2": "GPL-2.0",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1", "GNU Lesser General Public License, version 3": "LGPL-3.0", "GNU Affero General Public License, version 3": "AGPL-3.0",
    "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "Mozilla Public License, version 2.0": "MPL-2.0", "Mozilla Public License 2.0": "MPL-2.0",
    **{f"CC {form} {v}": f"CC-{form}-{v}" for form in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
    "Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0", "CC0 1.0": "CC0-1.0",
}
PHRASES = ("Licensed under", "Released under", "This work is licensed under", "This project is licensed under", "This software is released under", "Distributed under", "Available under")
#: Sentences with free parts, on the normalised text.
PATTERNS = {
    "COPYRIGHT": r"^copyright( c)? [0-9]{4}.*$|^copyright c .*$",
    "BSD-ENDORSE": r"^neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$",
    "BSD-LIABILITY": r"^in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages .* even if advised of the possibility of such damage$",
    "GNU-MERCHANT": r"^without even the implied warranty of merchantability or fitness for a particular purpose$",
}
#: Rules in the order in which they are tried at a place of the sequence.
RULES = [
    ("MIT", "MIT-GRANT MIT-NOTICE MIT-AS-IS MIT-LIABILITY"), ("MIT", "MIT-GRANT MIT-NOTICE MIT-AS-IS"), ("ISC", "ISC-GRANT ISC-AS-IS ISC-LIABILITY"),
    ("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE BSD-AS-IS BSD-LIABILITY"), ("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE"),
    ("BSD-2-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-AS-IS BSD-LIABILITY"), ("BSD-2-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY"),
    ("Apache-2.0", "APACHE-UNDER APACHE-COMPLY APACHE-COPY APACHE-URL APACHE-BASIS APACHE-SEE"), ("Apache-2.0", "APACHE-UNDER APACHE-COMPLY"),
    ("GPL-3.0-or-later", "GNU-FREE GPL-3-TERMS GNU-HOPE GNU-MERCHANT"), ("GPL-3.0-or-later", "GNU-FREE GPL-3-TERMS"),
    ("GPL-2.0-or-later", "GNU-FREE GPL-2-TERMS GPL-2-LATER GNU-HOPE GNU-MERCHANT"), ("GPL-2.0-or-later", "GNU-FREE GPL-2-TERMS GPL-2-LATER"),
    ("LGPL-2.1-or-later", "GNU-LIB-FREE LGPL-TERMS LGPL-2.1-LATER GNU-LIB-HOPE GNU-MERCHANT"), ("LGPL-2.1-or-later", "GNU-LIB-FREE LGPL-TERMS LGPL-2.1-LATER"),
    ("AGPL-3.0-or-later", "GNU-FREE AGPL-3-TERMS GNU-HOPE GNU-MERCHANT"), ("AGPL-3.0-or-later", "GNU-FREE AGPL-3-TERMS"),
    ("Zlib", "ZLIB-AS-IS ZLIB-LIABILITY ZLIB-GRANT"), ("MPL-2.0", "MPL-2-TERMS"), ("Unlicense", "UNLICENSE-DOMAIN"), ("Public-Domain", "DOMAIN"),
    *((name, f"IS-{name}") for name in dict.fromkeys(NAMES.values())),
]
#: Every known sentence holds one of these; other texts need not be cut.
ANCHORS = ("licens", "licenc", "copyright", "permission", "permitted", "warrant", "redistribut", "public domain", "software", "rights reserved", "liable", "subject to the terms", "promote products",
           "under cc", "gpl", "under the cc")
#: What the scan itself looks for in a raw text: single words, as line ends and comment heads can stand between two, and CC as a word.
ANCHOR_WORDS = (*(a for a in ANCHORS if " " not in a), "domain", "reserved")
ANCHOR_CC = r"(^|[^a-z0-9])cc([^a-z]|$)"
#: Marks inside known sentences that look like their ends: the version of the MPL and the list in the liability of the BSD.
NO_END = r"(\bv)\.(?=[ \t\r\n\f]+[0-9])|(\bsubstitute[ \t\r\n\f]+goods[ \t\r\n\f]+or[ \t\r\n\f]+services|\bloss[ \t\r\n\f]+of[ \t\r\n\f]+use,[ \t\r\n\f]+data,?[ \t\r\n\f]+or[ \t\r\n\f]+profits);(?=[ \t\r\n\f])"
#: Steps of the normalisation: line heads of comments, sentence ends, what is no letter or digit.
LINE_HEAD = r"(?m)^[ \t]*(/\*+|\*+/|\*+|//+|#+|;+|--+|%+)[ \t]*"
SENTENCE_END = r"([.!?:;])[\"')\]]*[ \t\r\n\f]+"
BLANK_LINE = r"\n[ \t]*\n"
NOT_WORD = r"[^a-z0-9]+"
CUT = "\x01"


def plain(sentence: str) -> str:
    """A sentence as it is looked up."""
    return re.sub(NOT_WORD, " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier."""
    table = {plain(s): name for name, s in SENTENCES.items()}
    for phrase in PHRASES:
        for written, name in NAMES.items():
            for article in ("", "the ", "a "):
                table.setdefault(plain(f"{phrase} {article}{written}"), f"IS-{name}")
    return table


def rule_table() -> dict[str, str]:
    """Marked sequence to licence, in the order of the rules."""
    return {"".join(f"<{i}>" for i in ids.split()): name for name, ids in RULES}


def _sequence(text: Column, by_line: bool) -> Column:
    """The marked sequence of a lower-cased text: ``<ID>`` per known sentence, ``<>`` per run of unknown ones."""
    body = F.regexp_replace(text, LINE_HEAD, "")
    body = F.regexp_replace(body, NO_END, "$1$2")
    body = F.regexp_replace(body, SENTENCE_END, "$1" + CUT)
    body = F.regexp_replace(body, "\n" if by_line else BLANK_LINE, CUT)
    cut = F.transform(F.split(body, CUT), lambda s: F.trim(F.regexp_replace(s, NOT_WORD, " ")))
    cut = F.filter(cut, lambda s: F.length(s) > 2)
    table = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])

    def name(s: Column) -> Column:
        found = F.try_element_at(table, s)
        for ident, pattern in PATTERNS.items():
            found = F.coalesce(found, F.when(s.rlike(pattern), ident))
        return F.concat(F.lit("<"), F.coalesce(found, F.lit("")), F.lit(">"))

    return F.regexp_replace(F.array_join(F.transform(cut, name), ""), "(<>)+", "<>")


def scan_licences(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``licences`` (comma-joined, each once, in order), ``n_known`` (known sentences, the larger of
    the two cuts) and ``sequence`` (identifiers of the cut by lines, gaps as ``<>``).

    Null and empty texts, and texts without a known sentence, have no licence, count 0 and an empty sequence. The work is one narrow
    pass; repeated rows are scanned alike, other columns are ignored, an empty table gives an empty result.
    """
    lower = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    maybe = F.col("low").rlike(ANCHOR_CC)
    for word in ANCHOR_WORDS:
        maybe = maybe | F.contains(F.col("low"), F.lit(word))
    rows = docs.select(F.col(key).alias("id"), lower.alias("low")).withColumn("maybe", maybe)
    seq = lambda by_line: F.when(F.col("maybe"), _sequence(F.col("low"), by_line)).otherwise(F.lit(""))
    rows = rows.select("id", seq(True).alias("lines"), seq(False).alias("wrapped"))
    pattern = "|".join(re.escape(x) for x in rule_table())
    rules = F.create_map(*[F.lit(x) for pair in rule_table().items() for x in pair])
    found = F.concat(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(0)) for c in ("lines", "wrapped")])
    known = [F.regexp_count(F.col(c), F.lit("<[^>]+>")) for c in ("lines", "wrapped")]
    sequence = F.when(F.col("lines").rlike("<[^>]"), F.col("lines")).otherwise(F.lit(""))
    return rows.select(F.col("id").alias(key), F.array_join(F.array_distinct(F.transform(found, lambda m: F.element_at(rules, m))), ",").alias("licences"),
                       F.greatest(*known).cast("bigint").alias("n_known"), sequence.alias("sequence"))


def licence_sql() -> str:
    """The scan of ``documents`` in DuckDB SQL, without ``NO_END`` and with ``ANCHORS`` on the raw text: it knows less of wrapped texts."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    mapping = lambda d: "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"
    named = "coalesce(" + ", ".join([f"{mapping(known_sentences())}[s]", *(f"CASE WHEN regexp_matches(s, {q(p)}) THEN {q(i)} END" for i, p in PATTERNS.items()), "''"]) + ")"

    def seq(by_line: bool) -> str:
        body = f"regexp_replace(low, {q(LINE_HEAD)}, '', 'g')"
        body = f"regexp_replace({body}, {q(SENTENCE_END)}, concat('\\1', chr(1)), 'g')"
        body = f"regexp_replace({body}, {q(BLANK_LINE) if not by_line else 'chr(10)'}, chr(1), 'g')"
        cut = f"list_filter([trim(regexp_replace(x, {q(NOT_WORD)}, ' ', 'g')) FOR x IN string_split({body}, chr(1))], lambda x: length(x) > 2)"
        return f"CASE WHEN maybe THEN regexp_replace(array_to_string(['<' || {named} || '>' FOR s IN {cut}], ''), '(<>)+', '<>', 'g') ELSE '' END"

    maybe = " OR ".join(f"contains(low, {q(a)})" for a in ANCHORS)
    pattern = q("|".join(re.sub(r"([.])", r"\\\1", x) for x in rule_table()))
    hits = f"list_concat(regexp_extract_all(lines, {pattern}), regexp_extract_all(wrapped, {pattern}))"
    # DuckDB keeps no order in list_distinct: an item stays where its first occurrence is
    names = f"[{mapping(rule_table())}[m] FOR m IN {hits}]"
    return f"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), b AS (SELECT doc_id, low, {maybe} AS maybe FROM a),
    c AS (SELECT doc_id, {seq(True)} AS lines, {seq(False)} AS wrapped FROM b), d AS (SELECT doc_id, lines, wrapped, {names} AS names FROM c)
    SELECT doc_id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licences,
      CAST(greatest(len(regexp_extract_all(lines, '<[^>]+>')), len(regexp_extract_all(wrapped, '<[^>]+>'))) AS BIGINT) AS n_known,
      CASE WHEN regexp_matches(lines, '<[^>]') THEN lines ELSE '' END AS sequence FROM d"""
