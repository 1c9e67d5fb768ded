"""Licence scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences and normalised, in which comment signs and list numbers vanish; known licence sentences become
identifiers, and unknown sentences between them gaps; ordered rules are matched against the sequence, in which the
identifiers of a rule must stand side by side. A rule that matches takes its identifiers out of the sequence, so that
later, shorter rules see what is left. Everything happens within a row: there is no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence sentences and the identifiers that rules use; fixed texts of public licences.
SENTENCES = {
    "MIT_REF": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
                "SPDX-License-Identifier: MIT", "License: MIT"],
    "MIT_GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MIT_NOTICE": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MIT_WARRANTY": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "MIT0_GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
    "MIT_LIABILITY": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "APACHE_REF": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License");'],
    "APACHE_COMPLY": ["you may not use this file except in compliance with the License."],
    "APACHE_OBTAIN": ["You may obtain a copy of the License at"],
    "APACHE_BASIS": ['You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
                     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "APACHE_URL": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "APACHE_SEE": ["See the License for the specific language governing permissions and limitations under the License."],
    "GPL3_REF": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
                 "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL3_LATER_REF": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL2_REF": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL3_GRANT": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL2_FREE": ["This program is free software;"],
    "GPL2_MODIFY": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "GPL2_LATER": ["either version 2 of the License, or (at your option) any later version."],
    "LGPL3_GRANT": [f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." for what in ("program", "library")],
    "AGPL3_GRANT": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL_FREE": ["This library is free software;"],
    "LGPL_MODIFY": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "LGPL21_LATER": ["either version 2.1 of the License, or (at your option) any later version."],
    "GPL_HOPE": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "LGPL_HOPE": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "LGPL_DETAILS": ["See the GNU Lesser General Public License for more details."],
    "AGPL_DETAILS": ["See the GNU Affero General Public License for more details."],
    "GPL_MERCHANT": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GPL_DETAILS": ["See the GNU General Public License for more details."],
    "LGPL_REF": ["SPDX-License-Identifier: LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL_REF": ["SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."],
    "CC_BY_NC_REF": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC_BY_REF": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC_BY_SA_REF": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0_REF": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD_GRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD_SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD_BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD_ENDORSE": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD_WARRANTY": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "BSD_LIABLE": [f"IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;" for who in ("HOLDER", "HOLDERS", "OWNER")],
    "BSD_LOSS": ["LOSS OF USE, DATA, OR PROFITS;"],
    "BSD_HOWEVER": ["OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "BSD3_REF": ["SPDX-License-Identifier: BSD-3-Clause"],
    "BSD2_REF": ["SPDX-License-Identifier: BSD-2-Clause"],
    "ISC_GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "ZEROBSD_GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "ISC_WARRANTY": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "ISC_LIABILITY": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "ISC_REF": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License."],
    "ZLIB_WARRANTY": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZLIB_LIABILITY": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "ZLIB_GRANT": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "ZLIB_ORIGIN": ["The origin of this software must not be misrepresented;"],
    "ZLIB_CLAIM": ["you must not claim that you wrote the original software."],
    "ZLIB_CREDIT": ["If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
                    "If you use this software in a product, an acknowledgement in the product documentation would be appreciated but is not required."],
    "ZLIB_ALTERED": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "ZLIB_NOTICE": ["This notice may not be removed or altered from any source distribution."],
    "ZLIB_REF": ["SPDX-License-Identifier: Zlib"],
    "BSL_GRANT": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "BSL_NOTICE": ["The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."],
    "BSL_WARRANTY": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.'],
    "BSL_REF": ["SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0."],
    "PG_GRANT": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "WTFPL_COPY": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "WTFPL_DO": ["You just DO WHAT THE FUCK YOU WANT TO."],
    "EPL2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
             "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EPL2_REF": ["SPDX-License-Identifier: EPL-2.0"],
    "OFL_REF": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "MPL2_REF": ["This Source Code Form is subject to the terms of the Mozilla Public License, v.", "SPDX-License-Identifier: MPL-2.0"],
    "MPL2_COPY": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                  "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "UNLICENSE_ANYONE": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "ALL_RIGHTS": ["All rights reserved."],
}
# Ordered rules: the licence and the identifiers that it is made of, longer rules before their parts.
RULES = [
    ("Apache-2.0", ["APACHE_REF", "APACHE_COMPLY", "APACHE_OBTAIN", "APACHE_URL", "APACHE_BASIS", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_REF", "APACHE_COMPLY", "APACHE_OBTAIN", "APACHE_BASIS", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_REF", "APACHE_COMPLY", "APACHE_BASIS", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_REF", "APACHE_COMPLY"]),
    ("Apache-2.0", ["APACHE_REF"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY", "MIT_LIABILITY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("MIT-0", ["MIT0_GRANT", "MIT_WARRANTY", "MIT_LIABILITY"]),
    ("MIT-0", ["MIT0_GRANT"]),
    ("MIT", ["MIT_REF"]),
    ("BSL-1.0", ["BSL_GRANT", "BSL_NOTICE", "BSL_WARRANTY"]),
    ("BSL-1.0", ["BSL_GRANT", "BSL_NOTICE"]),
    ("BSL-1.0", ["BSL_REF"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_WARRANTY", "BSD_LIABLE", "BSD_LOSS", "BSD_HOWEVER"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_WARRANTY", "BSD_LIABLE", "BSD_LOSS", "BSD_HOWEVER"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("BSD-3-Clause", ["BSD3_REF"]),
    ("BSD-2-Clause", ["BSD2_REF"]),
    ("GPL-3.0-or-later", ["GPL3_GRANT", "GPL_HOPE", "GPL_MERCHANT", "GPL_DETAILS"]),
    ("LGPL-3.0-or-later", ["LGPL3_GRANT", "LGPL_HOPE", "GPL_MERCHANT", "LGPL_DETAILS"]),
    ("LGPL-3.0-or-later", ["LGPL3_GRANT", "GPL_HOPE", "GPL_MERCHANT", "LGPL_DETAILS"]),
    ("AGPL-3.0-or-later", ["AGPL3_GRANT", "GPL_HOPE", "GPL_MERCHANT", "AGPL_DETAILS"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL2_MODIFY", "GPL2_LATER", "GPL_HOPE", "GPL_MERCHANT", "GPL_DETAILS"]),
    ("LGPL-2.1-or-later", ["LGPL_FREE", "LGPL_MODIFY", "LGPL21_LATER", "LGPL_HOPE", "GPL_MERCHANT", "LGPL_DETAILS"]),
    ("GPL-3.0-or-later", ["GPL3_GRANT"]),
    ("LGPL-3.0-or-later", ["LGPL3_GRANT"]),
    ("AGPL-3.0-or-later", ["AGPL3_GRANT"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL2_MODIFY", "GPL2_LATER"]),
    ("LGPL-2.1-or-later", ["LGPL_FREE", "LGPL_MODIFY", "LGPL21_LATER"]),
    ("GPL-3.0-or-later", ["GPL3_LATER_REF"]),
    ("GPL-3.0", ["GPL3_REF"]),
    ("GPL-2.0", ["GPL2_REF"]),
    ("LGPL-3.0", ["LGPL_REF"]),
    ("AGPL-3.0", ["AGPL_REF"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC_REF"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA_REF"]),
    ("CC-BY-4.0", ["CC_BY_REF"]),
    ("CC0-1.0", ["CC0_REF"]),
    ("ISC", ["ISC_GRANT", "ISC_WARRANTY", "ISC_LIABILITY"]),
    ("0BSD", ["ZEROBSD_GRANT", "ISC_WARRANTY", "ISC_LIABILITY"]),
    ("ISC", ["ISC_GRANT"]),
    ("0BSD", ["ZEROBSD_GRANT"]),
    ("ISC", ["ISC_REF"]),
    ("Zlib", ["ZLIB_WARRANTY", "ZLIB_LIABILITY", "ZLIB_GRANT", "ZLIB_ORIGIN", "ZLIB_CLAIM", "ZLIB_CREDIT", "ZLIB_ALTERED", "ZLIB_NOTICE"]),
    ("Zlib", ["ZLIB_GRANT", "ZLIB_ORIGIN", "ZLIB_CLAIM"]),
    ("Zlib", ["ZLIB_REF"]),
    ("PostgreSQL", ["PG_GRANT"]),
    ("WTFPL", ["WTFPL_COPY"]),
    ("WTFPL", ["WTFPL_DO"]),
    ("MPL-2.0", ["MPL2_REF", "MPL2_COPY"]),
    ("MPL-2.0", ["MPL2_REF"]),
    ("EPL-2.0", ["EPL2"]),
    ("EPL-2.0", ["EPL2_REF"]),
    ("OFL-1.1", ["OFL_REF"]),
    ("Unlicense", ["UNLICENSE", "UNLICENSE_ANYONE"]),
    ("Unlicense", ["UNLICENSE"]),
    ("All-rights-reserved", ["ALL_RIGHTS"]),
]
#: What ends a sentence before white space, and sentences that say nothing (numbers of lists).
ENDS = r"([.!?;]|conditions:|are met:|restrictions:|following:)[ \t\r\n]+"
NOTHING = 3
#: Words that tell the beginning of a known sentence, and the least words of sentences that may be wrapped.
OPENING, WRAPPED = 4, 6
#: Letters of a word that a text is searched for by itself, and words searched for together where a sentence has no such word.
TELLING, TOGETHER = 5, 3


def normalised_sentences(text: str) -> list[str]:
    """Sentences of a known text, cut and normalised as the columns below do it."""
    low = re.sub(ENDS, r"\1" + "\n", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return [s for s in (x.strip(" ") for x in re.sub(r"[^a-z0-9\n]+", " ", low).split("\n")) if s]


def known(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Identifier by normalised sentence; each text must be one sentence."""
    out: dict[str, str] = {}
    for name, texts in sentences.items():
        for t in texts:
            (sentence,) = normalised_sentences(t)
            out[sentence] = name
    return out


def openings(sentences: dict[str, list[str]]) -> str:
    """A pattern of the first words of the longer sentences and of copyright lines, without those found within another sentence."""
    normalised = [s for texts in sentences.values() for t in texts for s in normalised_sentences(t)]
    first = {" ".join(s.split()[:OPENING]) for s in normalised if len(s.split()) >= WRAPPED}
    first = {o for o in first if not any(f" {o} " in s for s in normalised)}
    return "|".join(["copyright[^a-z0-9\\n]+(?:c[^a-z0-9]|[0-9])", *("[^a-z0-9]+".join(o.split()) for o in sorted(first))])


def anchors(normalised) -> list[list[str]]:
    """Few words such that each normalised sentence has all words of one entry; mostly entries of one word."""
    left, out = [s.split() for s in sorted(normalised)], []
    while left:
        n = Counter(w for words in left for w in set(words) if len(w) >= TELLING)
        entry = [max(n, key=lambda w: (n[w], len(w), w))] if n else sorted(set(left[0]), key=lambda w: (-len(w), w))[:TOGETHER]
        out.append(entry)
        left = [words for words in left if not set(entry) <= set(words)]
    return out


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, by_line string, by_sentence string, licenses array) for each row.

    Sentences are read twice: with line ends as sentence ends, and as wrapped texts, with line ends as spaces except at blank
    lines, before copyright lines and before lines that begin like a known sentence (titles and notices above a text thus
    stay apart from it). by_line and by_sentence: the identifiers found, joined by `|`, `-` where unknown sentences stand before,
    between or after them; empty if there are none. licenses: those of both readings, each once, by name. Null and empty texts have
    none; whole texts of any length are read; repeated rows and null ids stay; extra columns, whatever their names, are ignored.

    A word of a known sentence stands in the text as it is, but for its case: texts without any entry of anchors have no known sentence
    in either reading, which is that of empty texts, so they are not cut up.
    """
    ids = known(sentences or SENTENCES)
    rules = rules or RULES
    lookup = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    may_have = reduce(or_, (reduce(and_, (F.contains("lower", F.lit(w)) for w in words)) for words in anchors(ids)), F.lit(False))
    ended = lambda t: F.regexp_replace(t, ENDS, "$1\n")
    split = lambda t: F.transform(F.split(F.regexp_replace(t, r"[^a-z0-9\n]+", " "), "\n"), lambda x: F.trim(x))
    blank = F.regexp_replace("low", r"\n[^a-z0-9\n]*\n", "\u0001")
    opened = F.regexp_replace(blank, rf"\n([^a-z0-9\n\x01]*)({openings(sentences or SENTENCES)})", "\u0001$1$2")
    wrapped = F.translate(opened, "\n\u0001", " \n")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.lower("text").alias("lower"))
    read = texts.select("doc_id", F.when(may_have, low).otherwise("").alias("low")).select("doc_id", split(ended(F.col("low"))).alias("lines"), split(ended(wrapped)).alias("wrapped"))

    def identified(c: str):
        found = F.transform(F.filter(c, lambda x: F.length(x) > NOTHING), lambda x: F.when(x.isin(list(ids)), lookup[x]).otherwise("-"))
        joined = F.regexp_replace(F.array_join(found, "|"), r"(?:-\|)+", "-|")
        return F.when(F.exists(c, lambda x: x.isin(list(ids))), joined).otherwise("").alias({"lines": "by_line", "wrapped": "by_sentence"}[c])

    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(parts) + "|").alias("ids")) for name, parts in rules])
    start = lambda seq: F.struct(F.concat(F.lit("|"), F.replace(seq, F.lit("|"), F.lit("||")), F.lit("|")).alias("seq"), F.array().cast("array<string>").alias("names"))

    def apply(acc, rule):
        there = F.contains(acc["seq"], rule["ids"])
        return F.struct(
            F.when(there, F.replace(acc["seq"], rule["ids"], F.lit("|-|"))).otherwise(acc["seq"]).alias("seq"),
            F.when(there, F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"),
        )

    names = lambda c: F.when(F.col(c) != "", F.aggregate(table, start(F.col(c)), apply, lambda acc: acc["names"])).otherwise(F.array().cast("array<string>"))
    read = read.select("doc_id", identified("lines"), identified("wrapped"))
    return read.select("doc_id", "by_line", "by_sentence", F.array_sort(F.array_union(names("by_line"), names("by_sentence"))).alias("licenses"))


def op5_license_scan(docs: DataFrame) -> DataFrame:
    """Identifiers of both readings and licences, comma-joined; edge cases as in scan."""
    return scan(docs).select(
        "doc_id", F.col("by_line").alias("identifiers"), F.col("by_sentence").alias("wrapped_identifiers"), F.array_join("licenses", ",").alias("licenses")
    )


def oracle_sql() -> str:
    """The same in SQL, which normalises the known sentences by itself."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    raw = ", ".join(f"({q(t)}, {q(i)})" for i, texts in SENTENCES.items() for t in texts)
    low = "translate(coalesce(cast(text as varchar), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ends = ENDS.replace("\\t\\r\\n", "\t\r\n")
    ended = lambda t: f"regexp_replace({t}, '{ends}', '\\1' || chr(10), 'g')"
    split = lambda t: f"list_transform(string_split(regexp_replace({t}, '[^a-z0-9\n]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))"
    blank = "regexp_replace(low, '\n[^a-z0-9\n]*\n', chr(1), 'g')"
    wrapped = f"translate(regexp_replace({blank}, '\n([^a-z0-9\n\x01]*)({openings(SENTENCES)})', chr(1) || '\\1\\2', 'g'), chr(10) || chr(1), ' ' || chr(10))"
    found = lambda c: (
        f"case when list_has_any({c}, map_keys(m)) then regexp_replace(array_to_string(list_transform(list_filter({c}, "
        f"lambda x: length(x) > {NOTHING}), lambda x: coalesce(m[x], '-')), '|'), '(?:-\\|)+', '-|', 'g') else '' end"
    )
    ctes, source = [], "r"
    for column, p in (("by_line", "a"), ("by_sentence", "b")):
        ctes.append(f"{p}s0 as (select *, '|' || replace({column}, '|', '||') || '|' {p}0 from {source})")
        source = f"{p}s0"
        for i, (_, parts) in enumerate(RULES):
            ctes.append(f"{p}s{i + 1} as (select *, replace({p}{i}, {q('|' + '||'.join(parts) + '|')}, '|-|') {p}{i + 1} from {source})")
            source = f"{p}s{i + 1}"
    names = ", ".join(f"case when a{i} <> a{i + 1} or b{i} <> b{i + 1} then {q(n)} end" for i, (n, _) in enumerate(RULES))
    return f"""
with k as (select map_from_entries(list((trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), i))) m from (values {raw}) v(t, i)),
l as (select doc_id, {low} low from documents),
s as (select doc_id, {split(ended("low"))} lines, {split(ended(wrapped))} wrapped from l),
r as (select doc_id, {found("lines")} by_line, {found("wrapped")} by_sentence from s, k),
{", ".join(ctes)}
select doc_id, by_line identifiers, by_sentence wrapped_identifiers,
    coalesce(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))), ','), '') licenses from {source}
"""
