"""Licence scans by sentence rules.

Sentences of a text that stand in a table of known licence sentences, compared as lower-case words of a-z
and 0-9, become that sentence's identifier; others become nothing. The identifiers of a text, in order, are matched against licence rules in the order of ``RULES``: a rule
is a run of identifiers; where it matches, the run is used up and the rule's licence is reported.
Identifiers that no rule uses are reported as left over.

A sentence may begin and end at ``. ! ? ; :`` with white space behind it, at a line without letter or
digit, and at a line break before a capital letter, digit, bullet or comment sign. Of these places only
the line without letter or digit must be one: a known sentence may run on over stops that stand inside
it, over wrapped lines and over comment signs before them. Of two known sentences that begin at one
place the longer is taken. Everything is built-in column functions over one scan: no join, shuffle or
Python. The SQL beside it cuts at every such place, so it holds for sentences within one line.

Defined cases: null and empty texts have no sentence and no licence (empty strings, 0). Repeated rows
and null ids are scanned like others. Other columns are ignored. Long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect.llm.common import needed

# Sentences of published licences and notices, with identifiers of our own.
SENTENCES: list[tuple[str, str]] = [
    ("mitShort", "Released under the MIT License."),
    ("mitLicensed", "Licensed under the MIT License."),
    ("mitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("asIsSoftware", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apacheShort", "Licensed under the Apache License, Version 2.0."),
    ("apacheHead", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apacheComply", "you may not use this file except in compliance with the License."),
    ("apacheCopy", "You may obtain a copy of the License at"),
    ("apacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apacheSee", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl3Short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2Short", "This work is licensed under the GNU General Public License, version 2."),
    ("gplFree", "This program is free software"),
    ("gpl3Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("lgplLater", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gplHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gplImplied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gplSee", "See the GNU General Public License for more details."),
    ("lgpl21Later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("agplLater", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgplSee", "See the GNU Lesser General Public License for more details."),
    ("agplSee", "See the GNU Affero General Public License for more details."),
    ("bsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mplHead", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("iscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("iscGrantAnd", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zeroBsdGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boostShort", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicenseUse", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicenseHead", "This is free and unencumbered software released into the public domain under no license."),
    ("ccByShort", "Licensed under CC BY 4.0."),
    ("ccBySaShort", "Licensed under CC BY-SA 4.0."),
    ("ccByNcShort", "Licensed under CC BY-NC 4.0."),
    ("ccByWork", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ccBySaWork", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccByNcWork", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("spdxMit", "SPDX-License-Identifier: MIT"),
    ("spdxApache", "SPDX-License-Identifier: Apache-2.0"),
    ("spdxBsd2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("spdxBsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("spdxIsc", "SPDX-License-Identifier: ISC"),
    ("spdxMpl", "SPDX-License-Identifier: MPL-2.0"),
    ("spdxGpl2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("spdxGpl2Later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("spdxGpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("spdxGpl3Later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("spdxLgpl21Later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("spdxLgpl3Later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("spdxAgpl3", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("spdxAgpl3Later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("spdxCc0", "SPDX-License-Identifier: CC0-1.0"),
    ("spdxUnlicense", "SPDX-License-Identifier: Unlicense"),
    ("spdxZlib", "SPDX-License-Identifier: Zlib"),
    ("spdxBoost", "SPDX-License-Identifier: BSL-1.0"),
]

#: Tried in this order: longer runs of a licence before shorter ones.
RULES: list[tuple[str, str]] = [
    ("MIT", "mitGrant mitNotice asIsSoftware"),
    ("MIT", "mitGrant mitNotice"),
    ("Apache-2.0", "apacheHead apacheComply apacheCopy apacheAsIs apacheSee"),
    ("Apache-2.0", "apacheHead apacheComply apacheCopy"),
    ("Apache-2.0", "apacheHead apacheComply"),
    ("GPL-3.0-or-later", "gplFree gpl3Later gplHope gplImplied gplSee"),
    ("GPL-2.0-or-later", "gplFree gpl2Later gplHope gplImplied gplSee"),
    ("LGPL-3.0-or-later", "gplFree lgplLater gplHope gplImplied lgplSee"),
    ("LGPL-2.1-or-later", "gplFree lgpl21Later gplHope gplImplied lgplSee"),
    ("AGPL-3.0-or-later", "gplFree agplLater gplHope gplImplied agplSee"),
    ("LGPL-3.0-or-later", "gplFree lgplLater"),
    ("LGPL-2.1-or-later", "gplFree lgpl21Later"),
    ("AGPL-3.0-or-later", "gplFree agplLater"),
    ("GPL-3.0-or-later", "gplFree gpl3Later"),
    ("GPL-2.0-or-later", "gplFree gpl2Later"),
    ("BSD-3-Clause", "bsdGrant bsdSource bsdBinary bsdEndorse"),
    ("BSD-2-Clause", "bsdGrant bsdSource bsdBinary"),
    ("ISC", "iscGrant"),
    ("ISC", "iscGrantAnd"),
    ("0BSD", "zeroBsdGrant"),
    ("Zlib", "zlibGrant"),
    ("MPL-2.0", "mplHead"),
    ("Unlicense", "unlicense unlicenseUse"),
    ("Unlicense", "unlicense"),
    ("Unlicense", "unlicenseHead"),
    ("MIT", "mitShort"),
    ("MIT", "mitLicensed"),
    ("MIT", "spdxMit"),
    ("Apache-2.0", "apacheShort"),
    ("Apache-2.0", "apacheHead"),
    ("Apache-2.0", "spdxApache"),
    ("BSL-1.0", "boostShort"),
    ("BSD-2-Clause", "spdxBsd2"),
    ("BSD-3-Clause", "spdxBsd3"),
    ("ISC", "spdxIsc"),
    ("MPL-2.0", "spdxMpl"),
    ("GPL-2.0-only", "spdxGpl2"),
    ("GPL-2.0-or-later", "spdxGpl2Later"),
    ("GPL-3.0-only", "spdxGpl3"),
    ("GPL-3.0-or-later", "spdxGpl3Later"),
    ("LGPL-2.1-or-later", "spdxLgpl21Later"),
    ("LGPL-3.0-or-later", "spdxLgpl3Later"),
    ("AGPL-3.0-only", "spdxAgpl3"),
    ("AGPL-3.0-or-later", "spdxAgpl3Later"),
    ("CC0-1.0", "spdxCc0"),
    ("Unlicense", "spdxUnlicense"),
    ("Zlib", "spdxZlib"),
    ("BSL-1.0", "spdxBoost"),
    ("GPL-3.0-only", "gpl3Short"),
    ("GPL-2.0-only", "gpl2Short"),
    ("CC-BY-4.0", "ccByShort"),
    ("CC-BY-4.0", "ccByWork"),
    ("CC-BY-SA-4.0", "ccBySaShort"),
    ("CC-BY-SA-4.0", "ccBySaWork"),
    ("CC-BY-NC-4.0", "ccByNcShort"),
    ("CC-BY-NC-4.0", "ccByNcWork"),
]

BLANK = "[ \\t\\r\\n\\f]"
AFTER_STOP = f"([.!?;]){BLANK}+"
EMPTY_LINE = f"\\n{BLANK}*\\n"
BEFORE_START = "\\n([ \\t]*[A-Z0-9*#/(-])"
MARK = "\x01"
# Marks of the scan: a stop or line break where a sentence may end, and a line where each must end.
ANY_STOP = f"[.!?;:](?={BLANK})"
WORDLESS_LINE = "\n(?:[^A-Za-z0-9\n]*\n)+"
COMMENT_WORD = "(?m)^([ \t]*)(?:dnl|rem|REM)[ \t]"
BREAK = "\x02"


def _pieces(sentence: str) -> list[str]:
    """The normalised pieces that a known sentence is cut into (one, unless a stop stands inside)."""
    parts = re.sub(AFTER_STOP, r"\1" + MARK, sentence).split(MARK)
    return [p for p in (re.sub("[^a-z0-9]+", " ", part.lower()).strip() for part in parts) if p]


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known(sentences: list[tuple[str, str]]) -> tuple[dict[str, str], str]:
    """Normalised whole sentence to identifier, and the expression that finds them in a marked text."""
    out: dict[str, str] = {}
    for name, sentence in sentences:
        if out.setdefault(_plain(sentence), name) != name:
            raise ValueError(f"{name} and {out[_plain(sentence)]} are the same sentence")
    gap = f"[ {MARK}]++"
    choices = "|".join(gap.join(words.split()) for words in sorted(out, key=len, reverse=True))
    return out, f"(?:^|[{MARK}{BREAK}]) *+({choices})(?= *+(?:\\z|[{MARK}{BREAK}]))"


def _table(sentences: list[tuple[str, str]]) -> dict[str, str]:
    """Normalised piece to identifier: of a sentence with a stop inside, its longest piece."""
    out: dict[str, str] = {}
    for name, sentence in sentences:
        piece = max(_pieces(sentence), key=len)
        if out.setdefault(piece, name) != name:
            raise ValueError(f"{name} and {out[piece]} are the same sentence")
    return out


def sentence_ids(text: Column, sentences: list[tuple[str, str]] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    table, pattern = _known(sentences)
    marked = F.regexp_replace(F.regexp_replace(text, COMMENT_WORD, "$1"), WORDLESS_LINE, f"{BREAK}\n")
    marked = F.regexp_replace(F.regexp_replace(marked, ANY_STOP, MARK), BEFORE_START, f"{MARK}$1")
    marked = F.regexp_replace(F.lower(marked), f"[^a-z0-9{MARK}{BREAK}]+", F.lit(" "))
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.try_element_at(known, F.regexp_replace(x, f"[ {MARK}]+", F.lit(" "))))


def licences(ids: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """``found`` (licences in rule order, each once) and ``left`` (unused identifiers) of a text's identifiers."""
    wrapped = F.concat(F.lit("  "), F.array_join(ids, "  "), F.lit("  "))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("  " + "  ".join(run.split()) + "  ").alias("run")) for name, run in rules])
    start = F.struct(wrapped.alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["run"])
        found = F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"])
        return F.struct(F.replace(state["left"], rule["run"], F.lit("    ")).alias("left"), found.alias("found"))

    def result(state: Column) -> Column:
        left = F.trim(F.regexp_replace(state["left"], " +", F.lit(" ")))
        return F.struct(F.array_distinct(state["found"]).alias("found"), left.alias("left"))

    return F.aggregate(listed, start, apply, result)


def scan(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """doc_id, sentence_ids, licences (joined by a space), n_sentences and left_over of every row."""
    ids = needed(docs, "doc_id", "text").select("doc_id", F.coalesce(sentence_ids(F.col("text"), sentences), F.array().cast("array<string>")).alias("ids"))
    none = F.struct(F.array().cast("array<string>").alias("found"), F.lit("").alias("left"))
    judged = ids.select("doc_id", "ids", F.when(F.size("ids") > 0, licences(F.col("ids"), rules)).otherwise(none).alias("r"))
    return judged.select(
        "doc_id",
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join("r.found", " ").alias("licences"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.col("r.left").alias("left_over"),
    )


def sql(sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> str:
    table = ", ".join(f"('{piece}', '{name}')" for piece, name in _table(sentences).items())
    steps = []
    for k, (name, run) in enumerate(rules):
        seek = "  " + "  ".join(run.split()) + "  "
        steps.append(
            f"r{k + 1} AS (SELECT doc_id, ids, REPLACE(rest, '{seek}', '    ') AS rest, "
            f"CASE WHEN CONTAINS(rest, '{seek}') AND NOT LIST_CONTAINS(found, '{name}') THEN LIST_APPEND(found, '{name}') ELSE found END AS found FROM r{k})"
        )
    mark = "chr(1)"
    return f"""
WITH known(piece, name) AS (VALUES {table}), pieces AS (
  SELECT doc_id, k, TRIM(REGEXP_REPLACE(LOWER(p[k]), '[^a-z0-9]+', ' ', 'g')) AS piece FROM (
    SELECT doc_id, p, UNNEST(RANGE(1, LEN(p) + 1)) AS k FROM (
      SELECT doc_id, STRING_SPLIT(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(text, '{AFTER_STOP}', '\\1' || {mark}, 'g'),
        '{EMPTY_LINE}', {mark}, 'g'), '{BEFORE_START}', {mark} || '\\1', 'g'), {mark}) AS p FROM documents)))
, named AS (
  SELECT doc_id, LIST(name ORDER BY k) AS ids FROM pieces JOIN known USING (piece) GROUP BY doc_id
), r0 AS (
  SELECT d.doc_id, COALESCE(ids, []) AS ids, '  ' || COALESCE(ARRAY_TO_STRING(ids, '  '), '') || '  ' AS rest, []::VARCHAR[] AS found
  FROM documents d LEFT JOIN named ON d.doc_id = named.doc_id
), {", ".join(steps)}
SELECT doc_id, ARRAY_TO_STRING(ids, ' ') AS sentence_ids, ARRAY_TO_STRING(found, ' ') AS licences,
  LEN(ids)::BIGINT AS n_sentences, TRIM(REGEXP_REPLACE(rest, ' +', ' ', 'g')) AS left_over
FROM r{len(rules)}
"""
