"""Licence recognition by rules over sequences of known sentences, in DataFrame functions only."""

from __future__ import annotations

import json
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
_GRANT = "is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
SENTENCES: dict[str, list[str]] = {
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission " + _GRANT],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-mention": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "isc-title": ["ISC License", "The ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-mention": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd2-mention": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd3-mention": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "apache2-mention": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl-any": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-any": ["This program is free software;", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl2-later": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "mpl2-mention": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense-open": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "rights-reserved": ["All rights reserved."],
} | {
    f"gpl{v}-mention": [f"This work is licensed under the GNU General Public License, version {v}.", f"Licensed under the GNU General Public License, version {v}.", f"SPDX-License-Identifier: GPL-{v}.0-only"] for v in (1, 2, 3)
} | {
    f"lgpl{v}-mention": [f"This work is licensed under the GNU Lesser General Public License, version {v}.", f"Licensed under the GNU Lesser General Public License, version {v}."] for v in ("2.1", "3")
} | {
    f"cc-{kind}-{v}-mention": [f"Licensed under CC {kind.upper()} {v}.", f"This work is licensed under CC {kind.upper()} {v}.", f"SPDX-License-Identifier: CC-{kind.upper()}-{v}"]
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
}

# Rules in their order; the first that fits at a place wins, so longer sequences come before their parts.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-title", "isc-grant"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-mention", "apache2-comply", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-mention", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-mention", "apache2-comply"]),
    ("GPL-3.0-or-later", ["gpl-any", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-any"]),
    ("GPL-2.0-or-later", ["gpl2-any", "gpl2-any", "gpl2-later", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-any", "gpl2-any", "gpl2-later"]),
    ("Unlicense", ["unlicense-open", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-open"]),
    ("MIT", ["mit-mention"]),
    ("ISC", ["isc-mention"]),
    ("BSD-2-Clause", ["bsd2-mention"]),
    ("BSD-3-Clause", ["bsd3-mention"]),
    ("Apache-2.0", ["apache2-mention"]),
    ("MPL-2.0", ["mpl2-mention"]),
    *[(f"GPL-{v}.0-only", [f"gpl{v}-mention"]) for v in (1, 2, 3)],
    *[(f"LGPL-{v if '.' in v else v + '.0'}-only", [f"lgpl{v}-mention"]) for v in ("2.1", "3")],
    *[(f"CC-{kind.upper()}-{v}", [f"cc-{kind}-{v}-mention"]) for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")],
]

#: Sentences that are not known may stand between two sentences of a rule, up to this many.
GAP = 2
#: Known texts as their licences' own notices wrap them, where a line begins with a capital letter.
WRAPPED = {"mpl2-mention": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."]}
#: A line that goes on in lower case continues the sentence; a sentence ends at a line's end or at these marks before white space.
WRAP, END = r"\n[ \t]*([a-z(])", r"[.;:!?]+[ \t\r]+|\n+"
#: Marks of a comment before a line's text; without them a sentence goes on over commented lines too.
COMMENT = r"\n[ \t]*(?:#+|//+|/?\*+|--+|;+|%+)[ \t]+"
#: A tag ends with its line, whatever the next one begins with.
TAG = r"((?i:SPDX-License-Identifier):[^\n]*)\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = "|"
BUCKETS = 256
#: The sign of an unknown sentence; known ones have a character of Unicode's private area each.
UNKNOWN, FIRST_SIGN = ".", 0xE000
#: Stands for each further piece of a known text that the marks of END split.
MORE = "~"


def normalise(sentence: str) -> str:
    """Lower-case ASCII letters and digits, everything else one space."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip()


def signs() -> dict[str, str]:
    """The character of each sentence identifier."""
    return {name: chr(FIRST_SIGN + i) for i, name in enumerate(SENTENCES)}


def sentence_signs() -> dict[str, str]:
    """The character of each known normalised sentence."""
    sign = signs()
    return {normalise(s): sign[name] for name, variants in SENTENCES.items() for s in variants}


def rule_table() -> dict[str, str]:
    """The licence of each sequence of characters."""
    sign = signs()
    return {"".join(sign[x] for x in sequence): name for name, sequence in reversed(RULES)}


def rule_pattern(after: str = "") -> str:
    """All rules as one ordered alternation; ``after`` may follow each known sentence."""
    sign = signs()
    between = f"[{UNKNOWN}]{{0,{GAP}}}"
    return "|".join(between.join(sign[x] + after for x in sequence) for _, sequence in RULES)


def pieces(text: str) -> list[str]:
    """What ``sentences`` makes of a text, in Python."""
    joined = re.sub(WRAP, r" \1", re.sub(TAG, r"\1\n\n", re.sub(COMMENT, "\n", text)))
    return [x for x in map(normalise, re.sub(END, _STOP, joined.replace(_STOP, " ")).split(_STOP)) if x]


def split_texts() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """The character of each piece of the known texts, and which sequences of characters are a known text of several pieces.

    A piece that is a known sentence itself keeps its character; the others have one each after those of the identifiers.
    """
    sign = signs()
    of_piece = {p[0]: sign[name] for name, variants in SENTENCES.items() for p in map(pieces, variants) if len(p) == 1}
    several = [(sign[name], p) for name, variants in [*SENTENCES.items(), *WRAPPED.items()] for p in map(pieces, variants) if len(p) > 1]
    for _, p in several:
        for piece in p:
            of_piece.setdefault(piece, chr(FIRST_SIGN + len(sign) + len(of_piece)))
    whole = [("".join(of_piece[x] for x in p), name + MORE * (len(p) - 1)) for name, p in several]
    return of_piece, sorted(whole, key=lambda w: -len(w[0]))


def sentences(text: Column) -> Column:
    """The normalised sentences of a text in order."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, "\n"), TAG, "$1\n\n")
    joined = F.regexp_replace(lines, WRAP, " $1")
    marked = F.regexp_replace(F.translate(joined, _STOP, " "), END, _STOP)
    plain = F.regexp_replace(F.translate(marked, _UPPER, _LOWER), "[^a-z0-9|]+", " ")
    return F.transform(F.split(plain, r"\|"), lambda s: F.trim(s))


def _lookup(found: Column, sentence: Column) -> Column:
    bucket = F.get(found, F.xxhash64(sentence).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int"))
    return F.coalesce(F.element_at(bucket, sentence), F.lit(UNKNOWN))


def signed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, signs)``: one character for each sentence, and MORE for each further piece of a known text."""
    of_piece, whole = split_texts()
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for sentence, sign in of_piece.items():
        buckets[xxhash.xxh64_intdigest(sentence.encode(), 42) % BUCKETS][sentence] = sign
    known = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    split = docs.select("doc_id", F.filter(sentences(F.col("text").cast("string")), lambda s: s != "").alias("s"))
    signed = split.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.element_at(F.transform(F.array(known), lambda k: F.transform("s", lambda s: _lookup(k, s))), 1), "").alias("signs"))
    parts = "".join(sorted(set(of_piece.values()) - set(signs().values())))
    joined = F.col("signs")
    for sequence, one in whole:
        joined = F.replace(joined, F.lit(sequence), F.lit(one))
    # a piece that stands alone is no known sentence
    return signed.withColumn("signs", F.when(F.col("signs").rlike(f"[{parts}]"), F.translate(joined, parts, UNKNOWN * len(parts))).otherwise(F.col("signs")))


def license_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, licenses, matches, n_matches, first_sentence, n_sentences)`` for every row of ``docs(doc_id, text)``.

    Each sentence of the whole text is mapped to the identifier of a known licence sentence; known texts that hold a sentence's end
    inside ("SPDX-License-Identifier: MIT") are split as the documents are and found as sequences. The sequence of identifiers is
    matched against RULES from left to right without overlap. ``matches`` has the licences in order of occurrence, ``licenses`` the
    distinct ones in alphabetical order, both comma-joined; ``first_sentence`` is the number (from 1) of the first matched
    sentence, 0 if none. Null and empty texts have no sentence and no match. Repeated rows and null doc_ids come out as they are;
    extra columns are ignored; an empty table gives an empty result. Rows are independent: nothing is shuffled.
    """
    rules = F.from_json(F.lit(json.dumps(rule_table())), "map<string,string>")
    signed = signed_texts(docs)
    hit = F.regexp_extract_all("signs", F.lit(rule_pattern(f"{MORE}*")), F.lit(0))
    named = signed.withColumn("hits", F.when(F.col("signs").rlike(f"[^{UNKNOWN}]"), hit).otherwise(F.array().cast("array<string>")))
    licence = F.transform("hits", lambda h: F.element_at(rules, F.translate(h, UNKNOWN + MORE, "")))
    out = named.withColumn("m", licence)
    return out.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("m")), ",").alias("licenses"),
        F.array_join("m", ",").alias("matches"),
        F.size("m").cast("long").alias("n_matches"),
        F.when(F.size("m") > 0, F.expr("locate(hits[0], signs)")).otherwise(0).cast("long").alias("first_sentence"),
        "n_sentences",
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = lambda d: "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in d.items()) + "}"
    return f"""
WITH split AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(regexp_replace(translate(
    regexp_replace(coalesce(text, ''), {quote(WRAP)}, ' \\1', 'g'), '|', ' '), {quote(END)}, '|', 'g'), {quote(_UPPER)}, {quote(_LOWER)}), '[^a-z0-9|]+', ' ', 'g'), '|'),
    lambda s: trim(s)), lambda s: s <> '') AS s FROM documents),
signed AS (
  SELECT doc_id, len(s) AS n_sentences, list_aggregate(list_transform(s, lambda x: coalesce(({pairs(sentence_signs())})[x], '{UNKNOWN}')), 'string_agg', '') AS signs FROM split),
named AS (
  SELECT *, regexp_extract_all(coalesce(signs, ''), {quote(rule_pattern())}) AS hits FROM signed),
final AS (
  SELECT *, list_transform(hits, lambda h: ({pairs(rule_table())})[replace(h, '{UNKNOWN}', '')]) AS m FROM named)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(m)), ','), '') AS licenses, coalesce(array_to_string(m, ','), '') AS matches,
  CAST(len(m) AS BIGINT) AS n_matches, CAST(CASE WHEN len(m) > 0 THEN instr(signs, hits[1]) ELSE 0 END AS BIGINT) AS first_sentence,
  CAST(n_sentences AS BIGINT) AS n_sentences
FROM final"""
