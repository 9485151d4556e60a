"""Licences recognised sentence by sentence: known sentences to identifiers, sequences of identifiers to rules.

DataFrame functions only. :func:`scan_sql` says the same result another way: word by word, from sentence to sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences, the identifier of a sentence that names one, the names it goes by, its short tags.
LICENSES = [
    ("Apache-2.0", "ApacheRef", ["apache license version 2.0", "apache license 2.0"], ["apache-2.0"]),
    ("GPL-3.0-or-later", "GPL3LaterRef", ["gnu general public license version 3 or later"], ["gpl-3.0-or-later", "gpl-3.0+"]),
    ("GPL-2.0-or-later", "GPL2LaterRef", ["gnu general public license version 2 or later"], ["gpl-2.0-or-later", "gpl-2.0+"]),
    ("GPL-3.0", "GPL3Ref", ["gnu general public license version 3", "gnu gpl version 3"], ["gpl-3.0-only", "gpl-3.0"]),
    ("GPL-2.0", "GPL2Ref", ["gnu general public license version 2", "gnu gpl version 2"], ["gpl-2.0-only", "gpl-2.0"]),
    ("LGPL-3.0", "LGPL3Ref", ["gnu lesser general public license version 3"], ["lgpl-3.0-only", "lgpl-3.0"]),
    ("LGPL-2.1", "LGPL21Ref", ["gnu lesser general public license version 2.1"], ["lgpl-2.1-only", "lgpl-2.1"]),
    ("AGPL-3.0", "AGPL3Ref", ["gnu affero general public license version 3"], ["agpl-3.0-only", "agpl-3.0"]),
    ("MPL-2.0", "MPL2Ref", ["mozilla public license version 2.0", "mozilla public license 2.0"], ["mpl-2.0"]),
    ("Unlicense", "UnlicenseRef", ["unlicense"], ["unlicense"]),
    ("MIT", "MITRef", ["mit license"], ["mit"]),
    ("ISC", "ISCRef", ["isc license"], ["isc"]),
    ("BSD-3-Clause", "BSD3Ref", ["bsd 3-clause license", "3-clause bsd license"], ["bsd-3-clause"]),
    ("BSD-2-Clause", "BSD2Ref", ["bsd 2-clause license", "2-clause bsd license"], ["bsd-2-clause"]),
    ("Zlib", "ZlibRef", ["zlib license"], ["zlib"]),
    ("BSL-1.0", "BoostRef", ["boost software license version 1.0"], ["bsl-1.0"]),
    ("EPL-2.0", "EPL2Ref", ["eclipse public license version 2.0", "eclipse public license 2.0"], ["epl-2.0"]),
    ("CC-BY-4.0", "CCBYRef", ["cc by 4.0", "creative commons attribution 4.0 international license"], ["cc-by-4.0"]),
    (
        "CC-BY-SA-4.0",
        "CCBYSARef",
        ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"],
        ["cc-by-sa-4.0"],
    ),
    (
        "CC-BY-NC-4.0",
        "CCBYNCRef",
        ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"],
        ["cc-by-nc-4.0"],
    ),
    ("CC0-1.0", "CC0Ref", ["cc0 1.0", "creative commons cc0 1.0 universal license"], ["cc0-1.0"]),
]
# How a licence is named, with or without an article before the name.
STATEMENTS = [
    "licensed under",
    "released under",
    "distributed under",
    "available under",
    "this project is licensed under",
    "this software is licensed under",
    "this work is licensed under",
]
ARTICLES = ["", "the ", "a "]
TAG = "spdx-license-identifier"

# Sentences of well-known licences, normalised as the texts are, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "ApacheCopy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission": "BSDNames",
    "this program is free software": "FreeProgram",
    "this library is free software": "FreeLibrary",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
    " software foundation either version 3 of the license or at your option any later version": "GPL3Later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
    " software foundation either version 2 of the license or at your option any later version": "GPL2Later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the"
    " free software foundation either version 2.1 of the license or at your option any later version": "LGPL21Later",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL2Ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseRef",
    "all rights reserved": "AllRights",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an"
    " as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it"
    " and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and"
    " accompanying documentation covered by this license": "BoostGrant",
    **{
        f"{statement} {article}{name}": identifier
        for _, identifier, names, _ in LICENSES
        for name in names
        for statement in STATEMENTS
        for article in ARTICLES
    },
    **{f"{TAG} {tag}": identifier for _, identifier, _, tags in LICENSES for tag in tags},
}
# Rules in order; the first that matches takes its identifiers, so longer ones come first.
RULES = [
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("ISC", ["ISCGrant"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDNames"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy"]),
    ("GPL-3.0-or-later", ["FreeProgram", "GPL3Later"]),
    ("GPL-2.0-or-later", ["FreeProgram", "GPL2Later"]),
    ("LGPL-2.1-or-later", ["FreeLibrary", "LGPL21Later"]),
    ("Zlib", ["ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    *[(name, [identifier]) for name, identifier, _, _ in LICENSES],
    ("Proprietary", ["AllRights"]),
]
# Words between two sentences of one rule at most: marks of a list, a line about the copyright.
MAX_GAP = 12
_APART = " | "
# A text without any of these has no known sentence. No blank in them, so that no line end comes between.
_HINTS = ["licen", "permission", "warranty", "redistribut", "software", "reserved", "gpl", "cc0", "4.0"]
# Where a sentence may end, and where it must.
_CUT, _BREAK = "\u0002", "\u0003"
_STOP = "([.!?:;])[ \\t\\r\\n\\f]+"
_BLANK_LINE = "\\n[ \\t\\r\\f]*\\n"
# What a word is made of; dots, pluses and hyphens only count inside, pluses also at the end.
_LETTERS = "a-z0-9.+-"
# Known sentences between two places where one may end, the longest first; stops within them may be such places too.
_KNOWN = (
    f"(?:^|[{_CUT}{_BREAK}]) *("
    + "|".join(s.replace(".", "\\.").replace("+", "\\+").replace(" ", f"[ {_CUT}]+") for s in sorted(SENTENCES, key=len, reverse=True))
    + f")(?= *(?:\\z|[{_CUT}{_BREAK}]))"
)


def _marked(text: Column) -> Column:
    """Words in lower case, with one space between, and with marks where a sentence may end, with a line or a stop, and
    where it must, with a paragraph."""
    plain = F.regexp_replace(F.translate(text, _CUT + _BREAK, "  "), _BLANK_LINE, _BREAK)
    cut = F.replace(F.regexp_replace(plain, _STOP, "$1" + _CUT), F.lit("\n"), F.lit(_CUT))
    words = F.regexp_replace(F.lower(cut), f"[^{_CUT}{_BREAK}{_LETTERS}]+", " ")
    words = F.regexp_replace(words, f"(?<![{_LETTERS}])[.+-]++", "")
    words = F.regexp_replace(words, f"(?<![.-])[.-]++(?![{_LETTERS}])", "")
    return F.regexp_replace(words, "  +", " ")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences stated in every text.

    Returns one row per row of ``docs``: ``id_col``, ``sentence_ids`` (identifiers of the known sentences in order,
    joined by spaces), ``licenses`` (names of the matching rules in the order of :data:`RULES`, each once, joined by commas)
    and ``unmatched`` (identifiers that no rule took). The sentences of a rule follow each other with no other known sentence
    and no more than :data:`MAX_GAP` words between two. A sentence may end with a line or a stop,
    and may run over both, but not over a blank line; of those that start at a place the longest counts, and the
    next is looked for behind it. Marks of comments are no words. Null and empty texts give empty strings. Repeated rows each give a
    row; other columns are not looked at. Map only: the sentences are a small fixed table.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    hinted = None
    for hint in _HINTS:
        hinted = F.contains(low, F.lit(hint)) if hinted is None else hinted | F.contains(low, F.lit(hint))

    text = _marked(F.col("text"))
    found = F.regexp_extract_all(text, F.lit(_KNOWN), F.lit(1))
    ids = F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, f"[ {_CUT}]+", " ")))
    # Words before each sentence found; a mark keeps rules from reaching over too many of them.
    gaps = F.transform(F.split(text, _KNOWN, -1), lambda t: F.regexp_count(t, F.lit(f"[{_LETTERS}]+")))
    found = source.select(F.col(id_col), F.when(hinted, F.arrays_zip(ids.alias("id"), gaps.alias("gap"))).alias("found"))
    known_ids = F.filter("found", lambda f: f["id"].isNotNull())
    found = found.select(
        F.col(id_col),
        F.coalesce(F.array_join(F.transform(known_ids, lambda f: f["id"]), " "), F.lit("")).alias("sentence_ids"),
        F.array_join(
            F.transform(
                known_ids, lambda f: F.concat(F.when(f["gap"] > MAX_GAP, _APART).otherwise(""), F.lit(" "), f["id"], F.lit(" "))
            ),
            "",
        ).alias("_rest"),
    )

    rest, taken = F.col("_rest"), []
    for name, sequence in RULES:
        pattern = F.lit(" " + "  ".join(sequence) + " ")
        taken.append(F.when(F.contains(rest, pattern), F.lit(name)))
        # What a rule took still stands between its neighbours.
        rest = F.replace(rest, pattern, F.lit(_APART))
    # The rules of most rows, which have no sentence, aren't looked at.
    some = F.col("sentence_ids") != ""
    licenses = F.when(some, F.array_join(F.array_distinct(F.array_compact(F.array(*taken))), ","))
    unmatched = F.when(some, F.trim(F.regexp_replace(rest, "[ |]+", " ")))
    return found.select(
        F.col(id_col),
        "sentence_ids",
        F.coalesce(licenses, F.lit("")).alias("licenses"),
        F.coalesce(unmatched, F.lit("")).alias("unmatched"),
    )


def scan_sql() -> str:
    """The SQL that the query over ``documents`` must equal: words with their places, the longest known sentence at each
    place, from the end of one to the next."""
    table = ", ".join(f"('{sentence}', '{i}')" for sentence, i in SENTENCES.items())
    plain = rf"regexp_replace(translate(text, chr(2) || chr(3), '  '), '\n[ \t\r\f]*\n', chr(3), 'g')"
    cut = rf"replace(regexp_replace({plain}, '([.!?:;])[ \t\r\n\f]+', '\1' || chr(2), 'g'), chr(10), chr(2))"
    words = f"regexp_replace(lower({cut}), '[^' || chr(2) || chr(3) || '{_LETTERS}]+', ' ', 'g')"
    words = rf"regexp_replace({words}, '(^|[^{_LETTERS}])[.+-]+', '\1', 'g')"
    words = rf"regexp_replace({words}, '[.-]+([^{_LETTERS}]|$)', '\1', 'g')"
    units = f"string_split(replace(replace({words}, chr(2), ' ' || chr(2) || ' '), chr(3), ' ' || chr(3) || ' '), ' ')"
    steps = ""
    for i, (name, sequence) in enumerate(RULES):
        pattern = "' " + "  ".join(sequence) + " '"
        source = f"r{i - 1}" if i else "line_up"
        steps += (
            f", r{i} AS (SELECT doc_id, sentence_ids, replace(rest, {pattern}, '{_APART}') AS rest,"
            f" CASE WHEN contains(rest, {pattern}) THEN list_append(names, '{name}') ELSE names END AS names FROM {source})"
        )
    return rf"""
    WITH RECURSIVE known(sentence, id) AS (VALUES {table}),
    ends_of AS (SELECT DISTINCT l[1] AS first, l[-1] AS last, len(l) AS n FROM (SELECT string_split(sentence, ' ') AS l FROM known)),
    units AS (
      SELECT doc_id, u, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
        SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {units} AS l FROM documents))
      WHERE u <> ''
    ), placed AS (
      SELECT doc_id, u, u NOT IN (chr(2), chr(3)) AS is_word,
        count(*) FILTER (u = chr(3)) OVER d AS para, count(*) FILTER (u NOT IN (chr(2), chr(3))) OVER d AS w,
        coalesce(lag(u) OVER d IN (chr(2), chr(3)), true) AS begins, coalesce(lead(u) OVER d IN (chr(2), chr(3)), true) AS ends
      FROM units WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), words AS MATERIALIZED (SELECT * FROM placed WHERE is_word),
    spans AS MATERIALIZED (
      SELECT s.doc_id, s.w AS lo, e.w AS hi FROM words s JOIN ends_of k ON s.u = k.first AND s.begins
      JOIN words e ON e.doc_id = s.doc_id AND e.w = s.w + k.n - 1 AND e.u = k.last AND e.para = s.para AND e.ends
    ), cut_out AS MATERIALIZED (
      SELECT doc_id, lo, hi, string_agg(u, ' ' ORDER BY w) AS sentence FROM spans JOIN words USING (doc_id)
      WHERE w BETWEEN lo AND hi GROUP BY ALL
    ), sentences AS MATERIALIZED (
      SELECT doc_id, lo, max(hi) AS hi, arg_max(id, hi) AS id FROM cut_out JOIN known USING (sentence) GROUP BY doc_id, lo
    ), found(doc_id, k, lo, hi, id, gap) AS (
      SELECT DISTINCT doc_id, 0, 0::BIGINT, 0::BIGINT, '', 0::BIGINT FROM sentences UNION ALL
      SELECT f.doc_id, max(f.k) + 1, min(s.lo), arg_min(s.hi, s.lo), arg_min(s.id, s.lo), min(s.lo) - max(f.hi) - 1
      FROM found f JOIN sentences s ON s.doc_id = f.doc_id AND s.lo > f.hi GROUP BY f.doc_id
    ), line_up AS (
      SELECT doc_id, string_agg(id, ' ' ORDER BY k) AS sentence_ids, CAST([] AS VARCHAR[]) AS names,
        string_agg(CASE WHEN gap > {MAX_GAP} THEN '{_APART}' ELSE '' END || ' ' || id || ' ', '' ORDER BY k) AS rest
      FROM found WHERE k > 0 GROUP BY doc_id
    ){steps}
    SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids,
      coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses,
      coalesce(trim(regexp_replace(rest, '[ |]+', ' ', 'g')), '') AS unmatched
    FROM documents LEFT JOIN r{len(RULES) - 1} USING (doc_id)"""
