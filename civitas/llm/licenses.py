"""Licence scan by sentence rules.

Texts are cut into fragments at ends of lines and sentences, each normalised to lower-case letters
and digits. Known licence sentences become identifiers. Sentences of licence texts and titles are whole fragments, or several in
sequence (wrapped lines, marks inside the sentence, comment leaders). References to a licence by name ("licensed under the MIT License")
stand anywhere in a fragment, whatever their subject and tail, and so do tags ("SPDX-License-Identifier: MIT OR Apache-2.0"); a name that stands
alone in a fragment is a title. A text's identifiers, in order, are matched
against licence rules. A rule is a sequence of identifiers; other known sentences may stand
between them. Rules are ordered: of the rules of one licence the first that matches names it, and a rule
doesn't count where a longer one of another licence, which begins with its sentences, matches.
Everything happens in the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import documents

# Public licence sentences, normalised, by identifier.
SENTENCES = {
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "agpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl2-only": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "lgpl21-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "library-hope": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-neither": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "zlib-asis": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense-ref": ["this is free and unencumbered software released into the public domain"],
    "cc0-grant": ["this work is dedicated to the public domain"],
    "gpl3-title": ["gnu general public license version 3 29 june 2007"],
    "gpl2-title": ["gnu general public license version 2 june 1991"],
    "lgpl3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "agpl3-title": ["gnu affero general public license version 3 19 november 2007"],
    "apache-title": ["apache license version 2 0 january 2004"],
    "bsd4-ad": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense-use": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "wtfpl-text": ["you just do what the fuck you want to"],
}
# Licences by the identifier of a reference to them, and their names, normalised.
NAMES = {
    "apache-ref": ("Apache-2.0", ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache software license version 2 0", "apache 2 0 license", "apache 2 0"]),
    "mit-ref": ("MIT", ["mit license", "mit licence", "expat license", "mit"]),
    "bsd2-ref": ("BSD-2-Clause", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"]),
    "bsd-ref": ("BSD-3-Clause", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause", "bsd license"]),
    "bsd4-ref": ("BSD-4-Clause", ["bsd 4 clause license", "4 clause bsd license", "original bsd license", "bsd 4 clause"]),
    "0bsd-ref": ("0BSD", ["zero clause bsd license", "bsd zero clause license", "0bsd license", "0bsd"]),
    "isc-ref": ("ISC", ["isc license", "isc"]),
    "mpl-ref": ("MPL-2.0", ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"]),
    "mpl11-ref": ("MPL-1.1", ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"]),
    "epl2-ref": ("EPL-2.0", ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"]),
    "epl1-ref": ("EPL-1.0", ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"]),
    "cddl-ref": ("CDDL-1.0", ["common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl 1 0"]),
    "boost-ref": ("BSL-1.0", ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"]),
    "zlib-ref": ("Zlib", ["zlib license", "zlib libpng license", "zlib"]),
    "artistic-ref": ("Artistic-2.0", ["artistic license version 2 0", "artistic license 2 0", "artistic 2 0"]),
    "ofl-ref": ("OFL-1.1", ["sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1"]),
    "eupl-ref": ("EUPL-1.2", ["european union public license version 1 2", "european union public licence 1 2", "eupl version 1 2", "eupl 1 2"]),
    "psf-ref": ("PSF-2.0", ["python software foundation license version 2", "psf license", "psf 2 0"]),
    "ms-pl-ref": ("MS-PL", ["microsoft public license", "ms pl"]),
    "postgresql-ref": ("PostgreSQL", ["postgresql license", "postgresql"]),
    "ncsa-ref": ("NCSA", ["university of illinois ncsa open source license", "ncsa license", "ncsa"]),
    "wtfpl-ref": ("WTFPL", ["do what the fuck you want to public license", "wtfpl"]),
    "unlicense-name": ("Unlicense", ["unlicense license", "unlicense"]),
    "cc0-ref": ("CC0-1.0", ["creative commons zero v1 0 universal", "creative commons cc0 1 0 universal", "cc0 1 0 universal", "cc0 1 0"]),
    "cc-by-ref": ("CC-BY-4.0", ["creative commons attribution 4 0 international license", "creative commons attribution 4 0 international", "cc by 4 0"]),
    "cc-by-sa-ref": ("CC-BY-SA-4.0", ["creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international", "cc by sa 4 0"]),
    "cc-by-nc-ref": ("CC-BY-NC-4.0", ["creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international", "cc by nc 4 0"]),
    "cc-by-nd-ref": ("CC-BY-ND-4.0", ["creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0 international", "cc by nd 4 0"]),
    "cc-by-nc-sa-ref": ("CC-BY-NC-SA-4.0", ["creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike 4 0 international", "cc by nc sa 4 0"]),
    "cc-by-nc-nd-ref": ("CC-BY-NC-ND-4.0", ["creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives 4 0 international", "cc by nc nd 4 0"]),
}


def _gnu_names() -> dict[str, tuple[str, list[str]]]:
    """The GNU licences by rule: each long and short name with each version, alone, as the only one, or with later ones."""
    out = {}
    for short, long, versions in (("gpl", "general public license", ("2 0", "3 0")), ("lgpl", "lesser general public license", ("2 1", "3 0")), ("agpl", "affero general public license", ("3 0",))):
        for version in versions:
            forms = [v for v in dict.fromkeys((version, version.removesuffix(" 0"))) for v in (f" version {v}", f" {v}", f" v{v}", f"v{v}")]
            names = [base + form for base in (f"gnu {long}", f"gnu {short}", long, short) for form in forms]
            key, spdx = (short + version.replace(" 0", "").replace(" ", ""), f"{short.upper()}-{version.replace(' ', '.')}")
            out[f"{key}-ref"] = (spdx, names)
            out[f"{key}-only-ref"] = (f"{spdx}-only", [f"{n} only" for n in names])
            out[f"{key}-later-ref"] = (f"{spdx}-or-later", [f"{n} {later}" for n in names for later in ("or later", "or any later version", "or at your option any later version")])
    return out


#: What the names of the GNU licences look like; those of versions that there aren't name none.
GNU = "(?:gnu )?(?:(?:lesser |affero )?general public license|[la]?gpl) ?(?:version |v)?[0-9](?: [0-9])?(?: only| or later| or any later version| or at your option any later version)?"
_OTHERS = [n for _, names in NAMES.values() for n in names]
NAMES |= _gnu_names()
# Licences that come first, in order, and licence rules: licence, rule, identifiers in sequence.
_ORDER = "Apache-2.0 MIT GPL-3.0-or-later GPL-2.0-or-later GPL-2.0-only AGPL-3.0-or-later AGPL-3.0 LGPL-2.1-or-later LGPL-3.0-or-later GPL-3.0 GPL-2.0 LGPL-3.0 BSD-3-Clause BSD-2-Clause MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 ISC 0BSD Zlib EPL-2.0 BSL-1.0".split()
_RULES = (
    ("Apache-2.0", "apache-notice", ("apache-ref", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", "apache-text", ("apache-title",)),
    ("MIT", "mit-text", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", "gpl-notice", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", "gpl2-notice", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-only", "gpl2-only-notice", ("gpl2-only", "gpl-hope")),
    ("AGPL-3.0-or-later", "agpl-notice", ("agpl-free", "gpl-hope")),
    ("LGPL-2.1-or-later", "lgpl21-notice", ("lgpl21-free", "library-hope")),
    ("LGPL-3.0-or-later", "lgpl3-notice", ("lgpl3-free", "library-hope")),
    ("GPL-3.0", "gpl3-text", ("gpl3-title",)),
    ("GPL-2.0", "gpl2-text", ("gpl2-title",)),
    ("LGPL-3.0", "lgpl3-text", ("lgpl3-title",)),
    ("LGPL-2.1", "lgpl21-text", ("lgpl21-title",)),
    ("AGPL-3.0", "agpl3-text", ("agpl3-title",)),
    ("BSD-4-Clause", "bsd4-text", ("bsd-source", "bsd-binary", "bsd4-ad")),
    ("BSD-3-Clause", "bsd3-text", ("bsd-source", "bsd-binary", "bsd-neither")),
    ("BSD-2-Clause", "bsd2-text", ("bsd-source", "bsd-binary")),
    ("ISC", "isc-text", ("isc-grant",)),
    ("0BSD", "0bsd-text", ("0bsd-grant",)),
    ("Zlib", "zlib-text", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", "boost-text", ("boost-grant",)),
    ("Unlicense", "unlicense-text", ("unlicense-ref", "unlicense-use")),
    ("Unlicense", "unlicense-reference", ("unlicense-ref",)),
    ("WTFPL", "wtfpl-text", ("wtfpl-text",)),
    ("CC0-1.0", "cc0-dedication", ("cc0-grant",)),
    *((name, f"{key.removesuffix('-ref')}-reference" if key.endswith("-ref") else f"{key}-reference", (key,)) for key, (name, _) in NAMES.items()),
)
#: The rules in order of their licences; of one licence those of texts come before references.
RULES = tuple(sorted(_RULES, key=lambda r: _ORDER.index(r[0]) if r[0] in _ORDER else len(_ORDER)))
#: Rules of another licence that are longer and begin with a rule's sentences: where one matches, the rule doesn't count.
LONGER = {rule: [ids for other, _, ids in RULES if other != name and len(ids) > len(own) and ids[: len(own)] == own] for name, rule, own in RULES}

#: Where a fragment ends, and what between its words is one space.
ENDS, BETWEEN = r"[.!?;:]+(?:[ \t\r\n]+|$)|\n+", "[^a-z0-9]+"
#: Words that begin a comment line and are no part of its sentence.
LEADERS = "(?:(?:dnl|rem) )?"
# What a name follows in a reference and in a tag; a name after one that was just found; what makes a name a title.
REFERENCE = "(?:(?:licensed|relicensed|released|distributed|available|published|provided|covered|governed) (?:under|by)|subject to)(?: the terms(?: and conditions)? of)?(?: either)?(?: the| a| an)? "
TAG, ALSO = "spdx license identifier ", " (?:or|and) (?:the )?"
_BY_NAME = {n: key for key, (_, names) in NAMES.items() for n in names}
_ANY_NAME = "(?:" + "|".join([GNU, *sorted(_OTHERS, key=lambda n: (-len(n), n))]) + ")"
#: A title is a name after the word licence, or one that has this word.
_TITLE = f"(?:license {_ANY_NAME}|(?:the )?(?:{GNU}|" + "|".join(sorted((n for n in _OTHERS if "licen" in n), key=lambda n: (-len(n), n))) + "))"


def _wrapped(words: str) -> str:
    """A pattern of words that may be in several fragments."""
    return words.replace(" ", f"(?: |\n{LEADERS})")


#: A known sentence from the start of a fragment to the end of one, of two with the same start the longer; a title; a reference or tag; a further name.
KNOWN = (
    f"\n{LEADERS}(?:" + "|".join(_wrapped(s) for s in sorted((s for own in SENTENCES.values() for s in own), key=len, reverse=True)) + ")(?=\n)"
    f"|\n{LEADERS}{_wrapped(_TITLE)}(?=\n)|(?<=[ \n])(?:{_wrapped(REFERENCE)}|{_wrapped(TAG)}){_wrapped(_ANY_NAME)}(?=[ \n])|\\G{_wrapped(ALSO + _ANY_NAME)}(?=[ \n])"
)


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*(F.lit(x) for k, own in SENTENCES.items() for s in own for x in (s, k)), *(F.lit(x) for pair in _BY_NAME.items() for x in pair))
    # a line for each fragment
    cut = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, ENDS, "\n")), "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    found = F.regexp_extract_all(F.concat(F.lit("\n"), F.trim(cut), F.lit("\n")), F.lit(KNOWN), F.lit(0))
    plain = F.transform(found, lambda s: F.trim(F.regexp_replace(s, "\n" + LEADERS, " ")))
    named = lambda s: F.regexp_extract(F.concat(F.lit(" "), s), f"^(?: {REFERENCE}| {TAG}|{ALSO}| (?:license )?(?:the )?)({_ANY_NAME})$", 1)
    return F.array_compact(F.transform(plain, lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(known, named(s)))))


def rule_pattern(ids: tuple[str, ...]) -> str:
    return "," + ",(?:[^,]+,)*".join(ids) + ","


def _matches(joined: Column, rule: str, ids: tuple[str, ...]) -> Column:
    found = F.rlike(joined, F.lit(rule_pattern(ids)))
    for longer in LONGER[rule]:
        found = found & ~F.rlike(joined, F.lit(rule_pattern(longer)))
    return found


def licenses(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of ``docs`` as a struct), sentence_ids, licenses and rules (arrays).

    ``licenses`` are in the rules' order and distinct, each with its first matching rule in
    ``rules``. Null, empty and plain texts have empty arrays. Every row of ``docs`` gives a row, whatever
    its ids; an empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("doc"), sentence_ids(F.coalesce("text", F.lit(""))).alias("sentence_ids"))
    joined = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hits = F.array_compact(F.array(*(F.when(_matches(joined, rule, ids), F.struct(F.lit(name).alias("license"), F.lit(rule).alias("rule"))) for name, rule, ids in RULES)))
    none = F.expr("cast(array() as array<struct<license:string,rule:string>>)")
    rows = rows.withColumn("hits", F.when(F.size("sentence_ids") > 0, hits).otherwise(none))
    first = F.filter("hits", lambda x, i: ~F.exists(F.slice("hits", 1, i), lambda y: y["license"] == x["license"]))
    return rows.withColumn("hits", first).select("doc", "sentence_ids", F.col("hits.license").alias("licenses"), F.col("hits.rule").alias("rules"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc.doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("rules", ",").alias("rules"))


def _quoted(text: str) -> str:
    return f"'{text}'" if text else "NULL"


def _oracle() -> str:
    """Of sentences in one fragment, and names after one reference or tag, which are all that the given tables hold."""
    known = ", ".join(f"('{s}', '{k}')" for k, own in SENTENCES.items() for s in own)
    names = ", ".join(f"('{n}', '{k}')" for n, k in _BY_NAME.items())
    rules = ", ".join(f"({i}, '{name}', '{rule}', '{rule_pattern(ids)}', {_quoted('|'.join(map(rule_pattern, LONGER[rule])))})" for i, (name, rule, ids) in enumerate(RULES))
    reference = f" (?:{REFERENCE}|{TAG}){_ANY_NAME} "
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
known(s, k) AS (VALUES {known}), names(s, k) AS (VALUES {names}), rules(o, license, rule, p, longer) AS (VALUES {rules}),
cut AS (SELECT id, string_split_regex(text, '{ENDS}') AS parts FROM docs),
each AS (SELECT id, i, trim(regexp_replace(lower(parts[i]), '{BETWEEN}', ' ', 'g')) AS s FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
whole AS (SELECT id, i, 0 AS j, k FROM each JOIN known USING (s)),
title AS (SELECT id, i, 0 AS j, k FROM (SELECT id, i, regexp_extract(s, '^(?:license )?(?:the )?({_ANY_NAME})$', 1) AS s FROM each WHERE regexp_matches(s, '^{_TITLE}$')) JOIN names USING (s)),
inner_names AS (SELECT id, i, unnest(range(1, len(r) + 1)) AS j, r FROM (SELECT id, i, regexp_extract_all(' ' || s || ' ', '{reference}') AS r FROM each ANTI JOIN known USING (s)) WHERE len(r) > 0),
inside AS (SELECT id, i, j, k FROM (SELECT id, i, j, regexp_extract(r[j], '^ (?:{REFERENCE}|{TAG})({_ANY_NAME}) $', 1) AS s FROM inner_names) JOIN names USING (s)),
ids AS (SELECT id, count(*) AS n, string_agg(k, ',' ORDER BY i, j) AS ids FROM (FROM whole UNION ALL FROM title UNION ALL FROM inside) GROUP BY id),
hits AS (SELECT id, license, min(o) AS o, arg_min(rule, o) AS rule FROM ids JOIN rules ON regexp_matches(',' || ids || ',', p) AND (longer IS NULL OR NOT regexp_matches(',' || ids || ',', longer)) GROUP BY id, license),
named AS (SELECT id, string_agg(license, ',' ORDER BY o) AS licenses, string_agg(rule, ',' ORDER BY o) AS rules FROM hits GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(rules, '') AS rules
FROM docs LEFT JOIN ids USING (id) LEFT JOIN named USING (id)"""


ORACLE = _oracle()
