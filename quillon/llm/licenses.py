"""License scans, native: map normalised sentences to known licence sentences, then match their sequence against ordered rules.

A text is lower-cased and reduced to its letters and digits with single spaces. Sentences end after . ! ? before white space, at
blank lines and around list marks. Licence texts are wrapped at any column and their notices often stand on lines of their own, so
a known sentence may also begin and end at a line end or after ; or : before white space, and may run over these. Sentences
that are known become identifiers, the longest first where several begin at one place; the others are passed over. A rule is a
sequence of identifiers; it matches where its identifiers stand next to each other, in order, in the document's sequence.
Rules are in order: the more special first. Everything is DataFrame expressions in the document's own row, without shuffle.

The columns rules and licenses name every rule of the short list (RULES) that matches, mentions within longer ones too. detected is the verdict:
ORDERED_RULES take the identifiers that they match, so that a whole licence text counts as that licence alone.

n_sentences counts sentences that end at each line end. The SQL compares whole lines' sentences with SENTENCES alone; it gives the same
rows where no notice is wrapped or cut at ; or :, and nothing of MORE_SENTENCES, MORE_RULES and the families of names occurs.

Cases: a null or empty text has no sentences and no licence ('' in both lists); repeated rows are scanned alike, each on its own; long texts are
scanned whole; if rules tie on a licence it is named once; an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

#: Identifier: sentence, normalised. Fixed values, from the licences' own wording and the usual notices.
SENTENCES = {
    "MIT-NAME": "released under the mit license",
    "MIT-NAME-2": "licensed under the mit license",
    "MIT-TITLE": "the mit license",
    "MIT-GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-NOTICE": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-AS-IS": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "APACHE-NAME": "licensed under the apache license version 2 0",
    "APACHE-LONG": "licensed under the apache license version 2 0 the license",
    "APACHE-USE": "you may not use this file except in compliance with the license",
    "APACHE-COPY": "you may obtain a copy of the license at",
    "GPL3-NAME": "this work is licensed under the gnu general public license version 3",
    "GPL-FREE": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL-HOPE": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "CC-BY-NC": "licensed under cc by nc 4 0",
    "CC-BY": "licensed under cc by 4 0",
    "CC-BY-SA": "licensed under cc by sa 4 0",
    "CC0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "BSD-NAME": "released under the bsd license",
    "BSD-USE": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "RESERVED": "all rights reserved",
}
#: Rule, licence, sequence of identifiers; in order.
RULES = (
    ("mit-full", "MIT", ("MIT-GRANT", "MIT-NOTICE", "MIT-AS-IS")),
    ("mit-grant", "MIT", ("MIT-GRANT",)),
    ("mit-named", "MIT", ("MIT-NAME",)),
    ("mit-named-2", "MIT", ("MIT-NAME-2",)),
    ("mit-title", "MIT", ("MIT-TITLE",)),
    ("apache-header", "Apache-2.0", ("APACHE-LONG", "APACHE-USE")),
    ("apache-long", "Apache-2.0", ("APACHE-LONG",)),
    ("apache-named", "Apache-2.0", ("APACHE-NAME",)),
    ("gpl3-header", "GPL-3.0", ("GPL-FREE", "GPL-HOPE")),
    ("gpl3-named", "GPL-3.0", ("GPL3-NAME",)),
    ("bsd-full", "BSD", ("RESERVED", "BSD-USE")),
    ("bsd-use", "BSD", ("BSD-USE",)),
    ("bsd-named", "BSD", ("BSD-NAME",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("CC-BY-NC",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("CC-BY-SA",)),
    ("cc-by", "CC-BY-4.0", ("CC-BY",)),
    ("cc0", "CC0-1.0", ("CC0",)),
    ("reserved", "Proprietary", ("RESERVED",)),
)
#: What only the scan knows, after the others. Fixed values as well, from the public texts of the licences.
MORE_SENTENCES = {
    "MIT-TITLE-2": "mit license",
    "MIT-LIABLE": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSD-SOURCE": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-BINARY": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-ADVERTISE": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BSD-NEITHER": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-AS-IS": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BSD-LIABLE": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "ISC-USE": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-USE-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0BSD-USE": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-AS-IS": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ZLIB-AS-IS": "this software is provided as is without any express or implied warranty",
    "ZLIB-USE": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "BSL-USE": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "UNLICENSE-FREE": "this is free and unencumbered software released into the public domain",
    "UNLICENSE-USE": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "APACHE-TITLE": "apache license",
    "APACHE-DATE": "version 2 0 january 2004",
    "GPL2-FREE": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "LGPL21-FREE": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPL3-FREE": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AGPL3-FREE": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LIBRARY-HOPE": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPL-TITLE": "gnu general public license",
    "LGPL-TITLE": "gnu lesser general public license",
    "AGPL-TITLE": "gnu affero general public license",
    "GNU3-DATE": "version 3 29 june 2007",
    "AGPL3-DATE": "version 3 19 november 2007",
    "GPL2-DATE": "version 2 june 1991",
    "LGPL21-DATE": "version 2 1 february 1999",
    "GNU-VERBATIM": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "MPL2-FORM": "this source code form is subject to the terms of the mozilla public license v",
    "MPL2-TITLE": "mozilla public license version 2 0",
    "CC0-TITLE": "cc0 1 0 universal",
}
#: Rules that the columns rules and licenses know besides: patterns of the sequence.
MORE_RULES = (("mit-title-2", "MIT", " MIT-TITLE-2 "), ("gpl3-free", "GPL-3.0", " GPL-FREE (?!GPL-HOPE )"))
#: Kinds of the one licence family whose names follow from parts, and names that stand behind a licence tag.
_CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
_TAGGED = ("MIT", "ISC", "0BSD", "Zlib", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "Unlicense", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower())


def _family() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules that follow from names: a notice and a title of each CC licence, a tag of each name with its endings."""
    sentences, rules = {}, []
    for kind, words in _CC.items():
        own = {f"CC-{kind}-NOTICE": f"this work is licensed under a creative commons {words} 4 0 international license", f"CC-{kind}-NOTICE-2": f"this work is licensed under the creative commons {words} 4 0 international license", f"CC-{kind}-TITLE": f"{words} 4 0 international"}
        sentences |= own
        rules += [(f"CC-{kind}-4.0", [i]) for i in own]
    for name in (*_TAGGED, *(f"CC-{k}-4.0" for k in _CC)):
        for i, end in enumerate(("", "-only", "-or-later") if "GPL" in name else ("",)):
            sentences[f"TAG-{name}-{i}"] = f"spdx license identifier {_plain(name + end)}"
            rules.append((name, [f"TAG-{name}-{i}"]))
    return sentences, rules


_FAMILY, _FAMILY_RULES = _family()
_BSD = ["BSD-USE", "BSD-SOURCE", "BSD-BINARY"]
_BSD_END = ["BSD-AS-IS?", "BSD-LIABLE?"]
#: Licence and sequence of identifiers, those with ? if they are there. In order: a rule takes the identifiers that it matches, wherever they
#: stand, and the later ones see only what is left.
ORDERED_RULES = (
    ("MIT", ["MIT-TITLE?", "MIT-TITLE-2?", "RESERVED?", "MIT-GRANT", "MIT-NOTICE?", "MIT-AS-IS?", "MIT-LIABLE?"]),
    ("BSD-4-Clause", ["RESERVED?", *_BSD, "BSD-ADVERTISE", "BSD-NEITHER?", *_BSD_END]),
    ("BSD-3-Clause", ["RESERVED?", *_BSD, "BSD-NEITHER", *_BSD_END]),
    ("BSD-2-Clause", ["RESERVED?", *_BSD, *_BSD_END]),
    ("BSD", ["RESERVED?", "BSD-USE", *_BSD_END]),
    ("ISC", ["ISC-USE", "ISC-AS-IS?"]),
    ("ISC", ["ISC-USE-2", "ISC-AS-IS?"]),
    ("0BSD", ["0BSD-USE", "ISC-AS-IS?"]),
    ("Zlib", ["ZLIB-AS-IS?", "ZLIB-USE"]),
    ("BSL-1.0", ["BSL-USE", "MIT-AS-IS?"]),
    ("Unlicense", ["UNLICENSE-FREE", "UNLICENSE-USE?", "MIT-AS-IS?", "MIT-LIABLE?"]),
    ("Apache-2.0", ["APACHE-TITLE", "APACHE-DATE"]),
    ("Apache-2.0", ["APACHE-LONG", "APACHE-USE?", "APACHE-COPY?"]),
    ("Apache-2.0", ["APACHE-NAME", "APACHE-USE?", "APACHE-COPY?"]),
    ("AGPL-3.0", ["AGPL-TITLE", "AGPL3-DATE", "GNU-VERBATIM?"]),
    ("LGPL-3.0", ["LGPL-TITLE", "GNU3-DATE", "GNU-VERBATIM?"]),
    ("LGPL-2.1", ["LGPL-TITLE", "LGPL21-DATE", "GNU-VERBATIM?"]),
    ("GPL-3.0", ["GPL-TITLE", "GNU3-DATE", "GNU-VERBATIM?"]),
    ("GPL-2.0", ["GPL-TITLE", "GPL2-DATE", "GNU-VERBATIM?"]),
    ("GPL-3.0", ["GPL-FREE", "GPL-HOPE?"]),
    ("GPL-2.0", ["GPL2-FREE", "GPL-HOPE?"]),
    ("LGPL-2.1", ["LGPL21-FREE", "LIBRARY-HOPE?"]),
    ("LGPL-3.0", ["LGPL3-FREE", "LIBRARY-HOPE?"]),
    ("AGPL-3.0", ["AGPL3-FREE", "GPL-HOPE?"]),
    ("GPL-3.0", ["GPL3-NAME"]),
    ("MPL-2.0", ["MPL2-FORM"]),
    ("MPL-2.0", ["MPL2-TITLE"]),
    ("CC0-1.0", ["CC0-TITLE?", "CC0"]),
    ("CC0-1.0", ["CC0-TITLE"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA"]),
    ("CC-BY-4.0", ["CC-BY"]),
    *_FAMILY_RULES,
    ("MIT", ["MIT-NAME"]),
    ("MIT", ["MIT-NAME-2"]),
    ("MIT", ["MIT-TITLE"]),
    ("MIT", ["MIT-TITLE-2"]),
    ("BSD", ["BSD-NAME"]),
)
_KNOWN = SENTENCES | MORE_SENTENCES | _FAMILY
#: Each known sentence between ends, over single line ends.
_ANY = r"(?<![^\n])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in sorted(_KNOWN.values(), key=len, reverse=True)) + r")(?![^\n])"
#: Replacements by which a text gets two line ends at the end of a sentence, and one where a sentence may end.
_ENDS = (
    (r"(?m)^[\x20\x09]*(?:[-+\u2022]|\(?(?:[0-9]{1,2}|[a-z])\))[\x20\x09]+", "\n\n"),
    (r"[.!?][\x20\x09-\x0D]+", "\n\n"),
    (r"[;:](?:[\x20\x09\x0B-\x0D]+\n?|\n)", "\n"),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" ?\n ?", "\n"),
)


def known_sentences(text: Column) -> Column:
    """The known sentences of a text, normalised and in order."""
    for pattern, end in _ENDS:
        text = F.regexp_replace(text, pattern, end)
    found = F.regexp_extract_all(F.trim(text), F.lit(_ANY), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "\n", " "))


def _pattern(ids: list[str]) -> str:
    return "".join(f"(<{i[:-1]}>)?" if i.endswith("?") else f"<{i}>" for i in ids)


def detected(ids: Column) -> Column:
    """The licences that the ordered rules find in a sequence of identifiers; Proprietary where all there is is that rights are reserved."""
    row = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">"))
    for license, rule in ORDERED_RULES:
        row = F.regexp_replace(row, _pattern(rule), f"{{{license}}}")
    found = lambda r: F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(r, F.lit(r"\{[^}]+\}"), F.lit(0)), lambda x: F.translate(x, "{}", ""))), ";")
    result = F.transform(F.array(row), lambda r: F.when(r.contains("{"), found(r)).when(r.contains("<RESERVED>"), F.lit("Proprietary")).otherwise(F.lit("")))
    return F.when(F.size(ids) == 0, F.lit("")).otherwise(F.element_at(result, 1))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; none for null."""
    cut = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?][\x20\x09-\x0D]+", "\n")
    plain = F.regexp_replace(cut, r"[^\p{L}\p{N}\n]+", " ")
    return F.array_remove(F.split(plain, " ?\n[ \n]*| $|^ "), "")


def scan(text: Column) -> Column:
    """Struct of n_sentences, n_known, sequence (identifiers in order), rules and licenses (all that match, in the rules' order), and detected."""

    def of(found: Column) -> Column:
        known = known_sentences(F.lower(F.coalesce(text, F.lit(""))))
        names = F.create_map(*[F.lit(x) for k, v in _KNOWN.items() for x in (v, k)])

        def matched(ids: Column) -> Column:
            row = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
            hit = lambda rule: row.rlike(rule[2]) if isinstance(rule[2], str) else row.contains(f" {' '.join(rule[2])} ")
            hits = lambda k: F.filter(F.array(*[F.when(hit(r), F.lit(r[k])) for r in RULES + MORE_RULES]), lambda x: x.isNotNull())
            return F.struct(
                F.size(found).cast("long").alias("n_sentences"),
                F.size(ids).cast("long").alias("n_known"),
                F.array_join(ids, " ").alias("sequence"),
                F.when(F.size(ids) == 0, F.lit("")).otherwise(F.array_join(hits(0), ";")).alias("rules"),
                F.when(F.size(ids) == 0, F.lit("")).otherwise(F.array_join(F.array_distinct(hits(1)), ";")).alias("licenses"),
                detected(ids).alias("detected"),
            )

        return F.element_at(F.transform(F.array(F.transform(known, lambda s: F.element_at(names, s))), matched), 1)

    return F.element_at(F.transform(F.array(sentences(text)), of), 1)


def scan_documents(docs: DataFrame, text: str = "text", into: str = "license") -> DataFrame:
    """Adds the struct column `into` of scan; a column of that name is replaced."""
    return docs.withColumn(into, scan(F.col(text)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_documents(docs).select("doc_id", "license.*")


def _sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    rules = ", ".join(f"({i}, '{r}', '{n}', ' {' '.join(ids)} ')" for i, (r, n, ids) in enumerate(RULES))
    consumed = "'<' || replace(sequence, ' ', '><') || '>'"
    for license, rule in ORDERED_RULES:
        consumed = f"regexp_replace({consumed}, '{_pattern(rule)}', '{{{license}}}', 'g')"
    return rf"""
WITH known(id, sentence) AS (VALUES {known}), rules(o, rule, license, ids) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?][\x20\x09-\x0D]+', chr(10), 'g'),
      '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n[ \n]*| $|^ '), lambda x: x <> '') AS s FROM documents),
e AS (SELECT rid, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM d),
q AS (SELECT rid, string_agg(id, ' ' ORDER BY i) AS sequence, count(*) AS n FROM e JOIN known USING (sentence) GROUP BY rid),
m AS (SELECT rid, o, rule, license FROM q JOIN rules ON contains(' ' || sequence || ' ', ids)),
f AS (SELECT rid, license, min(o) AS o FROM m GROUP BY ALL),
r AS (SELECT rid, string_agg(rule, ';' ORDER BY o) AS rules FROM m GROUP BY rid),
l AS (SELECT rid, string_agg(license, ';' ORDER BY o) AS licenses FROM f GROUP BY rid),
c AS (SELECT rid, taken, regexp_extract_all(taken, '\{{([^}}]+)\}}', 1) AS found FROM (SELECT rid, {consumed} AS taken FROM q)),
v AS (SELECT rid, CASE WHEN len(found) > 0 THEN array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ';') WHEN contains(taken, '<RESERVED>') THEN 'Proprietary' ELSE '' END AS detected FROM c)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(n, 0)::BIGINT AS n_known, coalesce(sequence, '') AS sequence, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses, coalesce(detected, '') AS detected
FROM d LEFT JOIN q USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid) LEFT JOIN v USING (rid)
"""


ORACLE_SQL = {"op10_license_scan": _sql()}
