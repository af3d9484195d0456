"""Licence recognition by sentences and ordered rules (operator 5): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import table, whole

# Normalised licence sentences by identifier. Normalised: lower case, every run of other characters than a-z, 0-9 and
# letters beyond ASCII one space, ends trimmed. An identifier stands for all wordings of one statement. A * stands for a name of 1 to MOST_NAME words.
SENTENCES = {
    "apache-named": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "apache license version 2 0", "this project is licensed under the apache license version 2 0"),
    "apache-compliance": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"),
    "as-is": ("software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    "mit-named": ("released under the mit license", "licensed under the mit license", "the mit license", "mit license", "this project is licensed under the mit license", "distributed under the mit license", "released under the terms of the mit license", "licensed under the terms of the mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "no-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "isc-no-warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc-named": ("isc license", "licensed under the isc license"),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "gpl3-named": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3", "this program is licensed under the gnu general public license version 3"),
    "gpl3-later-named": ("gnu general public license version 3 or later", "licensed under the gnu general public license version 3 or later", "this program is licensed under the gnu general public license version 3 or later", "this work is licensed under the gnu general public license version 3 or later"),
    "gpl2-later-named": ("gnu general public license version 2 or later", "licensed under the gnu general public license version 2 or later", "this program is licensed under the gnu general public license version 2 or later", "this work is licensed under the gnu general public license version 2 or later"),
    "gpl2-named": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl3-only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    "gpl2-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl2-only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    "lgpl21-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "lgpl21-only": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1 as published by the free software foundation", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 2 1 of the license"),
    "lgpl3-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "lgpl3-only": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 3 of the license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3 as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3 as published by the free software foundation"),
    "agpl3-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "agpl3-only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license version 3 as published by the free software foundation"),
    "gpl-no-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    "bsd-named": ("licensed under the bsd 3 clause license", "released under the bsd license", "bsd 3 clause license", "3 clause bsd license", "licensed under the 3 clause bsd license"),
    "bsd2-named": ("licensed under the bsd 2 clause license", "bsd 2 clause license", "2 clause bsd license", "licensed under the 2 clause bsd license", "simplified bsd license"),
    "bsd-redistribution": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advertising": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-endorsement": ("neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission", "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-no-warranty": ("this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "zlib-no-warranty": ("this software is provided as is without any express or implied warranty",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "epl2-named": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0", "licensed under the eclipse public license version 2 0"),
    "epl1-named": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html", "licensed under the eclipse public license version 1 0"),
    "cc-by-named": ("this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "cc-by-sa-named": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "cc-by-nc-named": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "cc-by-nd-named": ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"),
    "cc-by-nc-sa-named": ("this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "licensed under cc by nc sa 4 0", "this work is licensed under cc by nc sa 4 0"),
    "cc-by-nc-nd-named": ("this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "licensed under cc by nc nd 4 0", "this work is licensed under cc by nc nd 4 0"),
    "cc0-named": ("this work is dedicated to the public domain", "released under cc0 1 0", "cc0 1 0 universal"),
    "mpl-named": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "all-rights": ("all rights reserved",),
}

# Ordered rules. Each is (licence, identifiers that must follow one another in this order; others may lie between).
# A text has the licences of all rules that match it, but for those of weaker_than(); the first is its main one.
RULES = (
    ("Apache-2.0", ("apache-named", "apache-compliance", "apache-copy", "as-is")),
    ("Apache-2.0", ("apache-named",)),
    ("MIT", ("mit-grant", "mit-notice", "no-warranty")),
    ("MIT", ("mit-named",)),
    ("BSL-1.0", ("boost-grant",)),
    ("ISC", ("isc-grant", "isc-no-warranty")),
    ("ISC", ("isc-named",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-no-warranty")),
    ("AGPL-3.0-only", ("agpl3-only", "gpl-no-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-no-warranty")),
    ("LGPL-3.0-only", ("lgpl3-only", "gpl-no-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "gpl-no-warranty")),
    ("LGPL-2.1-only", ("lgpl21-only", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-no-warranty")),
    ("GPL-3.0-only", ("gpl3-only", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-no-warranty")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl3-later-named",)),
    ("GPL-2.0-or-later", ("gpl2-later-named",)),
    ("GPL-3.0", ("gpl3-named",)),
    ("GPL-2.0", ("gpl2-named",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-redistribution",)),
    ("BSD-3-Clause", ("bsd-named",)),
    ("BSD-2-Clause", ("bsd2-named",)),
    ("Zlib", ("zlib-no-warranty", "zlib-grant")),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2-named",)),
    ("EPL-1.0", ("epl1-named",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-named",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-named",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-named",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-named",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-named",)),
    ("CC-BY-4.0", ("cc-by-named",)),
    ("CC0-1.0", ("cc0-named",)),
    ("MPL-2.0", ("mpl-named",)),
    ("Proprietary", ("all-rights",)),
)

#: Older versions of the Creative Commons licences, whose statements differ from those of 4.0 in the version's number and "unported".
CC_KINDS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0")


def _with_made(sentences: dict, rules: tuple) -> tuple[dict, tuple]:
    """The tables with older Creative Commons versions and a line of the form "SPDX-License-Identifier: x" for each licence."""
    more, ends = {}, []
    for kind, name in CC_KINDS.items():
        for version in CC_VERSIONS:
            v, ident = version.replace(".", " "), f"cc-{kind.replace(' ', '-')}-{version}-named"
            more[ident] = (f"licensed under cc {kind} {v}", f"this work is licensed under cc {kind} {v}", f"this work is licensed under a creative commons {name} {v} license", f"this work is licensed under a creative commons {name} {v} unported license", f"this work is licensed under a creative commons {name} {v} international license")
            ends.append((f"CC-{kind.replace(' ', '-').upper()}-{version}", (ident,)))
    tagged = dict.fromkeys(licence for licence, _ in (*rules, *ends) if licence not in ("BSD", "Proprietary"))
    for licence in tagged:
        more[f"spdx-{licence}"] = ("spdx license identifier " + licence.lower().replace("-", " ").replace(".", " "),)
        ends.append((licence, (f"spdx-{licence}",)))
    return sentences | more, (*rules[:-1], *ends, rules[-1])


SENTENCES, RULES = _with_made(SENTENCES, RULES)


def weaker_than(j: int) -> list[int]:
    """Earlier rules beside which rule j says nothing more: of the same licence, of more of its identifiers, or of an exacter version.

    All rights reserved stands in the notices of many licences and so counts only where nothing else is found.
    """
    licence, idents = RULES[j]
    return [i for i, (other, more) in enumerate(RULES[:j]) if licence == "Proprietary" or other in (licence, f"{licence}-only", f"{licence}-or-later") or set(idents) <= set(more)]


#: Most words of a name in a wording.
MOST_NAME = 12

#: Letters and digits of normal forms, as the inside of a character class.
LETTERS = r"a-z0-9\x{80}-\x{10FFFF}"
#: Each wording holds one of these, so a text with none of them isn't looked at further.
HINTS = ("licen", "software", "warranty", "redistribution", "cc0", "domain", "reserved")


def normalised(text: Column) -> Column:
    """Normal form of a text: words with a space, a tab or a line feed between them.

    A line feed stands at sentence ends: . ! ? before white space, but not after the word v, and blank lines, also those of a
    comment. A tab stands at weaker breaks: line ends, : ; before white space, and "v. ". Marks at line starts (# * //) go.
    """
    steps = [
        (r"(?<=(?<![" + LETTERS + r"])v)\.(?=[ \n])", "\x02"),
        (r"[.!?](?=[ \n])", "\x01"),
        (r"[:;](?=[ \n])", "\x02"),
        (r"[^" + LETTERS + r"\x01\x02\n]+", " "),
        (r" ?([\x01\x02\n]) ?", "$1"),
        (r"\n\n+", "\x01"),
        (r"[\x02\n]+", "\t"),
        (r"\t?\x01[\x01\t]*", "\n"),
    ]
    out = F.regexp_replace(F.lower(text), "\r\n", "\n")
    out = F.translate(out, "\t\x0b\f\r\x01\x02", "   \n  ")
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def wording_pattern() -> str:
    """Known wordings in a normal form, the longest first, as group 1: they start and end at breaks and may run over tabs.

    Names inside may have breaks of their own ("Acme Inc."). What follows by, see, for or a link on the same line is no part of a wording.
    """
    known = sorted({w for wordings in SENTENCES.values() for w in wordings}, key=lambda w: (-len(w), w))
    name = r"[ \t\n](?:[^ \t\n]+[ \t\n]){1," + str(MOST_NAME) + "}?"
    forms = [w.replace(" * ", "*").replace(" ", r"[ \t]").replace("*", name) for w in known]
    return r"(?<![^\n\t])(" + "|".join(forms) + r")(?: (?:by|see|for|https?)(?: [^ \t\n]+)*)?(?![^\n\t])"


def unnamed(wording: Column) -> Column:
    """A found wording as it is in SENTENCES: single spaces, and * for a name."""
    out = F.translate(wording, "\t\n", "  ")
    for w in (w for wordings in SENTENCES.values() for w in wordings if "*" in w):
        out = F.regexp_replace(out, "^" + w.replace("*", ".+") + "$", w)
    return out


def identifiers(text: Column) -> Column:
    """Array of the identifiers of a text's licence sentences, in order; empty for null and for a text that holds none of HINTS."""
    low = F.lower(text)
    likely = low.contains(HINTS[0])
    for hint in HINTS[1:]:
        likely = likely | low.contains(hint)
    known = F.create_map(*[F.lit(x) for name, wordings in SENTENCES.items() for w in wordings for x in (w, name)])
    found = F.regexp_extract_all(normalised(text), F.lit(wording_pattern()), F.lit(1))
    return F.when(likely, F.transform(found, lambda w: F.element_at(known, unnamed(w)))).otherwise(F.array().cast("array<string>"))


def recognise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add licence, licences, rule and sentences to docs.

    Known wordings are found in the normal form of the text, from one break to another, also over line ends and weak stops inside,
    and their identifier sequence is held against RULES, all within the row. sentences is that sequence, space-joined. licences
    are those of all rules that match, in the rules' order, without the weaker ones (weaker_than), space-joined; licence is the first
    and rule its rule's identifiers, space-joined. licence and rule are null and licences empty if none matches.

    Each row is judged by itself, whatever its key: repeated rows each get their result. Null and empty texts have no sentence;
    an empty table gives an empty result; sentences of any length are compared whole. Other columns pass through (columns named
    like the added ones are replaced).
    """
    names = [c for c in docs.columns if c not in ("licence", "licences", "rule", "sentences")]
    listed = docs.select(whole(docs, names).alias("_row"), F.array_join(identifiers(F.col(text_col).cast("string")), " ").alias("sentences"))
    matches = F.array(*[F.col("sentences").rlike(rule_pattern(idents)) for _, idents in RULES])

    def decided(m: Column) -> Column:
        found = []
        for j, (licence, idents) in enumerate(RULES):
            said = m[j]
            for i in weaker_than(j) if licence != "Proprietary" else ():
                said = said & ~m[i]
            if licence == "Proprietary":
                said = said & (F.array_position(m, True) == j + 1)
            found.append(F.when(said, F.struct(F.lit(licence).alias("licence"), F.lit(" ".join(idents)).alias("rule"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    # an array of one array, so that the matches are found once
    ruled = F.when(F.col("sentences") != "", F.transform(F.array(matches), decided)[0])
    out = listed.withColumn("_rules", ruled)
    first = F.get("_rules", F.lit(0))
    joined = F.coalesce(F.array_join(F.col("_rules.licence"), " "), F.lit(""))
    return out.select("_row.*", first["licence"].alias("licence"), joined.alias("licences"), first["rule"].alias("rule"), "sentences")


def rule_pattern(idents: tuple[str, ...]) -> str:
    return r"(^| )" + "( | .* )".join(i.replace(".", r"\.") for i in idents) + "( |$)"


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, licence ('none' without one), licences (all, space-joined), n_sentences (licence sentences), sentences."""
    found = recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.coalesce("licence", F.lit("none")).alias("licence"),
        "licences",
        F.when(F.col("sentences") == "", F.lit(0)).otherwise(F.size(F.split("sentences", " "))).cast("long").alias("n_sentences"),
        "sentences",
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op5_sql() -> str:
    known = ", ".join(f"({_sql_text(s)}, {_sql_text(name)})" for name, wordings in SENTENCES.items() for s in wordings)
    matched = [f"regexp_matches(sentences, {_sql_text(rule_pattern(idents))})" for _, idents in RULES]
    cases = " ".join(f"WHEN {m} THEN {_sql_text(licence)}" for m, (licence, _) in zip(matched, RULES, strict=True))
    all_cases = ", ".join(f"CASE WHEN {' AND NOT '.join([matched[j], *[matched[i] for i in weaker_than(j)]])} THEN {_sql_text(licence)} END" for j, (licence, _) in enumerate(RULES))
    return f"""
WITH known(sentence, ident) AS (VALUES {known}),
cut AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?;:]+[ \\t\\x0b\\f\\r]+|[.!?;:]*[\\r\\n]+')) AS raw, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.!?;:]+[ \\t\\x0b\\f\\r]+|[.!?;:]*[\\r\\n]+'), 1) AS place FROM documents),
named AS (SELECT doc_id, place, ident FROM (SELECT doc_id, place, trim(regexp_replace(lower(raw), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) AS sentence FROM cut) JOIN known USING (sentence)),
listed AS (SELECT doc_id, string_agg(ident, ' ' ORDER BY place) AS sentences, count(*) AS n FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(CASE {cases} END, 'none') AS licence, concat_ws(' ', {all_cases}) AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(sentences, '') AS sentences
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id"""
