"""License scans by sentence rules, in DataFrame operations alone.

A text's sentences are normalised and looked up among known licence sentences; the identifiers of
those found, in the order of the text, are matched against rules: a rule holds if its identifiers
occur in its order, others in between allowed, and none of those that it excludes occurs. A sentence
that names somebody is known whoever that is; one of its kind in words of its own is an identifier too,
so that a rule can exclude it.

Sentences end at marks before white space and at lines without a letter or digit (so that a blank
comment line counts); a single line break is white space, and what a line begins with before its
first letter or digit (comment leaders, bullets) is dropped. What isn't a known sentence is looked
up line by line too, for declarations of one line without a mark.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Known sentences as normalised (lower case, letters, digits and inner dots, single spaces).
SENTENCES: dict[str, str] = {
    "mit-named": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-named": "licensed under the apache license version 2.0",
    "apache-long": "licensed under the apache license version 2.0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-named": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-free-it": "this is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "gpl3-later-part": "either version 3 of the license or at your option any later version",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later-long": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-later": "either version 2.1 of the license or at your option any later version",
    "lgpl3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-named": "licensed under cc by 4.0",
    "cc-by-sa-named": "licensed under cc by sa 4.0",
    "cc-by-nc-named": "licensed under cc by nc 4.0",
    "cc0-named": "licensed under cc0 1.0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-named": "distributed under the boost software license version 1.0",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2.0",
    "spdx-gpl2": "spdx license identifier gpl 2.0 only",
    "spdx-gpl2-later": "spdx license identifier gpl 2.0 or later",
    "spdx-gpl3": "spdx license identifier gpl 3.0 only",
    "spdx-gpl3-later": "spdx license identifier gpl 3.0 or later",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-isc": "spdx license identifier isc",
    "spdx-mpl": "spdx license identifier mpl 2.0",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2.0",
}

# Licence, kind, identifiers in order, identifiers that must not occur. A licence may have several rules.
RULES: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]] = [
    ("MIT", "permissive", ("mit-named",), ()),
    ("MIT", "permissive", ("mit-licensed",), ()),
    ("MIT", "permissive", ("mit-grant", "mit-notice"), ()),
    ("MIT", "permissive", ("spdx-mit",), ()),
    ("Apache-2.0", "permissive", ("apache-named",), ()),
    ("Apache-2.0", "permissive", ("apache-long", "apache-use", "apache-copy"), ()),
    ("Apache-2.0", "permissive", ("spdx-apache",), ()),
    ("GPL-3.0", "copyleft", ("gpl3-work",), ()),
    ("GPL-3.0", "copyleft", ("gpl3-named",), ()),
    ("GPL-3.0", "copyleft", ("gpl3-later",), ()),
    ("GPL-3.0", "copyleft", ("gpl-terms", "gpl3-later-part"), ()),
    ("GPL-3.0", "copyleft", ("spdx-gpl3",), ()),
    ("GPL-3.0", "copyleft", ("spdx-gpl3-later",), ()),
    ("GPL-2.0", "copyleft", ("gpl-terms", "gpl2-later"), ()),
    ("GPL-2.0", "copyleft", ("gpl2-later-long",), ()),
    ("GPL-2.0", "copyleft", ("spdx-gpl2",), ()),
    ("GPL-2.0", "copyleft", ("spdx-gpl2-later",), ()),
    ("LGPL-2.1", "copyleft", ("lgpl-terms", "lgpl21-later"), ()),
    ("LGPL-3.0", "copyleft", ("lgpl3-later",), ()),
    ("AGPL-3.0", "copyleft", ("agpl3-later",), ()),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ()),
    ("BSD-3-Clause", "permissive", ("spdx-bsd3",), ()),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-names", "endorsement-other")),
    ("BSD-2-Clause", "permissive", ("spdx-bsd2",), ()),
    ("ISC", "permissive", ("isc-grant",), ()),
    ("ISC", "permissive", ("spdx-isc",), ()),
    ("CC-BY-4.0", "permissive", ("cc-by-named",), ()),
    ("CC-BY-4.0", "permissive", ("cc-by-work",), ()),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-named",), ()),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-work",), ()),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-named",), ()),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-work",), ()),
    ("CC0-1.0", "permissive", ("cc0-named",), ()),
    ("Unlicense", "permissive", ("unlicense-free",), ()),
    ("Zlib", "permissive", ("zlib-as-is", "zlib-grant"), ()),
    ("BSL-1.0", "permissive", ("boost-grant",), ()),
    ("BSL-1.0", "permissive", ("boost-named",), ()),
    ("EPL-2.0", "copyleft", ("epl-terms",), ()),
    ("MPL-2.0", "copyleft", ("mpl-form",), ()),
    ("MPL-2.0", "copyleft", ("spdx-mpl",), ()),
]

#: Every known sentence holds one of these, so a text without them has none.
HINTS = ("licens", "permission", "copyright", "software", "redistribut", "endorse")

# A sentence that names somebody, as it is normalised, and what stands for it; and what tells a
# sentence of the same kind in other words, which then counts as an identifier of its own.
NAMED = ("neither the name", "neither the names? of .+ nor the names of (its|their|any) contributors may", "neither the name of the copyright holder nor the names of its contributors may")
KIND_OF = ("endorse or promote products", "endorsement-other")

#: Steps before the split at END, which no lower-cased text holds: (pattern, what takes its place).
END = "Z"
STEPS = [
    (r"\x0D\x0A?", "\n"),
    (r"\x0A[^a-z0-9\x0A]+", "\n"),  # what a line begins with
    (r"\x0A\x0A+", END),
    (r"[\x20\x09-\x0D]v\.[\x20\x09-\x0D]", " v "),
    (r"license-identifier:", "license-identifier"),
    (r"[.!?;:]+([\x20\x09-\x0DZ]+|\z)", END),
]
APART = r"[^a-z0-9.]+"


def sentences(low: Column) -> Column:
    """Sentences of a lower-cased text, with the line breaks inside them."""
    for found, new in STEPS:
        low = F.regexp_replace(low, found, new)
    return F.split(low, END)


def holds_hint(text: Column) -> Column:
    out = F.lit(False)
    for hint in HINTS:
        out = out | F.contains(text, F.lit(hint))
    return out


def known(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in its order.

    A text, a sentence, a line without any hint is left at that, before anything is made of it.
    """
    lookup = F.create_map(*(F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)))
    plain = lambda s: F.trim(F.regexp_replace(s, APART, " "))
    unnamed = lambda s: F.when(F.startswith(s, F.lit(NAMED[0])), F.regexp_replace(s, NAMED[1], NAMED[2])).otherwise(s)
    named = lambda s: F.coalesce(F.try_element_at(lookup, s), F.when(F.contains(s, F.lit(KIND_OF[0])), F.lit(KIND_OF[1])))
    look = lambda parts: F.transform(F.transform(F.transform(parts, plain), unnamed), named)
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    hinted = F.filter(sentences(low), holds_hint)
    # a sentence that isn't known is looked at line by line, if it has several
    lines = lambda t: F.filter(look(F.filter(F.split(t, "\n"), holds_hint)), lambda x: x.isNotNull())
    whole = F.zip_with(hinted, look(hinted), lambda t, i: F.struct(t.alias("text"), i.alias("id")))
    each = lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).when(F.contains(x["text"], F.lit("\n")), lines(x["text"])).otherwise(F.array().cast("array<string>"))
    return F.when(holds_hint(low), F.flatten(F.transform(whole, each))).otherwise(F.array().cast("array<string>"))


def pattern(ids: tuple[str, ...]) -> str:
    return "%" + "%".join(f"<{i}>" for i in ids) + "%"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with what its whole text declares.

    n_known: known sentences, repeats counted; sentence_ids: their identifiers in order, comma-joined;
    licenses: licences whose rules hold, in the order of the rules; kinds: likewise, each once.
    Null text is empty; a text without known sentences has zero and empty strings. Rows that repeat
    have rows of their own; no rows give no rows.
    """
    rows = docs.select(*(F.col(c) for c in keep), known(text_of()).alias("__found"))
    marked = F.concat_ws("", F.transform("__found", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    rows = rows.withColumn("__marked", marked)

    def holds(rule: tuple) -> Column:
        out = F.col("__marked").like(pattern(rule[2]))
        for other in rule[3]:
            out = out & ~F.col("__marked").like(pattern((other,)))
        return out

    hold = lambda k: F.array_join(F.array_distinct(F.filter(F.array(*(F.when(holds(r), F.lit(r[k])) for r in RULES)), lambda x: x.isNotNull())), ",")
    return rows.select(
        *keep,
        F.size("__found").cast("long").alias("n_known"),
        F.array_join("__found", ",").alias("sentence_ids"),
        hold(0).alias("licenses"),
        hold(1).alias("kinds"),
    )


def oracle() -> str:
    """The scan in DuckDB's SQL."""
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    lookup = "MAP {" + ", ".join(f"'{s}': '{n}'" for n, s in SENTENCES.items()) + "}"
    parts = low
    for found, new in STEPS:
        parts = f"regexp_replace({parts}, '{found}', {'chr(10)' if new == chr(10) else repr(new)}, 'g')"
    plain = lambda x: f"trim(regexp_replace({x}, '{APART}', ' ', 'g'))"
    unnamed = lambda x: f"CASE WHEN starts_with({plain(x)}, '{NAMED[0]}') THEN regexp_replace({plain(x)}, '{NAMED[1]}', '{NAMED[2]}', 'g') ELSE {plain(x)} END"
    named = lambda x: f"coalesce({lookup}[{unnamed(x)}], CASE WHEN contains({unnamed(x)}, '{KIND_OF[0]}') THEN '{KIND_OF[1]}' END)"
    first = lambda k: f"array_to_string(list_filter(l{k}, lambda x, i: list_position(l{k}, x) = i), ',')"
    hold = lambda r: " AND ".join([f"marked LIKE '{pattern(r[2])}'", *(f"marked NOT LIKE '{pattern((x,))}'" for x in r[3])])
    each = lambda k: "list_filter([" + ", ".join(f"CASE WHEN {hold(r)} THEN '{r[k]}' END" for r in RULES) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH parts AS (SELECT doc_id, string_split({parts}, '{END}') AS s FROM documents),
known AS (
  SELECT doc_id, list_filter(flatten(list_transform(s, lambda x: CASE WHEN {named("x")} IS NOT NULL THEN [{named("x")}]
    ELSE list_transform(string_split(x, chr(10)), lambda y: {named("y")}) END)), lambda x: x IS NOT NULL) AS f FROM parts),
marked AS (SELECT doc_id, f, array_to_string(list_transform(f, lambda x: '<' || x || '>'), '') AS marked FROM known),
held AS (SELECT doc_id, f, {each(0)} AS l0, {each(1)} AS l1 FROM marked)
SELECT doc_id, len(f)::BIGINT AS n_known, array_to_string(f, ',') AS sentence_ids, {first(0)} AS licenses, {first(1)} AS kinds FROM held
"""
