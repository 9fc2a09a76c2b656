"""Licence scans by sentence rules: normalised sentences become identifiers, identifier sequences match ordered rules.

A text is cut into pieces at line ends and after . ! ? ; : or , before white space; each is lower-cased and its runs of
other characters than letters and digits (comment signs, quotes) become one space. A known sentence is any run of pieces that joins to it, so it may be wrapped over
lines, stand behind other words of its line or hold commas; of overlapping runs the one within another goes. Known sentences give their identifiers, in order; other
sentences between them are skipped. Rules are tried in order, longest first; a matched stretch is used up.

Known sentences are notices of licences as they stand, and statements made by a rule: each lead-in (``licensed under the``, ``this project is released under the``) with each name of
a licence, and an SPDX line for each identifier. They are looked up by their first word, so a piece is compared with few of them.

A run has at most as many pieces as the sentence has words, so nothing is lost by looking no further. Everything happens within a row: no
shuffle, and repeated rows stay, whatever their doc_id. Null and empty texts match nothing. Equal runs can't compete: a sentence has one identifier.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_inputs, let, table

#: Identifiers of licence sentences, in normalised form.
SENTENCES = {
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-program": "this program is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "apache2": "licensed under the apache license version 2 0",
    "apache2-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "ccbync4": "licensed under cc by nc 4 0",
    "ccby4": "licensed under cc by 4 0",
    "ccbysa4": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "library-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "epl2-material": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Names of licences in statements, and lead-ins that make a statement of a name.
NAMES = {
    "MIT": ["mit license"], "Apache-2.0": ["apache license 2 0", "apache 2 0 license", "apache license v2 0"], "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2 0", "gpl v2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3 0", "gpl v3"], "LGPL-2.1": ["gnu lesser general public license version 2 1"], "LGPL-3.0": ["gnu lesser general public license version 3"],
    "AGPL-3.0": ["gnu affero general public license version 3"], "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"], "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license"], "ISC": ["isc license"], "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
}
THINGS, VERBS = ("project", "program", "software", "library", "package", "code", "file", "work"), ("licensed", "released", "distributed")
LEADS = [*(f"{v} under the" for v in VERBS), *(f"this {t} is {v} under the" for t in THINGS for v in VERBS)]
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "EPL-2.0", "CC-BY-4.0", "CC0-1.0", "Unlicense"]
plain = lambda x: x.lower().replace("-", " ").replace(".", " ")
#: Statement to its identifier; several statements share one.
STATEMENTS = {f"{lead} {name}": f"says-{plain(k).replace(' ', '')}" for k, names in NAMES.items() for name in names for lead in LEADS}
STATEMENTS |= {f"spdx license identifier {plain(x)}": f"spdx-{plain(x).replace(' ', '')}" for x in SPDX}
STATEMENTS = {s: i for s, i in STATEMENTS.items() if s not in SENTENCES.values()}
KNOWN = [(i, s) for i, s in SENTENCES.items()] + [(i, s) for s, i in STATEMENTS.items()]
#: Ordered rules.
RULES = [
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("Apache-2.0", ["apache2", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-the", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2", "apache2-comply"]),
    ("Apache-2.0", ["apache2-the", "apache2-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "library-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "library-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy-s"]),
    ("BSD", ["reserved", "bsd-grant"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl3-program"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["apache2"]),
    ("Apache-2.0", ["apache2-the"]),
    ("MIT", ["mit"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant"]),
    ("BSD", ["bsd-grant"]),
    ("CC-BY-NC-4.0", ["ccbync4"]),
    ("CC-BY-SA-4.0", ["ccbysa4"]),
    ("CC-BY-4.0", ["ccby4"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("ISC", ["isc-grant"]),
    ("EPL-2.0", ["epl2-material"]),
    ("Unlicense", ["unlicense"]),
    *((k, [f"says-{plain(k).replace(' ', '')}"]) for k in NAMES),
    *((x, [f"spdx-{plain(x).replace(' ', '')}"]) for x in SPDX),
    ("all-rights-reserved", ["reserved"]),
]
#: Every sentence above holds one of these.
WORDS = "licen|permi|reserved|program|file|library|redistribution|unencumbered|gpl"


def normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def scan_licences(docs: DataFrame, sentences: dict[str, str] | list[tuple[str, str]] = KNOWN, rules: list[tuple[str, list[str]]] = RULES, words: str = WORDS) -> DataFrame:
    """doc_id, sentence_ids (in text order), licences (in rule order, each once) of every row.

    sentences: identifiers with their normalised sentences (pairs, where several share one); words: a pattern that every sentence matches, or ''.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.filter(F.transform(F.split(text, r"\n|(?<=[.!?;:,])[\x20\x09\x0B-\x0D]+"), normal), lambda v: v != "")
    by_word: dict[str, list] = {}
    for k, v in sentences.items() if isinstance(sentences, dict) else sentences:
        by_word.setdefault(v.split()[0], []).append({"id": k, "s": v, "n": len(v.split())})
    index = F.from_json(F.lit(json.dumps(by_word)), "map<string,array<struct<id:string,s:string,n:int>>>")  # a constant

    def runs(p):
        """from, to and id of each run of pieces that is a known sentence."""

        def at(piece, i):
            of_word = F.coalesce(F.try_element_at(index, F.substring_index(piece, " ", 1)), F.array().cast("array<struct<id:string,s:string,n:int>>"))
            begun = F.filter(of_word, lambda k: k["s"].startswith(piece))
            end = lambda k: F.filter(F.sequence(F.lit(1), k["n"]), lambda n: F.array_join(F.slice(p, i + 1, n), " ") == k["s"])
            ends = F.transform(begun, lambda k: F.struct(i.alias("from"), (i + F.get(end(k), 0)).alias("to"), k["id"].alias("id")))
            return F.filter(ends, lambda x: x["to"].isNotNull())

        return F.flatten(F.transform(p, at))

    within = lambda x, y: (y["from"] <= x["from"]) & (x["to"] <= y["to"]) & (y["to"] - y["from"] > x["to"] - x["from"])
    outer = let(let(pieces, runs), lambda r: F.transform(F.filter(r, lambda x: ~F.exists(r, lambda y: within(x, y))), lambda x: x["id"]))
    found = F.when(text.rlike(f"(?i){words}"), outer).otherwise(F.array().cast("array<string>"))
    base = drop_inputs(docs, "doc_id", "text").select("doc_id", found.alias("sentence_ids"))
    path = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    step = lambda state, r: F.struct(
        F.replace(state["path"], r["key"], F.lit("|")).alias("path"),
        F.when(F.contains(state["path"], r["key"]), F.array_append(state["out"], r["name"])).otherwise(state["out"]).alias("out"))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("," + ",,".join(r) + ",").alias("key")) for n, r in rules])
    start = F.struct(path.alias("path"), F.array().cast("array<string>").alias("out"))
    got = F.aggregate(listed, start, step, lambda s: F.array_distinct(s["out"]))
    return base.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, got).otherwise(F.array().cast("array<string>")).alias("licences"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    known = ", ".join(f"('{s}', '{k}', {len(s.split())})" for k, s in KNOWN)
    key = ["," + ",,".join(r) + "," for _, r in RULES]
    path = "',' || string_agg(id, ',,' ORDER BY i) || ','"
    paths = reduce(lambda e, k: [*e, f"replace({e[-1]}, '{k}', '|')"], key[:-1], ["p"])
    out = ", ".join(f"CASE WHEN contains({e}, '{k}') THEN '{n}' END" for (n, _), k, e in zip(RULES, key, paths, strict=True))
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents), known(s, id, w) AS (VALUES {known}),
x AS (SELECT k, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;:,])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), '\n'), lambda v: trim(regexp_replace(lower(v), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda v: v <> '') AS l FROM d),
a AS (SELECT k, l, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM x),
n AS (SELECT k, l, i, s, id, unnest(range(1, w + 1)) AS n FROM a JOIN known ON starts_with(s, piece)),
r AS (SELECT k, i, s, id, min(i + n) AS j FROM n WHERE array_to_string(l[i : i + n - 1], ' ') = s GROUP BY k, i, s, id),
y AS (SELECT k, i, id FROM r r1 WHERE NOT EXISTS (SELECT 1 FROM r r2 WHERE r2.k = r1.k AND r2.i <= r1.i AND r1.j <= r2.j AND r2.j - r2.i > r1.j - r1.i)),
p AS (SELECT k, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, {path} AS p FROM y GROUP BY k),
o AS (SELECT k, unnest([{out}]) AS l, generate_subscripts([{out}], 1) AS r FROM p),
f AS (SELECT k, string_agg(l, ',' ORDER BY r) AS licences FROM (SELECT k, l, min(r) AS r FROM o WHERE l IS NOT NULL GROUP BY k, l) GROUP BY k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM d LEFT JOIN p USING (k) LEFT JOIN f USING (k)"""
