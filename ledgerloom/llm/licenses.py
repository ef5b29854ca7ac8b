"""License scans by sentence rules, in SQL functions alone.

A text is cut into sentences, sentences are normalised, and those that equal a
known licence sentence are replaced by its identifier. The sequence of identifiers
is matched against ordered rules: a rule holds where its identifiers occur in
order. A rule whose sequence lies within that of another matched rule is dropped,
so the longest reading wins. No row leaves its task: there is no shuffle.

Null and empty texts have no sentences; null ids are kept; repeated rows are
scanned each; sentences of one position do not occur, so there are no ties; very
long texts are cut whole in their row; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as they are normalised, by identifier.
SENTENCES = {
    "apache2-grant": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "this project is licensed under the apache license version 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-release": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "gpl3-work": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc-by-nc4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "cc-by4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "gpl2-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl2-work": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "lgpl21-redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl-warranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "agpl3-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mpl2-form": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
}

# Rules as (licence, identifiers in order).
RULES = [
    ("Apache-2.0", ["apache2-grant"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy", "as-is"]),
    ("Apache-2.0", ["apache2-grant", "apache2-copy", "as-is"]),
    ("MIT", ["mit-release"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-warranty"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
]

#: Every known sentence holds one of these.
CUES = "licen[sc]e|redistribut|permission|program|mit |gnu |cc by|warrant|unencumbered"
#: Where a sentence ends: at a full stop, question or exclamation mark before white space, or at a line's end.
BREAK = "[.!?]+[ \\t\\r]+|[.!?]*[ \\t\\r]*\\n[ \\t\\r\\n]*"


def _within(short: list[str], long: list[str]) -> bool:
    rest = iter(long)
    return short != long and all(x in rest for x in short)


def normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "licence", "license")


def identifiers(text: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Array of ``(position, id)`` of the known sentences, in order; positions count sentences from 0."""
    known = F.create_map(*[F.lit(x) for name, forms in sentences.items() for form in forms for x in (form, name)])
    found = F.transform(F.split(text, BREAK), lambda s, i: F.struct(i.alias("position"), F.try_element_at(known, normalised(s)).alias("id")))
    none = F.array().cast("array<struct<position:int,id:string>>")
    return F.when(F.lower(text).rlike(CUES.replace("cc by", "cc[^a-z0-9]+by").replace("mit ", "mit[^a-z0-9]").replace("gnu ", "gnu[^a-z0-9]")), F.filter(found, lambda x: x.id.isNotNull())).otherwise(none)


def matched(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Licences, in order of name, of the rules that hold for an array of identifiers."""
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    holds = {i: line.rlike("," + ",(?:[^,]+,)*?".join(s.replace("-", "[-]") for s in seq) + ",") for i, (_, seq) in enumerate(rules)}
    out = []
    for i, (name, seq) in enumerate(rules):
        wider = [j for j, (_, other) in enumerate(rules) if _within(seq, other)]
        kept = holds[i]
        for j in wider:
            kept = kept & ~holds[j]
        out.append(F.when(kept, F.lit(name)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, sentences, licenses)`` for each row of ``docs(doc_id, text)``; sentences are ``(position, id)``."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifiers(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sentences"))
    return found.withColumn("licenses", matched(F.transform("sentences", lambda x: x.id)))


def duckdb_sql() -> str:
    """The query over ``documents`` in DuckDB's SQL, from the same tables."""
    forms = ", ".join(f"('{form}', '{name}')" for name, all_forms in SENTENCES.items() for form in all_forms)
    rules = ", ".join(
        f"({i}, '{name}', '{',' + ',(?:[^,]+,)*?'.join(seq) + ','}', {[j for j, (_, other) in enumerate(RULES) if _within(seq, other)]}::INTEGER[])"
        for i, (name, seq) in enumerate(RULES)
    )
    return f"""
WITH known(form, id) AS (VALUES {forms}), rules(i, licence, pattern, wider) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS position
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+[ \t\r]+|[.!?]*[ \t\r]*\n[ \t\r\n]*') AS parts FROM documents)
),
hits AS (
  SELECT doc_id, position, id FROM cut
  JOIN known ON form = replace(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license')
),
lines AS (
  SELECT doc_id, string_agg(position || ':' || id, ',' ORDER BY position) AS sentences,
         ',' || string_agg(id, ',' ORDER BY position) || ',' AS line, count(*) AS n_sentences
  FROM hits GROUP BY doc_id
),
held AS (SELECT doc_id, list(i) AS held FROM lines JOIN rules ON regexp_matches(line, pattern) GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses
  FROM held JOIN rules ON list_contains(held, i) AND NOT list_has_any(held, wider) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(sentences, '') AS sentences, coalesce(licenses, '') AS licenses, coalesce(n_sentences, 0) AS n_sentences
FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN named USING (doc_id)
"""
