"""Licence recognition by sentence rules.

A text is cut into sentences (line ends, and white space after a full stop, exclamation or question mark).
Sentences are normalised to lower-case letters and digits with single spaces and mapped to identifiers of
known licence sentences. Ordered rules then match sequences of identifiers: the first rule that matches
takes its identifiers away, and what no rule takes leaves the text with unknown licence sentences. Other
sentences between two identifiers do not break a sequence.

A licence sentence may be wrapped over lines, with or without comment leaders: it begins and ends at a line
end, a sentence end or a semicolon and may pass over line ends and semicolons, but not over a blank line
or the end of a sentence. ``n_sentences`` counts the single pieces.

DataFrame operations only; no shuffle.

Defined results: a null or empty text has no sentence and status ``none``; a licence matched twice is named
once, in the order of the rules; repeated rows give a row each; further columns are not read; an empty
table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table

#: Known licence sentences, normalised, and their identifiers.
SENTENCES = [
    ("released under the mit license", "MitName"),
    ("licensed under the mit license", "MitName"),
    ("this software is released under the mit license", "MitName"),
    ("spdx license identifier mit", "MitName"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "MitGrant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "MitNotice"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "MitAsIs"),
    ("licensed under the apache license version 2 0", "Apache2Name"),
    ("licensed under the apache license version 2 0 the license", "Apache2Name"),
    ("spdx license identifier apache 2 0", "Apache2Name"),
    ("you may not use this file except in compliance with the license", "ApacheComply"),
    ("you may obtain a copy of the license at", "ApacheCopy"),
    ("this work is licensed under the gnu general public license version 3", "Gpl3Name"),
    ("licensed under the gnu general public license version 3", "Gpl3Name"),
    ("spdx license identifier gpl 3 0 only", "Gpl3Name"),
    ("this work is licensed under the gnu general public license version 2", "Gpl2Name"),
    ("licensed under the gnu general public license version 2", "Gpl2Name"),
    ("spdx license identifier gpl 2 0 only", "Gpl2Name"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "Gpl3Later"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "Gpl2Later"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "GplHope"),
    ("see the gnu general public license for more details", "GplSee"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BsdGrant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BsdSource"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "BsdBinary"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BsdEndorse"),
    ("licensed under cc by 4 0", "CcBy4"),
    ("licensed under cc by sa 4 0", "CcBySa4"),
    ("licensed under cc by nc 4 0", "CcByNc4"),
    ("licensed under cc by nd 4 0", "CcByNd4"),
    ("licensed under cc by nc sa 4 0", "CcByNcSa4"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "CcBy4"),
    ("this work is dedicated to the public domain under cc0 1 0", "Cc0"),
    ("all rights reserved", "AllRights"),
]
#: Licences and the identifier sequences that show them, in the order of trial.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitName"]),
    ("Apache-2.0", ["Apache2Name", "ApacheComply", "ApacheCopy"]),
    ("Apache-2.0", ["Apache2Name", "ApacheComply"]),
    ("Apache-2.0", ["Apache2Name"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplHope", "GplSee"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplHope", "GplSee"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("GPL-3.0-only", ["Gpl3Name"]),
    ("GPL-2.0-only", ["Gpl2Name"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa4"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-ND-4.0", ["CcByNd4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC0-1.0", ["Cc0"]),
    ("Proprietary", ["AllRights"]),
]
#: Fixed values of ``scan`` alone: titles, and rules for a copyright line that precedes a grant.
TITLES = [("mit license", "MitName"), ("the mit license", "MitName"), ("the mit license mit", "MitName")]
HEADED = [(name, ["AllRights", *ids]) for name, ids in RULES if ids[0] == "BsdGrant"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def _wrapped(text: Column, sentences: list[tuple[str, str]]) -> Column:
    """Known sentences of a text in order, normalised, each also over line ends."""
    hard, soft = "\x01", "|"
    t = F.translate(F.concat(F.lit("\n"), text, F.lit("\n")), UPPER + "|\x01;", LOWER + "  |")
    t = F.regexp_replace(t, r"[.!?][ \t\r]+|[.!?](?=\n)", hard)
    t = F.regexp_replace(t, r"[^a-z0-9\x01|\n]+", " ")
    t = F.regexp_replace(t, r" ?([\x01|\n]) ?", "$1")
    # lines without letters or digits
    t = F.regexp_replace(t, r"\n[|\n]*\n", hard)
    gap = f"[ {soft}\\n]+"
    known = "|".join(gap.join(s.split()) for s in sorted(dict(sentences), key=len, reverse=True))
    hits = F.regexp_extract_all(t, F.lit(rf"(?<=[\x01|\n])(?:{known})(?=[\x01|\n])"), F.lit(0))
    return F.transform(hits, lambda h: F.regexp_replace(h, gap, " "))


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         sentences: list[tuple[str, str]] = SENTENCES + TITLES, rules: list[tuple[str, list[str]]] = HEADED + RULES) -> DataFrame:
    """Per document: sentences, the sequence of licence sentences, the licences, and a status."""
    known = F.create_map(*[F.lit(x) for pair in dict(sentences).items() for x in pair])
    text = F.coalesce(text_col, F.lit(""))
    lines = F.split(F.regexp_replace(text, "([.!?])[ \\t\\r]+", "$1\n"), "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lines.alias("lines"), _wrapped(text, sentences).alias("hits"))
    rows = rows.withColumn("lines", F.filter(F.transform("lines", _normalised), lambda s: s != ""))
    rows = rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_sentences"),
        F.transform("hits", lambda s: known[s]).alias("ids"),
    )
    rows = rows.withColumn("rest", F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))))
    rows = rows.withColumn("sequence", F.col("rest"))
    found = []
    for n, (name, ids) in enumerate(rules):
        part = F.lit(_sequence(ids))
        rows = rows.withColumn(f"r{n}", F.when(F.contains("rest", part), F.lit(name))).withColumn("rest", F.replace("rest", part, F.lit("")))
        found.append(F.col(f"r{n}"))
    names = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    status = F.when(F.size("ids") == 0, "none").when(F.col("rest") != "", "unknown").otherwise("recognised")
    return rows.select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_licence_sentences"), "sequence",
        F.array_join(names, ",").alias("licences"), status.alias("status"))


def _sql() -> str:
    known = " ".join(f"WHEN '{s}' THEN '<{i}>'" for s, i in dict(SENTENCES).items())
    steps, names = [], []
    last = "matched"
    for n, (name, ids) in enumerate(RULES):
        part = _sequence(ids)
        steps.append(f"r{n} AS (SELECT *, replace(rest{n}, '{part}', '') AS rest{n + 1}, contains(rest{n}, '{part}') AS m{n} FROM {last})")
        names.append(f"CASE WHEN m{n} THEN '{name}' END")
        last = f"r{n}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)),
    lambda s: trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS lines
  FROM documents),
mapped AS (SELECT doc_id, lines, list_filter(list_transform(lines, lambda s: CASE s {known} END), lambda i: i IS NOT NULL) AS ids FROM cut),
matched AS (SELECT *, array_to_string(ids, '') AS rest0 FROM mapped),
{", ".join(steps)},
named AS (SELECT *, list_filter([{", ".join(names)}], lambda x: x IS NOT NULL) AS all_names FROM {last})
SELECT doc_id, len(lines)::BIGINT AS n_sentences, len(ids)::BIGINT AS n_licence_sentences, rest0 AS sequence,
  coalesce(array_to_string(list_filter(all_names, lambda x, i: list_position(all_names, x) = i), ','), '') AS licences,
  CASE WHEN len(ids) = 0 THEN 'none' WHEN rest{len(RULES)} <> '' THEN 'unknown' ELSE 'recognised' END AS status
FROM named"""


@query("op2_licences", _sql())
def op2_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
