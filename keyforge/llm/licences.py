"""Licence scans by sentence rules (operator 1).

A text is cut into sentences; those that hold a licence keyword are normalised
(lower case, runs of other characters than letters and digits become one
space) and mapped to the identifier of a known licence sentence, or to
``unknown``.  The identifiers of a document, in order, are then matched
against ordered licence rules: at each place the first rule whose whole
sequence follows wins and consumes it, so complete licences come before the
single sentences they contain.

Licence texts are hard-wrapped, often behind comment marks: a line end ends a
sentence only at a blank line, after end punctuation, around copyright lines,
SPDX tags and addresses, and before list numbers or the first words of a known
sentence.  Addresses and the disclaimers in ``PASSED`` are identified but stand
in no rule's way.  An SPDX tag gives its licence expression.

Everything runs in JVM expressions in one scan: no shuffle, no join.  Null
and empty texts have no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyforge.llm.common import no_null

# Keywords, the sentences of public licence texts, and the licences they make up.
TEXT_KEYWORD = r"(?i)licen[sc]|copyright|permission|warrant|redistribut|liable|spdx|all\W{1,40}rights\W{1,40}reserved"
KEYWORD = r"(?i)licen[sc]|copyright|permission|warrant|redistribut|liable|spdx|all rights reserved"
SENTENCES = {
    "SpdxTag": r"^.{0,20}spdx license identifier ",
    "Apache2Ref": r"licensed under (the )?apache license,? version 2 0( the license)?",
    "Apache2NotUse": r"^you may not use this file except in compliance with the license$",
    "Apache2Copy": r"^you may obtain a copy of the license at",
    "Apache2AsIs": r"^unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "Apache2See": r"^see the license for the specific language governing permissions and limitations under the license$",
    "MitRef": r"(released|licensed|distributed|available) under the (terms of the )?mit license",
    "MitGrant": r"^permission is hereby granted free of charge to any person obtaining a copy of this software",
    "MitNotice": r"^the above copyright notice and this permission notice shall be included in all copies",
    "AsIsUpper": r"^the software is provided as is without warranty of any kind",
    "NoLiability": r"^in no event shall the (authors|copyright holder)",
    "BsdRedistribute": r"^redistribution and use in source and binary forms with or without modification are permitted",
    "BsdSource": r"^redistributions of source code must retain the above copyright notice",
    "BsdBinary": r"^redistributions in binary form must reproduce the above copyright notice",
    "BsdNoEndorse": r"^neither the name of .* may be used to endorse or promote products",
    "GplRef3": r"licensed under the (terms of the )?gnu general public license,? (version|v) ?3",
    "GplRef2": r"licensed under the (terms of the )?gnu general public license,? (version|v) ?2",
    "GplFree3": r"^(this program is free software you can redistribute it|you can redistribute it .* gnu general public license) .*\bversion 3 of the license",
    "GplFree2": r"^(this program is free software you can redistribute it|you can redistribute it .* gnu general public license) .*\bversion 2 of the license",
    "GplTerms": r"^you can redistribute it .* gnu general public license as published by",
    "GplVersion3": r"^either version 3 of the license",
    "GplVersion2": r"^either version 2 of the license",
    "GplHope": r"^this program is distributed in the hope that it will be useful but without any warranty",
    "GplImplied": r"^without even the implied warranty of merchantability",
    "GplSee": r"^see the gnu general public license for more details$",
    "BsdAsIs": r"^this software is provided by .* as is and any express or implied warranties",
    "GplCopy": r"^you should have received a copy of the gnu general public license",
    "CcByNc4Ref": r"licensed under (a )?(cc|creative commons) (by nc|attribution noncommercial) 4 0",
    "CcBySa4Ref": r"licensed under (a )?(cc|creative commons) (by sa|attribution sharealike) 4 0",
    "CcBy4Ref": r"licensed under (a )?(cc|creative commons) (by|attribution) 4 0",
    "AllRights": r"all rights reserved",
    "Copyright": r"^copyright ",
}
RULES = (
    ("Apache-2.0", ("Apache2Ref", "Apache2NotUse", "Apache2Copy", "Apache2AsIs", "Apache2See")),
    ("Apache-2.0", ("Apache2Ref", "Apache2NotUse", "Apache2Copy")),
    ("MIT", ("MitGrant", "MitNotice", "AsIsUpper", "NoLiability")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("BSD-3-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary", "BsdNoEndorse")),
    ("BSD-2-Clause", ("BsdRedistribute", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree3", "GplHope", "GplCopy")),
    ("GPL-2.0-or-later", ("GplFree2", "GplHope", "GplCopy")),
    ("GPL-3.0-or-later", ("GplTerms", "GplVersion3", "GplHope", "GplCopy")),
    ("GPL-2.0-or-later", ("GplTerms", "GplVersion2", "GplHope", "GplCopy")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("MIT", ("MitRef",)),
    ("GPL-3.0-only", ("GplRef3",)),
    ("GPL-2.0-only", ("GplRef2",)),
    ("CC-BY-NC-4.0", ("CcByNc4Ref",)),
    ("CC-BY-SA-4.0", ("CcBySa4Ref",)),
    ("CC-BY-4.0", ("CcBy4Ref",)),
    ("SPDX", ("SpdxTag",)),
    ("proprietary", ("AllRights",)),
)
UNKNOWN, ADDRESS, SPDX = "unknown", "Address", "SpdxTag"
PASSED = (ADDRESS, "GplImplied", "GplSee", "BsdAsIs")
#: One place of a sequence: an identifier, for SPDX tags with "=" and the expression, and a semicolon; no identifier ends with another.
RULE_PATTERN = "|".join("".join(f"{i};" if i != SPDX else f"{i}=[^;]*;" for i in ids) for _, ids in RULES)

_BLANK = r"[\x20\x09\x0B-\x0D]"
_MARKS = r"[\x20\x09\x0B-\x0D#*/;%|>!-]*+"
_URL = r"(?:https?://|www\.)\S+"
_ALONE = (
    r"(?:(?i:copyright:?\s*(?:\(c\)|\u00A9|[0-9]{4})|\(c\)\s*[0-9]{4}|\u00A9|spdx-license-identifier)"
    r"|Copyright (?!Holder|Notice|Owner|License|Act)[A-Z]|(?i:<?" + _URL + r"\W*$))")
_STARTS = (
    r"(?i:permission is hereby granted|the above copyright notice and this permission|the software is provided|redistributions? (?:and use )?(?:in|of) (?:source|binary)|"
    r"neither the name of|you may obtain a copy of the license|unless required by applicable law|see the license for|this program is (?:free|distributed)|"
    r"you should have received a copy|in no event shall)")
#: Lines that are sentences of their own, and line ends inside a sentence.
ALONE = rf"(?m)^{_MARKS}{_ALONE}.*$"
WRAP = (
    rf"(?<![.!?;:\n])(?<![.!?;:][\"')\]]{{1,3}}){_BLANK}*+\n{_MARKS}"
    rf"(?=[^\n])(?![0-9a-zA-Z]{{1,2}}[.)]{_BLANK}|{_STARTS})(?=[\"'(<\[\u201C]*[\p{{L}}\p{{N}}])")
EXPRESSION = (
    r"(?i)spdx-license-identifier\s*:?\s*(\(*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?\)*"
    r"(?:\s+(?:and|or|with)\s+\(*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?\)*)*)")


def unwrapped(text: Column) -> Column:
    """The text with one line for each hard-wrapped paragraph."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), ALONE, "\n$0\n"), WRAP, " ")


def sentences(text: Column) -> Column:
    """Sentences: cut at the line ends that are no wraps and after . ! ? ; before white space."""
    return F.split(F.regexp_replace(unwrapped(text), r"([.!?;])[\x20\x09\x0B-\x0D]+", "$1\n"), "\n")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence."""
    out = F
    for name, pattern in SENTENCES.items():
        out = out.when(sentence.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(UNKNOWN))


def _place(sentence: Column) -> Column:
    """Identifier of a sentence; SPDX tags with "=" and their expression."""
    found = F.regexp_extract(sentence, EXPRESSION, 1)
    found = F.when(found.contains("("), found).otherwise(F.replace(found, F.lit(")"), F.lit("")))
    i = identifier(normalised(sentence))
    address = sentence.rlike(rf"(?i)^\W*(?:if not,? )?(?:see )?\W*{_URL}\W*$")
    return F.when(address, F.lit(ADDRESS)).otherwise(F.concat(i, F.when(i == SPDX, F.concat(F.lit("="), found)).otherwise("")))


def _licence_of(match: Column) -> Column:
    expression = F.regexp_extract(match, r"=([^;]*);", 1)
    out = F.when(expression != "", F.regexp_replace(expression, r"\s+", " "))
    for name, ids in RULES:
        out = out.when(match == "".join(f"{i};" if i != SPDX else f"{i}=;" for i in ids), F.lit(name))
    return out


def scan(docs: DataFrame, text_col: str = "text", prefix: str = "licence_") -> DataFrame:
    """``docs`` with the identifiers and the licences of each text, in order (arrays)."""
    text = no_null(docs[text_col])
    none = F.array().cast("array<string>")
    places = F.transform(F.filter(sentences(text), lambda s: s.rlike(KEYWORD)), _place)
    out = docs.withColumn(prefix + "ids", F.when(text.rlike(TEXT_KEYWORD), places).otherwise(none))
    places = F.col(prefix + "ids")
    ruled = F.filter(places, lambda p: ~p.isin(*PASSED))
    sequence = F.concat(F.array_join(ruled, ";"), F.when(F.size(ruled) > 0, ";").otherwise(""))
    out = out.withColumn(prefix + "names", F.transform(F.regexp_extract_all(sequence, F.lit(RULE_PATTERN), F.lit(0)), _licence_of))
    return out.withColumn(prefix + "ids", F.transform(places, lambda p: F.substring_index(p, "=", 1)))


def document_licences(docs: DataFrame) -> DataFrame:
    """Sentence identifiers, matched licences and unknown sentences of every document."""
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licence_ids").cast("bigint").alias("n_sentences"), F.array_join("licence_ids", ";").alias("sentence_ids"),
        F.size("licence_names").cast("bigint").alias("n_matches"), F.array_join(F.array_distinct("licence_names"), ",").alias("licences"),
        F.size(F.filter("licence_ids", lambda i: i == UNKNOWN)).cast("bigint").alias("n_unknown"))
