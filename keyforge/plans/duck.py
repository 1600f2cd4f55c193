"""DuckDB SQL fragments for the oracle queries.

These are written independently of the Spark expressions (DuckDB dialect:
``lambda x:`` lambdas, ``'g'`` flag for global regex replace, 1-based list
indexes).  Each helper takes SQL text and returns SQL text.
"""

from __future__ import annotations

from keyforge.functions.text import CTRL, KW_EDGE, WS, WS_NO_LF

LF = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def clean_text(x: str) -> str:
    t = f"regexp_replace({x}, {q(CTRL)}, '', 'g')"
    t = f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, {q(f'[{WS_NO_LF}]*' + chr(92) + 'n' + f'[{WS_NO_LF}]*')}, {LF}, 'g')"
    return strip(t)


def dedup_ci(arr: str, v: str = "d") -> str:
    items = f"list_filter(list_transform({arr}, lambda {v}x: {strip(v + 'x')}), lambda {v}z: {v}z IS NOT NULL AND {v}z <> '')"
    return (f"list_reduce({items}, lambda {v}acc, {v}e: CASE WHEN "
            f"len(list_filter({v}acc, lambda {v}y: {fold(v + 'y')} = {fold(v + 'e')})) > 0 "
            f"THEN {v}acc ELSE list_append({v}acc, {v}e) END, []::VARCHAR[])")


def clean_phrases(arr: str, v: str = "c") -> str:
    return (f"list_transform(list_filter({arr}, lambda {v}x: {v}x IS NOT NULL AND {strip(v + 'x')} <> ''), "
            f"lambda {v}y: {clean_text(v + 'y')})")


def to_keywords(key: str) -> str:
    arr = f"coalesce(string_split({key}, {LF}), []::VARCHAR[])"
    cleaned = f"list_filter({clean_phrases(arr)}, lambda kz: kz <> '')"
    return dedup_ci(cleaned)


def normalize_kw_string(s: str) -> str:
    parts = f"coalesce(regexp_split_to_array({s}, '[\\n;,]'), []::VARCHAR[])"
    return dedup_ci(parts, "n")


def clean_kw(x: str) -> str:
    s = strip(f"regexp_replace({x}, {q(f'[{WS}]+')}, ' ', 'g')")
    s = f"regexp_replace({s}, {q(f'^[{KW_EDGE}]+|[{KW_EDGE}]+$')}, '', 'g')"
    return strip(s)


def postprocess(arr: str, lowercase: bool = False, min_len: int = 2,
                max_len: int | None = None, dedupe: bool = True, v: str = "p") -> str:
    items = f"list_transform({arr}, lambda {v}a: {clean_kw(v + 'a')})"
    if lowercase:
        items = f"list_transform({items}, lambda {v}b: lower({v}b))"
    cond = f"{v}c <> '' AND length({v}c) >= {min_len}"
    if max_len is not None:
        cond += f" AND length({v}c) <= {max_len}"
    items = f"list_filter({items}, lambda {v}c: {cond})"
    if dedupe:
        items = (f"list_reduce({items}, lambda {v}acc, {v}e: CASE WHEN "
                 f"len(list_filter({v}acc, lambda {v}y: {fold(v + 'y')} = {fold(v + 'e')})) > 0 "
                 f"THEN {v}acc ELSE list_append({v}acc, {v}e) END, []::VARCHAR[])")
    return items


def join_keywords(arr: str, sep: str = "; ", v: str = "j") -> str:
    return (f"array_to_string(list_filter(list_transform({arr}, lambda {v}a: {clean_kw(v + 'a')}), "
            f"lambda {v}b: {v}b <> ''), {q(sep)})")


def word_count(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, {q(f'[^{WS}]+')})), 0)::BIGINT"


def sentences(x: str, v: str = "s") -> str:
    marked = f"regexp_replace({strip(x)}, {q(f'([.!?])[{WS}]+')}, '\\1' || {LF}, 'g')"
    return (f"list_filter(list_transform(string_split({marked}, {LF}), lambda {v}a: {strip(v + 'a')}), "
            f"lambda {v}b: {v}b <> '')")


def keep_punctuated_sentences(x: str) -> str:
    return (f"array_to_string(list_filter({sentences(x)}, lambda tx: "
            f"regexp_matches(right(tx, 1), '^[!-/:-@\\[-`{{-~]$')), {LF})")


def show_list(arr: str, sep: str = " | ") -> str:
    """Arrays are compared as joined strings."""
    return f"array_to_string({arr}, {q(sep)})"


# --- answer parsing (PRS) -------------------------------------------------

def clean_keyword(x: str) -> str:
    from keyforge.functions.parse import BULLETS, QUOTES, TRAIL
    s = f"regexp_replace({x}, {q(f'^[{BULLETS}]+[.)]?[{WS}]*')}, '', 'g')"
    s = strip(s)
    s = f"regexp_replace({s}, {q(f'^[{QUOTES}]+|[{QUOTES}]+$')}, '', 'g')"
    s = f"regexp_replace({s}, {q(f'[{TRAIL}]+$')}, '', 'g')"
    return strip(s)


def dedup_fold(arr: str, v: str = "u") -> str:
    return (f"list_reduce({arr}, lambda {v}acc, {v}e: CASE WHEN "
            f"len(list_filter({v}acc, lambda {v}y: {fold(v + 'y')} = {fold(v + 'e')})) > 0 "
            f"THEN {v}acc ELSE list_append({v}acc, {v}e) END, []::VARCHAR[])")


def parse_list_literal(x: str) -> str:
    snip = f"regexp_replace(regexp_extract(coalesce({x}, ''), '\\[.*\\]', 0, 's'), {q(f',[{WS}]*' + chr(92) + ']$')}, ']')"
    items = f"CAST(json_extract({snip}, '$[*]') AS JSON[])"
    strings = (f"list_transform(list_filter({items}, lambda jx: json_type(jx) = 'VARCHAR'), "
               f"lambda jy: jy->>'$')")
    parsed = f"(CASE WHEN json_valid({snip}) AND json_type({snip}::JSON) = 'ARRAY' THEN {strings} ELSE []::VARCHAR[] END)"
    cleaned = f"list_filter(list_transform({parsed}, lambda ka: {clean_keyword('ka')}), lambda kb: kb IS NOT NULL AND kb <> '')"
    return dedup_fold(cleaned, "l")


def parse_keyword_lines(x: str, tag: str = "KEYWORDS") -> str:
    from keyforge.functions.parse import LINE_BREAKS
    text = f"coalesce({x}, '')"
    tail = (f"(CASE WHEN regexp_matches({text}, {q('(?i)' + tag)}) THEN "
            f"regexp_extract({text}, {q(f'(?is){tag}[{WS}]*:?(.*)')}, 1) ELSE {text} END)")
    lines = f"list_transform(regexp_split_to_array({tail}, {q(LINE_BREAKS)}), lambda la: {strip('la')})"
    k = clean_keyword("lb")
    nwords = f"len(regexp_extract_all({k}, {q(f'[^{WS}]+')}))"
    step = (f"CASE WHEN lacc.stop THEN lacc "
            f"WHEN lb = '' THEN (CASE WHEN len(lacc.out) > 0 THEN {{'stop': true, 'out': lacc.out}} ELSE lacc END) "
            f"WHEN {k} = '' THEN lacc "
            f"WHEN regexp_matches({k}, '(?i)^(?:assistant|analysis|note|explanation)\\b') THEN {{'stop': true, 'out': lacc.out}} "
            f"WHEN regexp_matches({k}, {q(f'(?i)^{tag}[{WS}]*:?$')}) THEN lacc "
            f"WHEN regexp_matches({k}, '(?i)\\bkeywords?\\b') AND {nwords} > 3 THEN lacc "
            f"ELSE {{'stop': false, 'out': list_append(lacc.out, {k})}} END")
    out = f"list_reduce({lines}, lambda lacc, lb: {step}, {{'stop': false, 'out': []::VARCHAR[]}})"
    return dedup_fold(f"({out}).out", "m")


def parse_answer(x: str) -> str:
    lit = parse_list_literal(x)
    return f"(CASE WHEN len({lit}) > 0 THEN {lit} ELSE {parse_keyword_lines(x)} END)"


# --- stemming ---------------------------------------------------------------

def _stem_rules(rules: list, measure: str) -> str:
    cases = []
    for suffix, new in rules:
        base = f"left(w, length(w) - {len(suffix)})"
        extra = f" AND right({base}, 1) IN ('s', 't')" if suffix == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN regexp_matches({base}, '{measure}'){extra} THEN {base} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_ctes(words: str) -> str:
    """``stems(token, stem)`` of the distinct ``token`` of the relation ``words``:
    the Porter algorithm, one CTE a step.  Consonant and vowel runs are spelled
    out here, apart from the code under test."""
    from keyforge.functions.porter import _STEP2, _STEP3, _STEP4
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m1, m2 = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}"
    one, vowel, short = f"^({c})?{v}{c}({v})?$", f"^({c})?[aeiouy]", f"^{c}[aeiouy][^aeiouwxy]$"
    cut = lambda n: f"left(w, length(w) - {n})"
    doubled = "right(w, 1) = substr(w, length(w) - 1, 1)"
    steps = [
        (f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END", "false"),
        (f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({cut(3)}, '{m1}') THEN {cut(1)} ELSE w END
            WHEN ends_with(w, 'ed') AND regexp_matches({cut(2)}, '{vowel}') THEN {cut(2)}
            WHEN ends_with(w, 'ing') AND regexp_matches({cut(3)}, '{vowel}') THEN {cut(3)} ELSE w END""",
         f"""NOT ends_with(w, 'eed') AND ((ends_with(w, 'ed') AND regexp_matches({cut(2)}, '{vowel}')) OR (ends_with(w, 'ing') AND regexp_matches({cut(3)}, '{vowel}')))"""),
        (f"""CASE WHEN NOT bare THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
            WHEN {doubled} AND regexp_matches(w, '[^aeiouylsz]$|[^aeiouy](yy)+$|[aeiou]y(yy)+$') THEN {cut(1)}
            WHEN regexp_matches(w, '{short}') THEN w || 'e' ELSE w END""", "false"),
        (f"CASE WHEN ends_with(w, 'y') AND regexp_matches({cut(1)}, '{vowel}') THEN {cut(1)} || 'i' ELSE w END", "false"),
        (_stem_rules(_STEP2, m1), "false"), (_stem_rules(_STEP3, m1), "false"), (_stem_rules([(x, "") for x in _STEP4], m2), "false"),
        (f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut(1)}, '{m2}') OR (regexp_matches({cut(1)}, '{one}') AND NOT regexp_matches({cut(1)}, '{short}'))) THEN {cut(1)} ELSE w END", "false"),
        (f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{m2}') THEN {cut(1)} ELSE w END", "false")]
    out = [f"st0 AS (SELECT DISTINCT token, regexp_replace(token, '^y', 'Y') AS w, false AS bare FROM {words})"]
    for k, (word, bare) in enumerate(steps):
        out.append(f"st{k + 1} AS (SELECT token, {word} AS w, {bare} AS bare FROM st{k})")
    out.append(f"stems AS (SELECT token, CASE WHEN length(token) > 3 THEN regexp_replace(w, '^Y', 'y') ELSE token END AS stem FROM st{len(steps)})")
    return ",\n".join(out)
