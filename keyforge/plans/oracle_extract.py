"""DuckDB oracle CTEs for the token table and the extractors."""

from __future__ import annotations

from keyforge.functions.stopwords import BY_LANGUAGE, ENGLISH
from keyforge.functions.text import TOKEN_RE
from keyforge.plans import duck as D

STOP_SQL = "[" + ", ".join(D.q(w) for w in ENGLISH) + "]"

# DuckDB's levenshtein counts bytes.  Phrases hold lower-case letters, digits
# and spaces only, so every lower-case Latin-1 letter (U+00DF..U+00FF without
# U+00F7, built by rule) is mapped to an unused printable ASCII symbol first;
# the byte distance then equals the character distance.
_LATIN = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
_SYMS = [chr(c) for c in range(ord("A"), ord("Z") + 1)] + list("!#$%&*")
LATIN_FROM = "".join(_LATIN)
LATIN_TO = "".join(_SYMS[: len(_LATIN)])


def ascii_map(x: str) -> str:
    return f"translate({x}, {D.q(LATIN_FROM)}, {D.q(LATIN_TO)})"


def word_list(words) -> str:
    return "[" + ", ".join(D.q(w) for w in words) + "]"


def stop(x: str, lang: str | None = None) -> str:
    """Stop word test; with ``lang`` by the language that this column names."""
    listed = f"list_contains({STOP_SQL}, {x})"
    if lang:
        cases = " ".join(f"WHEN {D.q(code)} THEN list_contains({word_list(words)}, {x})" for code, words in BY_LANGUAGE.items())
        listed = f"CASE {lang} {cases} ELSE {listed} END"
    return f"({listed} OR length({x}) < 3)"


def discard(x: str) -> str:
    return f"(regexp_matches({x}, '^\\p{{N}}+$') OR (regexp_matches({x}, '\\p{{N}}') AND regexp_matches({x}, '\\p{{L}}')))"


def tokens_cte(src: str = "documents", reach: int = 2, keep: str = "") -> str:
    """``keep``: columns of ``src`` to carry along, each with a comma behind it."""
    nxt = ",\n    ".join(
        f"unnest(list_transform(range(len(toks)), lambda ni: toks[ni + {1 + d}])) AS nxt{d}"
        for d in range(1, reach + 1))
    return f"""
tk_s AS (
  SELECT doc_id, {keep}list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \\t\\n\\v\\f\\r]+|\\n+'),
                             lambda sx: regexp_matches(sx, '[\\p{{L}}\\p{{N}}]')) AS sents
  FROM {src}),
tk_s1 AS (SELECT doc_id, {keep}len(sents) AS n_sent, unnest(sents) AS sent, unnest(range(len(sents))) AS sid FROM tk_s),
tk_b AS (
  SELECT doc_id, {keep}n_sent, sid, unnest(blocks) AS block, unnest(range(len(blocks))) AS bid
  FROM (SELECT doc_id, {keep}n_sent, sid, list_filter(regexp_split_to_array(sent, '[^\\p{{L}}\\p{{N}}\\s]+'),
                                                lambda bx: regexp_matches(bx, '[\\p{{L}}\\p{{N}}]')) AS blocks FROM tk_s1)),
tk_b2 AS (SELECT doc_id, {keep}n_sent, sid, bid, regexp_extract_all(block, {D.q(TOKEN_RE)}) AS toks FROM tk_b),
toks AS (
  SELECT doc_id, {keep}n_sent, sid, bid, unnest(range(len(toks))) AS tid, unnest(toks) AS tok,
    {nxt}
  FROM tk_b2 WHERE len(toks) > 0)"""


def yake_cte(top_k: int = 20, dedup: float = 0.9, n: int = 3, window: int = 1, lang: bool = False, features: tuple | None = None) -> str:
    """Needs ``toks`` (reach max(window, n - 1)); defines yake_terms, yake_edges,
    yake_cand, yake_kept(doc_id, kept list)."""
    keep, by = ("lang, ", "lang") if lang else ("", None)
    has = lambda f: features is None or f in features
    rel = """(0.5::DOUBLE + (CASE WHEN wil > 0 THEN wdl::DOUBLE / wil ELSE 0.0 END) * (tf::DOUBLE / max_tf))
      + (0.5::DOUBLE + (CASE WHEN wir > 0 THEN wdr::DOUBLE / wir ELSE 0.0 END) * (tf::DOUBLE / max_tf))""" if has("WRel") else "1.0::DOUBLE"
    freq = "tf::DOUBLE / (avg_tf + std_tf)" if has("WFreq") else "0.0::DOUBLE"
    spread = "sf::DOUBLE / n_sent" if has("WSpread") else "0.0::DOUBLE"
    case = "greatest(tf_a, tf_n)::DOUBLE / (1.0::DOUBLE + ln(tf::DOUBLE))" if has("WCase") else "0.0::DOUBLE"
    pos = "ln(ln(3.0::DOUBLE + med))" if has("WPos") else "1.0::DOUBLE"
    near = "\n  UNION ALL ".join(
        f"SELECT doc_id, term AS a, lower(nxt{d}) AS b FROM yt WHERE nxt{d} IS NOT NULL AND NOT disc AND NOT {discard(f'nxt{d}')}" for d in range(1, window + 1))
    ts = [f"t{i}" for i in range(n)]
    word = lambda i: "term" if i == 0 else f"lower(nxt{i})"
    grams = "\n  UNION ALL ".join(
        "SELECT doc_id, " + keep + ", ".join(f"{word(i) if i < size else 'NULL::VARCHAR'} AS t{i}" for i in range(n)) + " FROM yt"
        + (f" WHERE nxt{size - 1} IS NOT NULL" if size > 1 else "") for size in range(1, n + 1))
    last = f"coalesce({', '.join(reversed(ts))})" if n > 1 else "t0"
    clean = " AND ".join(f"({t} IS NULL OR NOT {discard(t)})" for t in ts)
    cols = ", ".join([f"a{i}.H AS h{i}, a{i}.stop AS s{i}, a{i}.tf AS tf{i}" for i in range(n)] + [f"e{i}.w AS w{i}" for i in range(n - 1)])
    joins = "\n  ".join([f"LEFT JOIN yake_terms a{i} ON a{i}.doc_id = c.doc_id AND a{i}.term = c.t{i}" for i in range(n)]
                   + [f"LEFT JOIN yake_edges e{i} ON e{i}.doc_id = c.doc_id AND e{i}.a = c.t{i} AND e{i}.b = c.t{i + 1}" for i in range(n - 1)])
    prod, total = "1.0::DOUBLE", "0.0::DOUBLE"
    for i in range(n):
        factor = addend = f"h{i}"
        if 0 < i < n - 1:
            p = f"((coalesce(w{i - 1}, 0)::DOUBLE / tf{i - 1}) * (coalesce(w{i}, 0)::DOUBLE / tf{i + 1}))"
            factor = f"CASE WHEN s{i} THEN 1.0::DOUBLE + (1.0::DOUBLE - {p}) ELSE h{i} END"
            addend = f"CASE WHEN s{i} THEN -(1.0::DOUBLE - {p}) ELSE h{i} END"
        prod = f"{prod} * (CASE WHEN t{i} IS NULL THEN 1.0::DOUBLE ELSE {factor} END)"
        total = f"{total} + (CASE WHEN t{i} IS NULL THEN 0.0::DOUBLE ELSE {addend} END)"
    return f"""
yt AS (
  SELECT doc_id, {keep}n_sent, sid, bid, tid, tok, lower(tok) AS term, {discard('tok')} AS disc, COLUMNS('^nxt') FROM toks),
yt2 AS (
  SELECT *, (regexp_matches(tok, '^\\p{{Lu}}+$') AND NOT disc) AS tag_a FROM yt),
yt3 AS (
  SELECT *, (regexp_matches(tok, '^\\p{{Lu}}') AND NOT tag_a AND NOT disc AND NOT (bid = 0 AND tid = 0)) AS tag_n FROM yt2),
y_ps AS (
  SELECT doc_id, {keep}term, sid, count(*) AS c, sum(tag_a::INT) AS a, sum(tag_n::INT) AS n, any_value(n_sent) AS n_sent
  FROM yt3 GROUP BY doc_id, {keep}term, sid),
y_st AS (
  SELECT doc_id, {keep}term, sum(c) AS tf, sum(a) AS tf_a, sum(n) AS tf_n, count(*) AS sf,
         median(sid)::DOUBLE AS med, any_value(n_sent) AS n_sent
  FROM y_ps GROUP BY doc_id, {keep}term),
yake_edges AS (SELECT doc_id, a, b, count(*) AS w FROM (
  {near}) GROUP BY doc_id, a, b),
y_r AS (SELECT doc_id, a AS term, count(*) AS wdr, sum(w) AS wir FROM yake_edges GROUP BY doc_id, a),
y_l AS (SELECT doc_id, b AS term, count(*) AS wdl, sum(w) AS wil FROM yake_edges GROUP BY doc_id, b),
y_j AS (
  SELECT s.*, l.wdl, l.wil, r.wdr, r.wir, {stop('s.term', by and 's.lang')} AS stop
  FROM y_st s LEFT JOIN y_l l USING (doc_id, term) LEFT JOIN y_r r USING (doc_id, term)),
y_w AS (
  SELECT *, max(tf) OVER (PARTITION BY doc_id) AS max_tf,
         avg(CASE WHEN NOT stop THEN tf END) OVER (PARTITION BY doc_id) AS avg_tf,
         stddev_pop(CASE WHEN NOT stop THEN tf END) OVER (PARTITION BY doc_id) AS std_tf
  FROM y_j),
y_f AS (
  SELECT doc_id, term, tf, stop, {rel} AS rel, {freq} AS freq, {spread} AS spread, {case} AS tcase, {pos} AS tpos
  FROM y_w),
yake_terms AS (
  SELECT doc_id, term, tf, stop, (tpos * rel) / (tcase + (freq / rel) + (spread / rel)) AS H FROM y_f),
y_g AS (
  {grams}),
y_gv AS (
  SELECT * FROM y_g WHERE NOT {stop('t0', by)} AND NOT {stop(last, by)} AND {clean}),
y_c AS (SELECT doc_id, {', '.join(ts)}, count(*) AS ctf FROM y_gv GROUP BY doc_id, {', '.join(ts)}),
y_cj AS (SELECT c.*, {cols} FROM y_c c
  {joins}),
y_sc AS (
  SELECT doc_id, concat_ws(' ', {', '.join(ts)}) AS phrase, ({prod}) / ((({total}) + 1.0::DOUBLE) * ctf) AS score FROM y_cj),
y_rk AS (
  SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12), phrase) AS rk
  FROM y_sc),
yake_kept AS (
  SELECT doc_id, list_reduce(list(phrase ORDER BY rk), lambda acc, x:
      CASE WHEN len(acc) >= {top_k} OR len(list_filter(acc, lambda y:
             1.0::DOUBLE - levenshtein({ascii_map('y')}, {ascii_map('x')})::DOUBLE / greatest(length(y), length(x)) > {dedup}::DOUBLE)) > 0
           THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS kept
  FROM y_rk GROUP BY doc_id)"""


def _sum(expr_list: str) -> str:
    return f"list_reduce({expr_list}, lambda sa, sb: sa + sb, 0.0::DOUBLE)"


def kb_candidates_cte(src: str = "documents") -> str:
    """KeyBERT TF-IDF candidates: kb_cand(doc_id, phrase, sim, terms, norm)."""
    return f"""
kb_w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {D.q(TOKEN_RE)}),
                                     lambda kt: length(kt) >= 2 AND NOT list_contains({STOP_SQL}, kt)) AS w FROM {src}),
kb_dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM kb_w) GROUP BY doc_id, term),
kb_idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM {src})) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
           FROM kb_dt GROUP BY term),
kb_dw AS (SELECT d.doc_id, d.term, i.idf, d.tf * i.idf AS wd FROM kb_dt d JOIN kb_idf i USING (term)),
kb_dn AS (SELECT doc_id, sqrt({_sum('list(wd * wd ORDER BY term)')}) AS dnorm FROM kb_dw GROUP BY doc_id),
kb_g AS (SELECT doc_id, unnest(list_concat(
            list_transform(range(1, len(w) + 1), lambda gi: w[gi:gi]),
            list_transform(range(1, len(w)), lambda gj: w[gj:gj + 1]),
            list_transform(range(1, len(w) - 1), lambda gk: w[gk:gk + 2]))) AS g FROM kb_w),
kb_c AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS phrase, g FROM kb_g),
kb_ct AS (SELECT doc_id, phrase, term, count(*) AS cnt FROM (SELECT doc_id, phrase, unnest(g) AS term FROM kb_c)
          GROUP BY doc_id, phrase, term),
kb_cw AS (SELECT c.doc_id, c.phrase, c.term, c.cnt * d.idf AS w, d.wd FROM kb_ct c JOIN kb_dw d USING (doc_id, term)),
kb_per AS (SELECT doc_id, phrase, list({{'term': term, 'w': w, 'wd': wd}} ORDER BY term) AS s FROM kb_cw GROUP BY doc_id, phrase),
kb_cand AS (
  SELECT p.doc_id, p.phrase,
         round({_sum('list_transform(p.s, lambda x1: x1.wd * x1.w)')} / (dn.dnorm * sqrt({_sum('list_transform(p.s, lambda x2: x2.w * x2.w)')})), 12) AS sim,
         list_transform(p.s, lambda x3: {{'term': x3.term, 'w': x3.w}}) AS terms,
         sqrt({_sum('list_transform(p.s, lambda x4: x4.w * x4.w)')}) AS norm
  FROM kb_per p JOIN kb_dn dn USING (doc_id))"""


def term_pair_sim(a: str, b: str) -> str:
    inner = (f"list_reduce(list_transform(list_filter({b}.terms, lambda pu: pu.term = pt.term), lambda pv: pv.w), "
             f"lambda pa, pb: pa + pb, 0.0::DOUBLE)")
    dot = f"list_reduce(list_transform({a}.terms, lambda pt: pt.w * {inner}), lambda pc, pd: pc + pd, 0.0::DOUBLE)"
    return f"round({dot} / ({a}.norm * {b}.norm), 12)"


def dense_pair_sim(a: str, b: str) -> str:
    dot = (f"list_reduce(list_transform(range(1, len({a}.vec) + 1), lambda di: {a}.vec[di] * {b}.vec[di]), "
           f"lambda da, db: da + db, 0.0::DOUBLE)")
    return f"round({dot} / ({a}.norm * {b}.norm), 12)"


def mmr_sql(arr: str, k: int, d: float, pair_sim) -> str:
    """Full MMR over ``arr`` (structs with name, sim, ... sorted by name):
    returns the picks list of {name, sim, score}.  Odd steps store the
    argmax, even steps fold it in (no per-element recomputation)."""
    one_minus = repr(1.0 - d)
    scores = (f"list_transform({arr}, lambda mx, mi: CASE WHEN list_contains(macc.sel, mi) THEN NULL "
              f"WHEN len(macc.sel) = 0 THEN mx.sim "
              f"ELSE {one_minus}::DOUBLE * mx.sim - {d!r}::DOUBLE * macc.ms[mi] END)")
    choose = (f"{{'sel': macc.sel, 'ms': macc.ms, 'picks': macc.picks, "
              f"'j': list_position({scores}, list_max({scores}))::INTEGER, 'best': list_max({scores})}}")
    chosen = f"{arr}[macc.j]"
    new_ms = f"list_transform(macc.ms, lambda mm, mk: greatest(mm, {pair_sim(f'{arr}[mk]', chosen)}))"
    fold = (f"{{'sel': list_append(macc.sel, macc.j), 'ms': {new_ms}, "
            f"'picks': list_append(macc.picks, {{'name': {chosen}.name, 'sim': {chosen}.sim, 'score': macc.best}}), "
            f"'j': macc.j, 'best': macc.best}}")
    init = (f"{{'sel': []::INTEGER[], 'ms': list_transform({arr}, lambda mz: 0.0::DOUBLE), "
            f"'picks': []::STRUCT(name VARCHAR, sim DOUBLE, score DOUBLE)[], 'j': 0::INTEGER, 'best': 0.0::DOUBLE}}")
    return (f"(list_reduce(range(1, 2 * least({k}, len({arr})) + 1), lambda macc, mstep: "
            f"CASE WHEN mstep % 2 = 1 THEN {choose} ELSE {fold} END, {init})).picks")


def _content(x: str) -> str:
    return f"(NOT list_contains({STOP_SQL}, {x}) AND length({x}) >= 3 AND NOT regexp_matches({x}, '^\\p{{N}}+$'))"


def textrank_cte(top_k: int = 20, window: int = 2, damping: float = 0.85, iterations: int = 10) -> str:
    """Needs ``tk_b2`` from tokens_cte; defines tr_top(doc_id, rank, phrase)."""
    pairs = ", ".join(f"list_transform(range(1, len(t) + 1), lambda pi{dd}: {{'a': t[pi{dd}], 'b': t[pi{dd} + {dd}]}})"
                      for dd in range(1, window + 1))
    base = repr(1.0 - damping)
    parts = [f"""
tr_t AS (SELECT doc_id, list_transform(toks, lambda tx: lower(tx)) AS t, toks FROM tk_b2 WHERE len(toks) > 0),
tr_p AS (SELECT doc_id, unnest(list_concat({pairs})) AS p FROM tr_t),
tr_pf AS (SELECT doc_id, p.a AS a, p.b AS b FROM tr_p
          WHERE p.b IS NOT NULL AND p.a <> p.b AND {_content('p.a')} AND {_content('p.b')}),
tr_e AS (SELECT doc_id, src, dst, count(*) AS w FROM (
           SELECT doc_id, a AS src, b AS dst FROM tr_pf UNION ALL SELECT doc_id, b, a FROM tr_pf) GROUP BY doc_id, src, dst),
tr_ow AS (SELECT doc_id, src, sum(w) AS ww FROM tr_e GROUP BY doc_id, src),
tr_en AS (SELECT e.doc_id, e.src, e.dst, e.w::DOUBLE / o.ww AS wn FROM tr_e e JOIN tr_ow o USING (doc_id, src)),
tr_nodes AS (SELECT DISTINCT doc_id, src AS term FROM tr_en),
tr_n AS (SELECT doc_id, count(*) AS n FROM tr_nodes GROUP BY doc_id),
tr_r0 AS (SELECT doc_id, term, n, 1.0::DOUBLE / n AS r FROM tr_nodes JOIN tr_n USING (doc_id))"""]
    for it in range(1, iterations + 1):
        parts.append(f"""
tr_r{it} AS (SELECT e.doc_id, e.dst AS term, any_value(r.n) AS n,
                    {base}::DOUBLE / any_value(r.n) + {damping!r}::DOUBLE * sum(r.r * e.wn) AS r
             FROM tr_en e JOIN tr_r{it - 1} r ON r.doc_id = e.doc_id AND r.term = e.src GROUP BY e.doc_id, e.dst)""")
    mark = "CHR(1)"
    parts.append(f"""
tr_runs AS (SELECT DISTINCT doc_id, phrase FROM (
    SELECT doc_id, unnest(regexp_split_to_array(array_to_string(list_transform(toks, lambda rx:
             CASE WHEN {_content('lower(rx)')} THEN lower(rx) ELSE {mark} END), ' '), ' ?\\x{{0001}} ?')) AS phrase
    FROM tr_t) WHERE phrase <> ''),
tr_words AS (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS term FROM tr_runs),
tr_sc AS (SELECT w.doc_id, w.phrase, sqrt(sum(coalesce(r.r, 0.0) * coalesce(r.r, 0.0)) / count(*)) AS score
          FROM tr_words w LEFT JOIN tr_r{iterations} r ON r.doc_id = w.doc_id AND r.term = w.term GROUP BY w.doc_id, w.phrase),
tr_top AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 10) DESC, phrase) AS rank
           FROM tr_sc QUALIFY rank <= {top_k})""")
    return ",".join(parts)
