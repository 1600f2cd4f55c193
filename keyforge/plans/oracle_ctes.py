"""Shared DuckDB CTEs for the oracle SQL (fixtures of FIXTURES.md §3)."""

from __future__ import annotations

from keyforge.functions.text import TOKEN_RE
from keyforge.plans import duck as D


def long_tokens_cte(name: str = "ltok", first_half: bool = False) -> str:
    half = "WHERE (pos + 1) * 2 <= n" if first_half else ""
    return f"""
{name}_arr AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {D.q(TOKEN_RE)}), lambda lx: lower(lx)),
                             lambda ly: length(ly) >= 4) AS toks
  FROM documents),
{name}_pos AS (
  SELECT doc_id, len(toks) AS n, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM {name}_arr),
{name}_cnt AS (
  SELECT doc_id, tok, count(*) AS cnt FROM {name}_pos {half} GROUP BY doc_id, tok),
{name}_rk AS (
  SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, tok) AS rn FROM {name}_cnt
  QUALIFY rn <= 8),
{name} AS (
  SELECT doc_id, list(tok ORDER BY rn) AS toks FROM {name}_rk GROUP BY doc_id)"""


def kw_raw_cte() -> str:
    return long_tokens_cte("top8") + f""",
kw_raw AS (
  SELECT d.doc_id, d.text,
         CASE WHEN t.toks IS NULL THEN '' ELSE
           array_to_string(t.toks, chr(10)) || chr(10) || upper(replace(t.toks[1], 'ß', 'ss')) || chr(10) || chr(10)
         END AS key,
         d.source AS dataset
  FROM documents d LEFT JOIN top8 t USING (doc_id))"""


def gold_cte() -> str:
    """kw_raw plus gold(doc_id, ref)."""
    return kw_raw_cte() + f""",
gold AS (SELECT doc_id, {D.to_keywords('key')} AS ref FROM kw_raw)"""


def kw_pairs_cte(with_gold: bool = True) -> str:
    head = gold_cte() + "," if with_gold else ""
    return head + long_tokens_cte("half8", first_half=True) + """,
kw_pairs AS (
  SELECT g.doc_id, coalesce(h.toks, []::VARCHAR[]) AS pred, g.ref
  FROM gold g LEFT JOIN half8 h USING (doc_id))"""


def responses_cte() -> str:
    return long_tokens_cte("rtop") + """,
responses AS (
  SELECT d.doc_id,
    CASE WHEN t.toks IS NULL THEN 'none'
         WHEN d.doc_id % 3 = 0 THEN 'Here are the keywords for the document.' || chr(10) || '['
              || array_to_string(list_transform(t.toks, lambda qt: '"' || qt || '"'), ', ') || ']'
         WHEN d.doc_id % 3 = 1 THEN 'Keywords:' || chr(10)
              || array_to_string(list_transform(t.toks, lambda lt, li:
                   CASE WHEN (li - 1) % 2 = 0 THEN '- ' || lt ELSE CAST(li AS VARCHAR) || '. ' || lt END), chr(10))
              || chr(10) || chr(10) || 'Note: extracted from the text'
         ELSE 'none' END AS response
  FROM documents d LEFT JOIN rtop t USING (doc_id))"""


# --- metric fragments ------------------------------------------------------

def rouge_tokens(arr: str) -> str:
    return f"regexp_extract_all(lower({D.join_keywords(arr)}), '[a-z0-9]+')"


def set_counts(pred: str, ref: str) -> tuple[str, str, str]:
    ps = f"list_distinct(list_transform(coalesce({pred}, []::VARCHAR[]), lambda fa: {D.fold('fa')}))"
    rs = f"list_distinct(list_transform(coalesce({ref}, []::VARCHAR[]), lambda fb: {D.fold('fb')}))"
    tp = f"len(list_filter({ps}, lambda fc: list_contains({rs}, fc)))::BIGINT"
    fp = f"len(list_filter({ps}, lambda fd: NOT list_contains({rs}, fd)))::BIGINT"
    fn = f"len(list_filter({rs}, lambda fe: NOT list_contains({ps}, fe)))::BIGINT"
    return tp, fp, fn


def fmeasure(hits: str, n: str, m: str) -> str:
    p = f"(({hits})::DOUBLE / greatest({n}, 1))"
    r = f"(({hits})::DOUBLE / greatest({m}, 1))"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def rouge1(pt: str, rt: str) -> str:
    hits = (f"list_reduce(list_distinct({pt}), lambda ra, rx: ra + least(len(list_filter({pt}, lambda ry: ry = rx)), "
            f"len(list_filter({rt}, lambda rz: rz = rx))), 0::BIGINT)")
    return f"(CASE WHEN len({pt}) = 0 THEN 0.0 ELSE {fmeasure(hits, f'len({pt})', f'len({rt})')} END)"


def lcs(pt: str, rt: str) -> str:
    m = f"len({rt})"
    steps = f"list_transform({pt}, lambda lp: list_filter(range(1, greatest({m}, 1) + 1), lambda lk: {rt}[lk] = lp))"
    cell = ("CASE WHEN list_max(list_filter(lpos, lambda lq: lq <= lj)) IS NULL THEN lo "
            "ELSE greatest(lo, CASE WHEN list_max(list_filter(lpos, lambda lq: lq <= lj)) <= 1 THEN 0 "
            "ELSE lold[list_max(list_filter(lpos, lambda lq: lq <= lj)) - 1] END + 1) END")
    final = (f"list_reduce({steps}, lambda lold, lpos: list_transform(lold, lambda lo, lj: {cell}), "
             f"list_transform(range({m}), lambda lz: 0))")
    return f"(CASE WHEN {m} > 0 THEN ({final})[-1] ELSE 0 END)"


def rougeL(pt: str, rt: str) -> str:
    return (f"(CASE WHEN len({pt}) = 0 OR len({rt}) = 0 THEN 0.0 ELSE "
            f"{fmeasure(lcs(pt, rt), f'len({pt})', f'len({rt})')} END)")


def stemmed_tokens(src: str, keys: str = "doc_id") -> str:
    """``stemmed``: the rows of ``src`` (``keys``, token lists ``pt`` and ``rt``) with stems for tokens."""
    def side(c: str) -> str:
        return f"""(SELECT {keys}, list(stem ORDER BY pos) AS {c} FROM (
          SELECT {keys}, unnest({c}) AS token, unnest(range(len({c}))) AS pos FROM {src}) JOIN stems USING (token) GROUP BY {keys}) s_{c}"""
    return f"""
st_words AS (SELECT unnest(list_concat(pt, rt)) AS token FROM {src}),
{D.stem_ctes('st_words')},
stemmed AS (SELECT src.* EXCLUDE (pt, rt), coalesce(s_pt.pt, []::VARCHAR[]) AS pt, coalesce(s_rt.rt, []::VARCHAR[]) AS rt
            FROM {src} src LEFT JOIN {side('pt')} USING ({keys}) LEFT JOIN {side('rt')} USING ({keys}))"""
