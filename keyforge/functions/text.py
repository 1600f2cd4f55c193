"""Text and keyword-list normalisation as Spark Column expressions.

Every function takes and returns a ``Column`` so the whole chain stays in the
JVM (regex + higher-order functions) and fuses into one projection.  The
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.strip``/``str.split``
# (str.isspace): TAB LF VT FF CR, 1C-1F, space, 85, A0, 1680, 2000-200A,
# 2028, 2029, 202F, 205F, 3000.  Written as a regex class body that both Java
# regex and RE2 accept.
WS = (r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
      r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Same set without LF (line-local whitespace).
WS_NO_LF = (r"\x{0009}\x{000B}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# ASCII control characters deleted by the text cleaner (LF kept; CR deleted).
CTRL = r"[\x{0000}-\x{0009}\x{000B}-\x{001F}\x{007F}]"
# Characters trimmed from both ends of a keyword (KWD4).
KW_EDGE = "'\"“”‘’()\\[\\]{}\\-–—,:;"
# Word characters for tokens.
TOKEN_RE = r"[\p{L}\p{N}]+"
# Words with single spaces between them.  \z: ``$`` would let a last line end pass.
PLAIN = r"^[\p{L}\p{N}]++(?: [\p{L}\p{N}]++)*+\z"

def empty_strs():
    return F.array().cast("array<string>")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What full case folding does to lower-case characters: one for one, and one for several.  Built by rule.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold()}
FOLD_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
FOLD_MORE = {c: f for c, f in _FOLDS.items() if len(f) > 1}
_RARE = "".join(c for c in _FOLDS if c != "ß")


def fold(c) -> Column:
    """Full case folding, ``str.casefold``: lower case, then the characters that
    fold further (sharp s, ligatures, final sigma, Greek with iota).  Texts
    without the rare ones among them take no more than a replacement."""
    low = F.lower(col_(c))
    one = F.translate(low, "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    more = F.create_map(*(F.lit(x) for pair in FOLD_MORE.items() for x in pair))
    full = F.array_join(F.transform(F.split(one, "", -1), lambda x: F.coalesce(F.element_at(more, x), x)), "")
    # plain ASCII is settled by one small class; the rare ones are looked up, a
    # regex class would try all of them at every character
    return (F.when(~low.rlike(r"[^\x{0000}-\x{007F}]"), low).when(F.translate(low, _RARE, "") != low, full)
            .otherwise(F.replace(low, F.lit("ß"), F.lit("ss"))))


def strip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace on both ends."""
    return F.regexp_replace(col_(c), f"^[{WS}]+|[{WS}]+$", "")


def clean_text(c) -> Column:
    """TXT1 ``_clean_single``: delete control characters (TAB included, LF
    kept) and CR, collapse runs of spaces, strip every line, strip the whole."""
    t = F.regexp_replace(col_(c), CTRL, "")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, f"[{WS_NO_LF}]*\n[{WS_NO_LF}]*", "\n")
    return strip(t)


def first_by_fold(items: Column) -> Column:
    """Keep the first spelling of every case-folded value, order kept: sort by
    (fold, place), keep the first of each fold, sort back by place."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(fold(x).alias("k"), i.alias("i"), x.alias("x"))))

    def firsts(s):
        kept = F.filter(s, lambda e, i: (i == 0) | ~e["k"].eqNullSafe(F.get(s, i - 1)["k"]))
        back = F.sort_array(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
        return F.transform(back, lambda e: e["x"])

    # The one-element array computes the sorted list once for all its elements.
    return F.get(F.transform(F.array(keyed), firsts), F.lit(0))


def dedup_ci(arr) -> Column:
    """KWD1 ``_dedup_preserve_order``: strip, drop blanks, keep the first
    spelling of every case-folded value, order kept."""
    items = F.filter(F.transform(col_(arr), strip), lambda x: x.isNotNull() & (x != ""))
    return first_by_fold(items)


def clean_phrases(arr) -> Column:
    """TXT2 ``clean_key_phrase`` on a list: clean every non-blank string."""
    return F.transform(F.filter(col_(arr), lambda x: x.isNotNull() & (strip(x) != "")),
                       clean_text)


def to_keywords(key) -> Column:
    """TXT3 ``to_keywords``: LF-separated string (or an array) to a clean,
    de-duplicated keyword list."""
    k = col_(key)
    arr = F.coalesce(F.split(k, "\n", -1), empty_strs())
    cleaned = F.filter(clean_phrases(arr), lambda x: x != "")
    return dedup_ci(cleaned)


def to_keywords_array(arr) -> Column:
    """TXT3 for an array-typed ``key`` column (accepted, see Q6)."""
    cleaned = F.filter(clean_phrases(F.coalesce(col_(arr), empty_strs())),
                       lambda x: x != "")
    return dedup_ci(cleaned)


def normalize_kw_string(s) -> Column:
    """KWD2: null -> []; split on LF, ';' and ','; strip; drop blanks; KWD1."""
    parts = F.coalesce(F.split(col_(s), "[\n;,]", -1), empty_strs())
    return dedup_ci(parts)


def to_keyword_list(c, dtype: str) -> Column:
    """KWD3 ``_to_keyword_list``: arrays are stripped item-wise, scalars are
    split like KWD2; the branch is chosen from the column type at plan time."""
    if dtype.startswith("array"):
        items = F.transform(F.coalesce(col_(c), F.array().cast(dtype)),
                            lambda x: x.cast("string"))
        return dedup_ci(items)
    return normalize_kw_string(col_(c).cast("string"))


def clean_kw(c) -> Column:
    """KWD4 ``_clean_kw``: whitespace runs -> one space, strip, trim quote /
    bracket / dash / ``,:;`` runs at both ends, strip.  Words with single
    spaces between them, as most keywords are, take one look."""
    s = strip(F.regexp_replace(col_(c), f"[{WS}]+", " "))
    s = F.regexp_replace(s, f"^[{KW_EDGE}]+|[{KW_EDGE}]+$", "")
    return F.when(col_(c).rlike(PLAIN), col_(c)).otherwise(strip(s))


def postprocess(arr, lowercase: bool = False, min_len: int = 2,
                max_len: int | None = None, dedupe: bool = True) -> Column:
    """KWD5 ``_postprocess``: KWD4 each item, optional lower-case, length
    bounds, optional case-insensitive de-duplication (order kept)."""
    items = F.transform(col_(arr), clean_kw)
    if lowercase:
        items = F.transform(items, F.lower)

    def keep(x):
        cond = (x != "") & (F.length(x) >= min_len)
        if max_len is not None:
            cond = cond & (F.length(x) <= max_len)
        return cond

    items = F.filter(items, keep)
    if dedupe:
        items = first_by_fold(items)
    return items


def join_keywords(arr, sep: str = "; ") -> Column:
    """KWD6 ``_join_keywords``: KWD4 each, drop empties, join with ``'; '``."""
    return F.array_join(F.filter(F.transform(col_(arr), clean_kw), lambda x: x != ""), sep)


def word_count(c) -> Column:
    """TXT4 ``len(text.split())``."""
    return F.coalesce(F.regexp_count(col_(c), F.lit(f"[^{WS}]+")), F.lit(0)).cast("bigint")


def remove_newlines(c) -> Column:
    """TXT5 ``remove_newlines``: LF -> ';' (non-strings -> '')."""
    return F.coalesce(F.replace(col_(c), F.lit("\n"), F.lit(";")), F.lit(""))


def remove_tabs(c) -> Column:
    """TXT5 ``remove_tabs``: TAB -> space (non-strings -> '')."""
    return F.coalesce(F.replace(col_(c), F.lit("\t"), F.lit(" ")), F.lit(""))


def sentences(c) -> Column:
    """Sentence split used by TXT6/CHK2: break after ``.``, ``!`` or ``?``
    followed by whitespace, and at every LF; pieces are stripped, empties
    dropped."""
    marked = F.regexp_replace(strip(col_(c)), f"([.!?])[{WS}]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n", -1), strip), lambda x: x != "")


def keep_punctuated_sentences(c) -> Column:
    """TXT6 ``clean_text``: keep only sentences that end in ASCII punctuation
    (drops titles), joined by LF."""
    return F.array_join(
        F.filter(sentences(c), lambda s: F.substring(s, -1, 1).rlike(r"^[!-/:-@\[-`{-~]$")),
        "\n")
