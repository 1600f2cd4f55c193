"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping",
Program 14(3), 1980) for ROUGE with stemming (AGG5).

``stem_table`` stems a table of distinct tokens with column expressions: the
measure and vowel conditions of the algorithm are regular expressions over
consonant and vowel runs, its suffix rules are lists, and each step is one
projection, so the work stays in the JVM.  ``stem`` is the same algorithm
letter by letter; tests hold the two against each other.

Following the ROUGE scorer, only tokens longer than 3 characters are
stemmed.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiou")


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in ``stem``."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        while i < L and _cons(stem, i):
            i += 1
        n += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


# The suffix rules of steps 2, 3 and 4 of the algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    # Step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # Step 1b
    extra = False
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # Step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # Steps 2 and 3
    w = _replace(w, _STEP2, lambda s: _m(s) > 0)
    w = _replace(w, _STEP3, lambda s: _m(s) > 0)
    # Step 4
    for suf in _STEP4:
        if w.endswith(suf):
            s = w[: len(w) - len(suf)]
            if _m(s) > 1 and (suf != "ion" or (s and s[-1] in "st")):
                w = s
            break
    # Step 5a
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    # Step 5b
    if _m(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stem_token(t: str) -> str:
    return stem(t) if len(t) > 3 else t


# Runs of consonants and of vowels.  A y behind a consonant is a vowel; one at
# the start of a word is a consonant and is written Y while the word is stemmed.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_1, MEASURE_2 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}"
MEASURE_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
#: What a doubled consonant that loses one letter ends with; of a run of y every other one is a consonant.
DOUBLE_END = "[^aeiouylsz]$|[^aeiouy](yy)+$|[aeiou]y(yy)+$"
SUFFIX_RULES = {"2": _STEP2, "3": _STEP3, "4": [(s, "") for s in _STEP4]}


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _doubled(w: Column) -> Column:
    return F.substring(w, F.length(w), F.lit(1)) == F.substring(w, F.length(w) - 1, F.lit(1))


def _rules(w: Column, rules: list, measure: str) -> Column:
    out = None
    for suffix, new in rules:
        base = _cut(w, len(suffix))
        ok = base.rlike(measure) & (base.rlike("[st]$") if suffix == "ion" else F.lit(True))
        to = F.when(ok, F.concat(base, F.lit(new))).otherwise(w)
        out = F.when(w.endswith(suffix), to) if out is None else out.when(w.endswith(suffix), to)
    return out.otherwise(w)


def stem_table(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, stem) of a table of distinct lower-case tokens."""
    w = F.col("w")
    t = tokens.select(token, F.regexp_replace(token, "^y", "Y").alias("w"))
    steps = [F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)]
    for step in steps:
        t = t.withColumn("w", step)
    ed, ing = w.endswith("ed") & _cut(w, 2).rlike(HAS_VOWEL), w.endswith("ing") & _cut(w, 3).rlike(HAS_VOWEL)
    t = t.withColumn("bare", ~w.endswith("eed") & (ed | ing)).withColumn(
        "w", F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(MEASURE_1), _cut(w, 1)).otherwise(w)).when(ed, _cut(w, 2)).when(ing, _cut(w, 3)).otherwise(w))
    mended = (F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(_doubled(w) & w.rlike(DOUBLE_END), _cut(w, 1))
              .when(w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w))
    t = t.withColumn("w", F.when(F.col("bare"), mended).otherwise(w)).drop("bare")
    t = t.withColumn("w", F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    for name, measure in (("2", MEASURE_1), ("3", MEASURE_1), ("4", MEASURE_2)):
        t = t.withColumn("w", _rules(w, SUFFIX_RULES[name], measure))
    base = _cut(w, 1)
    t = t.withColumn("w", F.when(w.endswith("e") & (base.rlike(MEASURE_2) | base.rlike(MEASURE_IS_1) & ~base.rlike(SHORT)), base).otherwise(w))
    t = t.withColumn("w", F.when(w.endswith("ll") & w.rlike(MEASURE_2), _cut(w, 1)).otherwise(w))
    done = F.regexp_replace("w", "^Y", "y")
    return t.select(token, F.when(F.length(token) > 3, done).otherwise(F.col(token)).alias("stem"))
