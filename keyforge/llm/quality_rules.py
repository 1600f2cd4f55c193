"""Quality rules by weak supervision (operator 7), in DataFrame functions only.

Each rule reads a few statistics of a document and votes "bad" or "good", or
abstains: rules for one defect vote on texts that show it, two rules vote for
plain and for varied text and abstain on texts with any defect, which they
would outvote without having looked for it.  Documents are counted by their pattern of votes
(at most 2 ** rules patterns, whatever the number of documents).  Expectation
maximisation over those counts estimates, without labels, how often each rule
is right when it votes; votes are taken as independent given the truth, and an
abstention says nothing.  A document is kept if the posterior probability that
it is good is at least one half (as it is without any vote), and it does not
fail the fixed base rules.

Words are runs of characters other than ASCII white space.  Null and empty
texts have no words, fail the base rules and are not kept.  The estimation
looks at documents of ``MIN_WORDS`` words or more; without any, all votes
weigh nothing.  Repeated 3-word windows are found by sorting hashes of the
windows inside the row, so no text is shuffled and long texts cost n log n.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyforge.llm.common import SPACE_CHARS, SPACE_CLASS, no_null, written

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Accuracy that a rule starts with, and the bounds of its estimate.
START, LEAST, MOST = 0.9, 0.55, 0.99
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the statistics that the rules read, named with ``prefix``."""
    p, columns = prefix, docs.columns
    text = no_null(text_col)
    d = docs.withColumns({
        p + "words": F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != ""),
        p + "lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)})
    words, lines = F.col(p + "words"), F.col(p + "lines")
    d = d.withColumns({
        p + "n_words": F.size(words).cast("bigint"),
        p + "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint"),
        p + "n_symbols": _count(text, SYMBOLS).cast("bigint"),
        p + "n_upper": _count(text, UPPER).cast("bigint"),
        p + "n_calls": _count(text, "!").cast("bigint"),
        p + "n_bars": _count(text, "|").cast("bigint"),
        p + "n_lines": F.size(lines).cast("bigint"),
        p + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        p + "n_distinct": F.size(F.array_distinct(words)).cast("bigint"),
        p + "n_adjacent": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("bigint"),
        p + "windows": F.when(F.size(words) >= 3, F.transform(
            F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))})
    windows = F.col(p + "windows")
    d = d.withColumn(p + "sorted", F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    order = F.col(p + "sorted")
    again = F.filter(order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    d = d.withColumn(p + "n_repeat_words", covered)
    # A generator of one row: conditions on its columns are not pushed below it, which would repeat all of the above.
    return d.select(*columns, F.inline(F.array(F.struct(*[F.col(p + c) for c in (*BASE, "n_upper", "n_calls", "n_bars", "n_lines", "n_distinct", "n_adjacent")]))))


def rules(p: str = "") -> dict[str, tuple[Column | None, Column | None]]:
    """Name: when a rule votes "bad", and when "good"; otherwise it abstains.
    A rule that looks for one defect has nothing to say about texts without it."""
    c = lambda name: F.col(p + name)
    words, chars = c("n_words"), c("word_chars")
    plain = (c("n_symbols") < 0.04 * chars) & (c("n_upper") < 0.2 * chars) & (c("n_calls") < 0.1 * words) & (c("n_bars") < 0.02 * words)
    varied = (c("n_repeat_words") < 0.2 * words) & (c("n_adjacent") < 0.05 * words) & (c("n_distinct") > 0.35 * words)
    defects = {
        "symbols": (c("n_symbols") > 0.12 * chars, None),
        "capitals": (c("n_upper") > 0.5 * chars, None),
        "calls": (c("n_calls") > 0.3 * words, None),
        "bars": (c("n_bars") > 0.2 * words, None),
        "repeats": (c("n_repeat_words") > 0.4 * words, None),
        "adjacent": (c("n_adjacent") > 0.2 * words, None),
        "lines": (c("n_dup_lines") > 0.3 * c("n_lines"), None),
        "variety": ((words >= MIN_WORDS) & (c("n_distinct") < 0.15 * words), None),
        "word_length": ((chars < 2 * words) | (chars > 14 * words), None),
    }
    sound = ~functools.reduce(operator.or_, [bad for bad, _ in defects.values()])
    return defects | {"plain": (None, sound & plain), "varied": (None, sound & plain & varied)}


def votes(p: str = "") -> Column:
    """One character per rule: b, g or a."""
    return F.concat(*[F.when(F.lit(False) if bad is None else bad, "b").when(F.lit(False) if good is None else good, "g").otherwise("a") for bad, good in rules(p).values()])


def base_failed(p: str = "") -> Column:
    words = F.col(p + "n_words")
    return (words < MIN_WORDS) | (100 * F.col(p + "n_repeat_words") > 50 * words)


def estimate(patterns: dict[str, int], rounds: int = 100, smoothing: float = 10.0) -> list[float]:
    """Accuracy of each rule when it votes, by expectation maximisation over
    counted patterns.  Before the votes either truth is held equally likely."""
    k = len(next(iter(patterns), ""))
    accuracy = [START] * k
    for _ in range(rounds):
        right, seen = [smoothing * START] * k, [smoothing] * k
        for pattern, n in sorted(patterns.items()):
            good = posterior(accuracy, pattern)
            for r, v in enumerate(pattern):
                if v != "a":
                    seen[r] += n
                    right[r] += n * (good if v == "g" else 1 - good)
        after = [min(max(x / y, LEAST), MOST) for x, y in zip(right, seen, strict=True)]
        moved = max((abs(x - y) for x, y in zip(after, accuracy, strict=True)), default=0.0)
        accuracy = after
        if moved < 1e-12:
            break
    return accuracy


def posterior(accuracy: list[float], pattern: str) -> float:
    odds = sum((1 if v == "g" else -1) * math.log(a / (1 - a)) for a, v in zip(accuracy, pattern, strict=False) if v != "a")
    return 1 / (1 + math.exp(-odds))


def quality(accuracy: list[float], pattern: Column) -> Column:
    """Posterior probability that a document with these votes is good."""
    odds = F.lit(0.0)
    for r, a in enumerate(accuracy):
        weight = math.log(a / (1 - a))
        v = F.substring(pattern, r + 1, 1)
        odds = odds + F.when(v == "g", weight).when(v == "b", -weight).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def learn(stats: DataFrame, p: str = "") -> list[float]:
    """The model of a table with statistics; only counted patterns reach the driver."""
    counted = stats.where(F.col(p + "n_words") >= MIN_WORDS).groupBy(votes(p).alias("v")).count()
    return estimate({v: n for v, n in counted.collect()})


def document_quality(docs: DataFrame) -> DataFrame:
    """Base statistics, base verdict, posterior and verdict of every document."""
    stats = written(statistics(docs.select("doc_id", "text")).drop("text"))
    model = learn(stats)
    good = quality(model, votes())
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & (good >= 0.5)).alias("kept"), good.alias("quality"))


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.  The texts are read twice
    rather than written or shuffled."""
    p = "__rule_"
    model = learn(statistics(docs.select(text_col), text_col, p), p)
    stats = statistics(docs, text_col, p)
    return stats.where(~base_failed(p) & (quality(model, votes(p)) >= 0.5)).select(*docs.columns)
