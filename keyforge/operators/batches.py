"""Token statistics of whole documents, many documents at a time.

Spark deals the documents by ``doc_id``, brings the texts of one id into one
row and cuts them into tokens (``token_rows``); the functions here take an
Arrow batch of such rows as flat arrays, one entry per token, and count, sum
and rank inside documents with numpy.  Nothing is exploded, sorted or shuffled
per token; a batch is bounded by rows and bytes (``small_batches``).  Whatever
needs the corpus (document frequencies, vocabularies) stays a Spark job.

Terms of a batch are numbered in code point order, so comparing numbers
compares terms, and comparing the numbers of a phrase's terms compares
phrases: every character of a term sorts behind the space between terms.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, BYTES = 400, 4 << 20


def small_batches(df: DataFrame) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def packed(words: Column) -> Column:
    """Words, which hold no space, as one string: half the bytes of an array in a shuffle."""
    return F.array_join(words, " ")


def unpacked(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def typed(df: DataFrame, rest: str, key: str = "doc_id") -> T.StructType:
    """The key as ``df`` has it, then the fields of ``rest``."""
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(rest).fields])


# --- batches as flat arrays ----------------------------------------------------

def parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the flat values of a list array without nulls."""
    if not len(lists):  # the JVM may send no offsets then, and what is read is arbitrary
        return np.zeros(1, dtype=np.int64), lists.values.slice(0, 0)
    o = lists.offsets.to_numpy().astype(np.int64)
    return o - o[0], lists.values.slice(o[0], o[-1] - o[0])


def owner(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def in_lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def structs(**cols) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))


def one_array(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def numbered(strings: pa.Array, change: Callable | None = None) -> tuple[np.ndarray, list, np.ndarray, list]:
    """(code of each string, the distinct strings, number of each code's term,
    the terms in code point order); ``change`` makes a term of a string."""
    d = one_array(strings).dictionary_encode()
    raw = d.dictionary.to_pylist()
    low = [change(x) for x in raw] if change else raw
    terms = sorted(set(low))
    place = {t: i for i, t in enumerate(terms)}
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), raw, np.array([place[x] for x in low], dtype=np.int64), terms


def distinct(keys: np.ndarray):
    """np.unique with first places, inverse and counts."""
    return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)


def rank_in(groups: np.ndarray) -> np.ndarray:
    """0-based place of every entry in its run of equal, sorted ``groups``."""
    if not len(groups):
        return groups
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up, as Spark's ``round`` does."""
    with np.errstate(invalid="ignore"):
        return np.sign(x) * np.floor(np.abs(x) * 10.0 ** digits + 0.5) / 10.0 ** digits


# --- characters ------------------------------------------------------------------

def is_number(s: str) -> bool:
    return s.isdigit() if s.isascii() else all(unicodedata.category(c)[0] == "N" for c in s)


def has_number(s: str) -> bool:
    return any(unicodedata.category(c)[0] == "N" for c in s)


def has_letter(s: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in s)


def no_word(s: str) -> bool:
    """A number, or letters and numbers mixed."""
    return (not s.isalpha() if s.isascii() else has_number(s)) and (is_number(s) or has_letter(s))


def is_upper(s: str) -> bool:
    return s.isalpha() and s.isupper() if s.isascii() else all(unicodedata.category(c) == "Lu" for c in s)


def is_title(s: str) -> bool:
    return unicodedata.category(s[0]) == "Lu"


class Tokens:
    """The tokens of a batch.  ``nested`` holds per row copies (texts with one
    id) of sentences of blocks of tokens."""

    def __init__(self, nested: pa.ListArray):
        self.n = len(nested)
        copy_o, copies = parts(nested)
        sent_o, sents = parts(copies)
        block_o, blocks = parts(sents)
        tok_o, toks = parts(blocks)
        copy_doc, sent_copy, block_sent, self.block = owner(copy_o), owner(sent_o), owner(block_o), owner(tok_o)
        self.twice = bool((np.diff(copy_o) > 1).any())
        self.n_sent = np.zeros(self.n, dtype=np.int64)
        np.maximum.at(self.n_sent, copy_doc, np.diff(sent_o))
        sent = block_sent[self.block]
        self.doc = copy_doc[sent_copy[sent]]
        self.sid = sent - sent_o[sent_copy[sent]]
        self.bid = self.block - block_o[sent]
        self.tid = np.arange(len(self.block)) - tok_o[self.block]
        self.code, self.raw, term_of, self.terms = numbered(toks, str.lower)
        self.term = term_of[self.code] if len(self.code) else self.code
        self.names = pa.array(self.terms, pa.string())

    def flag(self, test: Callable[[str], bool]) -> np.ndarray:
        """``test`` of every token as written."""
        return np.array([test(x) for x in self.raw], dtype=bool)[self.code] if self.raw else np.zeros(0, dtype=bool)

    def of_terms(self, test: Callable[[str], bool]) -> np.ndarray:
        return np.array([test(x) for x in self.terms], dtype=bool)

    def pairs(self, d: int) -> np.ndarray:
        """Places of the tokens that have another ``d`` behind them in their block."""
        return np.flatnonzero(self.block[:-d] == self.block[d:]) if d < len(self.block) else np.zeros(0, dtype=np.int64)
