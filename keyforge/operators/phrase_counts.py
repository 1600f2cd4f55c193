"""In how many documents of the corpus each phrase of a document is.

Nothing is written or shuffled per document and phrase.  Documents are dealt
into packs by a hash of their id; a pack sends its distinct phrases once, as
compressed text in buckets by a hash of the phrase, each with the number of
the pack's documents that hold it.  A bucket meets the texts of all packs,
adds up and answers every pack with numbers alone, in the order in which they
were sent.  The pack then cuts its documents again and reads the answer by
place.  Phrases are compared as texts, so counts are exact.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyforge.operators import batches as B
from keyforge.operators.yake import phrase_names
from keyforge.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a pack's documents and of the documents for which there is one bucket, about.
PACK, BUCKET = 1_500_000, 8_000_000


class _Sent:
    """The distinct phrases of a pack by bucket, in an order that the pack alone settles."""

    def __init__(self, words: np.ndarray, terms: list, buckets: int):
        order = np.lexsort(words.T[::-1])
        words = words[order]
        new = np.ones(len(words), dtype=bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        words, number = words[new], np.cumsum(new) - 1
        hashes = np.array([*(zlib.crc32(t.encode()) for t in terms), 0], dtype=np.uint64)  # the last is that of no word
        h = np.full(len(words), 7, dtype=np.uint64)
        for col in words.T:
            h = (h ^ hashes[col]) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        #: the place of each phrase of the pack among those sent
        self.at = np.empty(len(order), dtype=np.int64)
        self.at[order] = place[number]
        self.words, self.bucket, self.count = words[by], bucket[by], np.bincount(number, minlength=len(by))[by]

    def rows(self, pack: int, names: pa.Array) -> pa.RecordBatch:
        b, n = np.unique(self.bucket, return_counts=True)
        texts = pc.binary_join(B.in_lists(n, phrase_names(names, self.words)), "\n").to_pylist()
        counts = np.split(self.count.astype(np.uint32), np.cumsum(n)[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int64()), pa.array(np.full(len(b), pack), pa.int64()), pa.array([_small(t.encode()) for t in texts], pa.binary()),
             pa.array([_small(c.tobytes()) for c in counts[:len(b)]], pa.binary())], ["b", "g", "text", "n"])


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _large(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def _answers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the buckets of a batch answer: (g, b, n)."""
    out = []
    offsets, sent = B.parts(batch["sent"])
    for bucket, a, b in zip(batch["b"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
        mine = sent.slice(a, b - a)
        texts = pc.split_pattern(pa.array([_large(x).decode() for x in mine.field("text").to_pylist()], pa.large_string()), "\n")
        count = np.concatenate([np.frombuffer(_large(x), dtype=np.uint32) for x in mine.field("n").to_pylist()])
        code = texts.values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        total = np.bincount(code, weights=count)[code].astype(np.uint32)
        ends = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))[:-1]
        out += [(g, bucket, _small(x.tobytes())) for g, x in zip(mine.field("g").to_pylist(), np.split(total, ends), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g", "b", "n"])


def _packs(df: DataFrame, fn: Callable[[dict, pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``fn`` of every pack: its other columns and the table of its documents."""
    B.small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, docs = B.parts(batch["docs"])
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                yield fn({c: batch[c][i].as_py() for c in batch.schema.names if c != "docs"}, pa.RecordBatch.from_struct_array(docs.slice(a, b - a)))

    return df.mapInArrow(run, schema)


def counted(t: DataFrame, size: int, phrases: Callable, rows: Callable, schema: str | T.StructType) -> DataFrame:
    """``rows(batch, found, df)`` of the documents in ``t``, one row per id, of
    about ``size`` characters.  ``found = phrases(batch)`` has the phrases of
    the batch, once per document, as ``words`` (numbers of ``terms``, -1: none;
    numbers in the order of the terms); ``df`` is the number of rows of ``t``
    that have each."""
    n_packs, buckets = 1 + size // PACK, 1 + size // BUCKET
    packs = written(t.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(n_packs)).alias("g"))
                    .agg(F.sort_array(F.collect_list(F.struct(*t.columns))).alias("docs")), "packs")

    def send(pack: dict, docs: pa.RecordBatch) -> pa.RecordBatch:
        found = phrases(docs)
        return _Sent(found.words, found.terms, buckets).rows(pack["g"], found.names)

    sent = _packs(packs, send, "b long, g long, text binary, n binary")
    answers = B.map_batches(sent.groupBy("b").agg(F.collect_list(F.struct("g", "text", "n")).alias("sent")), _answers, "g long, b long, n binary")
    answers = answers.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("answers"))

    def read(pack: dict, docs: pa.RecordBatch) -> pa.RecordBatch:
        found = phrases(docs)
        df = np.frombuffer(b"".join(_large(x["n"]) for x in pack["answers"] or ()), dtype=np.uint32).astype(np.int64)
        return rows(docs, found, df[_Sent(found.words, found.terms, buckets).at])

    return _packs(packs.join(answers, "g", "left"), read, schema)
