"""Byte-level BPE by corpus-level merge replay (operator 3).

Each task takes the distinct pre-token words of a block of its documents as
one corpus.  An inverted index maps each mergeable token pair (named by the
token it makes) to the positions of its left tokens.  Merges are replayed in
rank order over the whole index; a merge touches only the pairs of its two
neighbours.  If a merge creates a pair that ranks no later than the one being
replayed, the rest of that pair goes back into the index, so every word sees
exactly the order "lowest rank, then leftmost" that a word-by-word encoder
applies.  Words share no pairs, so any division of the corpus into blocks
gives the same ids.  Encoded words are reused through a bounded cache.

A block is one Arrow batch, so memory follows the batch; the table of pairs is
fixed by the vocabulary, and a worker process builds it once.  Encoding and
decoding share one pass.  Null and empty texts have no tokens.  Texts are never
cut; ids are stored as little-endian unsigned 32-bit integers.  Output columns
take the place of columns of the same name; other columns stay.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyforge.llm.common import ship, small_batches

ship(__name__)

#: Characters of the words kept encoded in one worker.
CACHE_CHARS = 6_000_000
#: A block: rows, and bytes of text.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


class Vocabulary:
    """Token bytes and ranks of a rank file (base64 token, rank per line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        #: The token that two tokens make: every way to part a token of the vocabulary in two.
        self.pairs = {self.ranks[t[:k]] << 32 | self.ranks[t[k:]]: r
                      for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.words: dict[str, bytes] = {}
        self.cached = 0
        self.bytes = pa.array(self.token, pa.binary())

    def made_by(self, left: int, right: int) -> int:
        """The token that two tokens merge into, or -1."""
        return self.pairs.get(left << 32 | right, -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as packed integers, by replaying merges over all words."""
        tok: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(tok))
            tok += [self.byte[b] for b in w]
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for k in starts:
            before[k] = -1
            if k:
                after[k - 1] = -1
        if n:
            after[n - 1] = -1
        index: dict[int, list[int]] = {}
        made_by = self.made_by
        for p in range(n):
            if (q := after[p]) >= 0 and (r := made_by(tok[p], tok[q])) >= 0:
                index.setdefault(r, []).append(p)
        order = list(index)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            places = sorted(index.pop(rank, ()))
            for k, p in enumerate(places):
                if tok[p] < 0 or (q := after[p]) < 0 or made_by(tok[p], tok[q]) != rank:
                    continue  # a neighbour's merge has taken one of the two
                tok[p], tok[q] = rank, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                earlier = False
                for left in (before[p], p):
                    if left >= 0 and (right := after[left]) >= 0 and (r := made_by(tok[left], tok[right])) >= 0:
                        earlier = earlier or r <= rank
                        if r not in index:
                            index[r] = []
                            heapq.heappush(order, r)
                        index[r].append(left)
                if earlier:
                    if rest := places[k + 1:]:
                        if rank not in index:
                            index[rank] = []
                            heapq.heappush(order, rank)
                        index[rank] += rest
                    break
        out = []
        for p in starts:
            ids = []
            while p >= 0:
                ids.append(tok[p])
                p = after[p]
            out.append(np.array(ids, dtype="<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.pattern.findall(t) for t in texts]
        if self.cached > CACHE_CHARS:
            self.words.clear()
            self.cached = 0
        new = sorted({w for p in parts for w in p if w not in self.words})
        self.cached += sum(map(len, new))
        replayed = []
        for w in new:
            b = w.encode()
            if b in self.ranks:  # a word of the vocabulary is its own token
                self.words[w] = self.ranks[b].to_bytes(4, "little")
            else:
                replayed.append((w, b))
        self.words.update(zip((w for w, _ in replayed), self.replay([b for _, b in replayed]), strict=True))
        return [b"".join([self.words[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of one run of packed ids."""
        return self.decode_all([ids])[0].as_py()

    def decode_all(self, ids: list[bytes]) -> pa.Array:
        """The bytes of each run of packed ids."""
        joined = self.bytes.take(pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)))
        end = np.cumsum([0, *(len(x) // 4 for x in ids)])
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int32)[end] if len(joined) else np.zeros(len(ids) + 1, dtype=np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), joined.buffers()[2]])


def _shared(spark: SparkSession, rank_path: str):
    """The rank file, read once on the driver and broadcast; its size is that of one vocabulary."""
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast({"ranks": f.read()})


def _vocabulary(shared, pattern: str) -> Vocabulary:
    """The vocabulary of a worker process: built by its first task, kept beside the broadcast ranks for the others."""
    kept = shared.value
    if pattern not in kept:
        kept[pattern] = Vocabulary(kept["ranks"], pattern)
    return kept[pattern]


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", n_col: str = "n_tokens",
           decoded_col: str | None = None) -> DataFrame:
    """``df`` without ``text_col``, with the packed ids, their number and, where
    a column is named for it, the bytes that the ids decode to."""
    spark = df.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    shared = _shared(spark, rank_path)
    new = [T.StructField(ids_col, T.BinaryType()), T.StructField(n_col, T.LongType())]
    new += [T.StructField(decoded_col, T.BinaryType())] if decoded_col else []
    kept = [c for c in df.columns if c not in (text_col, *(f.name for f in new))]
    schema = T.StructType([df.schema[c] for c in kept] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared, pattern)
        for batch in batches:
            ids = vocabulary.encode([t or "" for t in batch.column(text_col).to_pylist()])
            cols = [*(batch.column(c) for c in kept), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            cols += [vocabulary.decode_all(ids)] if decoded_col else []
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return df.select(*kept, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that packed ids stand for (null ids: none)."""
    spark = df.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    shared = _shared(spark, rank_path)
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared, pattern)
        for batch in batches:
            decoded = vocabulary.decode_all([x or b"" for x in batch.column(ids_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def with_digests(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ids, their number, and digests of the ids and of the bytes they decode to."""
    coded = encode(df, rank_path, pattern, text_col, decoded_col="_decoded")
    return coded.withColumns({"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("_decoded", 256)}).drop("_decoded")


def token_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes they decode to."""
    return with_digests(docs.select(id_col, text_col), rank_path, pattern, text_col).select(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
