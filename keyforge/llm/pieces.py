"""SentencePiece BPE encoding and decoding by a distinct-chunk table (operator 11).

No piece of the model holds a whitespace marker behind another character, so no
merge crosses from one marked word (markers, then everything up to the next
marker) into the next.  Each block of texts therefore has a table of its
distinct marked words; each is segmented once, by score and then leftmost, and
its ids are joined back by position.  A model whose pieces cross markers, or
whose settings differ from those handled here, is refused.

Nothing is shuffled: a block is one Arrow batch, so memory follows the batch
and a lost task is simply run again.  Null and empty texts have no ids.  Texts
are never cut; repeated rows and ties give equal results.  Output columns take
the place of columns of the same name; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyforge.llm.common import ship, small_batches
from keyforge.llm.segments import Merges, bytes_of, firsts, marked_words, ragged, sums

ship(__name__)

MARK = "▁"
#: A block: rows, and bytes of text.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
#: Kinds of pieces in a model file: fixed values of its format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_model(path: str) -> list[tuple[str, float, int]]:
    """Pieces, scores and kinds of a model file.  Raises ValueError for a model this method does not fit."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and marks before words")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only models that leave texts as they are, behind one mark")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    if any(kind in (USER, UNUSED) for _, _, kind in pieces):
        raise ValueError("no user-defined or unused pieces")
    if any(kind == NORMAL and MARK in p.lstrip(MARK) for p, _, kind in pieces):
        raise ValueError("a piece crosses a whitespace mark")
    return pieces


def word_starts(data: np.ndarray) -> np.ndarray:
    """A marked word begins at a space (here the mark) behind another byte."""
    begin = data == 0x20
    begin[1:] &= data[:-1] != 0x20
    return begin


class PieceModel:
    """Segmentation of marked words, and the bytes behind ids."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte = np.zeros(256, dtype=np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(p[3:-1], 16)] = i
        symbols = dict(ids)
        for p in ids:  # characters that are no piece of their own can still be part of one
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        #: The symbol of a code point; below 0 where no piece has it.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for p, s in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)] = s
        self.symbol[0x20] = self.symbol[ord(MARK)]
        self.alone = {s: ord(p) for p, s in symbols.items() if s >= len(pieces)}
        ranks = {score: r for r, score in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
        pairs = [(symbols[p[:k]], symbols[p[k:]], ranks[pieces[i][1]], i)
                 for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.merges = Merges(*(np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True)))
        self.kind = np.array([kind for _, _, kind in pieces])
        #: The bytes of each piece with marks as spaces; one space more where the library shows an unknown piece.
        surface = {CONTROL: "", UNKNOWN: " ⁇ "}
        self.bytes = pa.array([bytes([int(p[3:-1], 16)]) if kind == BYTE else surface.get(kind, p.replace(MARK, " ")).encode()
                               for p, _, kind in pieces], pa.binary())
        self.marked = np.array([kind == NORMAL and p.startswith(MARK) for p, _, kind in pieces])

    def segment(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and their number in each."""
        data, length = bytes_of(words)
        if not len(data):
            return np.zeros(0, dtype=np.int64), length
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        tok, size = self.merges.apply(self.symbol[points], sums((data & 0xC0) != 0x80, length))
        for s, c in self.alone.items():
            tok[tok == s] = -1 - c
        return self._fall_back(tok, size)

    def _fall_back(self, tok: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that no piece has become the pieces of their UTF-8 bytes."""
        point = np.where(tok < 0, -1 - tok, 0)
        n = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        wide, c = np.repeat(tok, n), np.repeat(point, n)
        count = np.repeat(n, n)
        k = count - 1 - (np.arange(len(wide)) - np.repeat(firsts(n), n))  # bytes that follow
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[count]
        first = k == count - 1
        byte = np.where(first, lead | c >> 6 * k, 0x80 | c >> 6 * k & 0x3F)
        return np.where(wide < 0, self.byte[byte & 0xFF], wide), sums(n, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number in each."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        full = np.asarray(pc.greater(pc.binary_length(texts), 0))
        words = marked_words(texts.filter(pa.array(full)), word_starts)
        ids, size = self.segment(words.distinct)
        start, per_word = firsts(size), size[words.index]
        n = np.zeros(len(texts), dtype=np.int64)
        n[full] = sums(per_word, words.per_text)
        return ids[ragged(start[words.index], per_word)], n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The text of each run of ids: the mark before a text's first word goes."""
        joined = self.bytes.take(pa.array(ids))
        blob, width = bytes_of(joined)
        end = np.cumsum(sums(width, n))
        begin = firsts(sums(width, n))
        data, out = blob.tobytes(), []
        place = firsts(n)
        for k in range(len(n)):
            own = ids[place[k]:place[k] + n[k]]
            control = self.kind[own] == CONTROL
            said = own[~control][:1]
            a = begin[k] + bool(len(said) and self.marked[said[0]])
            try:
                if control.any():  # they part byte pieces
                    raise ValueError
                out.append(data[a:end[k]].decode())
            except ValueError:
                out.append(self._lossy(own)[a - begin[k]:])
        return out

    def _lossy(self, ids: np.ndarray) -> str:
        """Ids whose byte pieces are not whole characters: each byte outside one becomes U+FFFD."""
        out, run = [], b""

        def flush() -> None:
            nonlocal run
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]

        for i in ids.tolist():
            if self.kind[i] == BYTE:
                run += self.bytes[i].as_py()
            else:
                flush()
                out.append(self.bytes[i].as_py().decode())
        flush()
        return "".join(out)


def shared_model(spark: SparkSession, path: str):
    """The pieces, read once on the driver and broadcast; their size is that of one vocabulary."""
    return spark.sparkContext.broadcast({"pieces": read_model(path)})


def _model(shared) -> PieceModel:
    """The model of a worker process: built by its first task, kept beside the broadcast pieces for the others."""
    kept = shared.value
    if "model" not in kept:
        kept["model"] = PieceModel(kept["pieces"])
    return kept["model"]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", n_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """``df`` without ``text_col``, with the ids, their number and, where a
    column is named for it, the text that they decode to."""
    spark = df.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    shared = shared_model(spark, path)
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(n_col, T.LongType())]
    new += [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    kept = [c for c in df.columns if c not in (text_col, *(f.name for f in new))]
    schema = T.StructType([df.schema[c] for c in kept] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            ids, n = model.encode(batch.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
            cols = [*(batch.column(c) for c in kept), lists, pa.array(n, pa.int64())]
            cols += [pa.array(model.decode(ids, n), pa.string())] if decoded_col else []
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return df.select(*kept, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that ids stand for (null ids: empty)."""
    spark = df.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    shared = shared_model(spark, path)
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            lists = batch.column(ids_col)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            ids = np.asarray(lists.flatten()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.decode(ids, n), pa.string())], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the decimal ids, digest of the text they decode to."""
    coded = encode(docs.select(id_col, text_col), path, text_col, decoded_col="decoded")
    decimal = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select(id_col, "n_tokens", F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
