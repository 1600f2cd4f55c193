"""Alignment of two tokenizers by composing fragments (operator 12).

A text behind one space is read as a range of bytes.  Both tokenizers cut it;
a place where tokens of both end closes a group.  What is known of one byte
range is a *fragment*: an open prefix (tokens before its first common end),
closed groups, an open suffix (tokens behind its last common end).  Two
neighbours compose into a fragment: the left suffix and the right prefix become
a group.  Composition is associative with the empty fragment as identity, so
the ranges of a very long text are done in different Spark tasks and composed
by a tree of bounded fan-in; the ranges may be cut anywhere, also inside tokens
(a token belongs to the range in which it ends).

A fragment is stored flat: ids of A, ids of B, and how many tokens of each lie
before each common end.  Within a block, tokens come from a table of distinct
words (``segments``): words are cut only where neither tokenizer can have a
token across.

Corpus counts: each block writes its distinct id pairs and how many of its
documents hold each; only these rows are shuffled, counted and sent back to
their block, where documents add them up.  No pair row per document exists.

Null and empty texts, and texts whose joined token bytes differ from space and
text, have no tokens: zeros and an empty digest.  Texts are never cut short;
repeated rows each count as a document; an empty table gives an empty result.
Other columns do not take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyforge.llm.common import ship, small_batches
from keyforge.llm.pieces import PieceModel, read_model
from keyforge.llm.segments import Merges, bytes_of, firsts, marked_words, ragged, sums
from keyforge.session import ensure_checkpoint_dir

ship(__name__)

#: How byte-level vocabularies split texts before merging, and how they show bytes: fixed values of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Bytes of one range, neighbours composed at once, links held at once.
RANGE_BYTES, FAN_IN, LINKS_AT_ONCE = 32_768, 16, 500_000
#: A block: rows, and bytes of text.
BATCH_ROWS, BATCH_BYTES = 250, 1 << 20
ROW_GROUP_BYTES = 16 << 20
WHOLE, PIECE, PAIRS = 0, 1, 2


def read_byte_level(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of a byte-level BPE file.  Raises ValueError for other kinds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without normaliser and added space")
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("only plain BPE")
    return model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]


class ByteLevel:
    """Byte-level BPE by a list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        shown = {b: chr(b) for b in PRINTABLE}
        hidden = [b for b in range(256) if b not in shown]
        shown |= {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        at = {c: b for b, c in shown.items()}
        token = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            token[i] = bytes(at[c] for c in t)
        self.bytes = pa.array(token, pa.binary())
        self.width = np.array([len(t) for t in token], dtype=np.int64)
        self.merges = Merges(*(np.array(c, dtype=np.int64) for c in zip(
            *((vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)), strict=True)))
        self.split = regex.compile(SPLIT)

    def segment(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and their number in each."""
        data, length = bytes_of(words)
        if not len(data):
            return np.zeros(0, dtype=np.int64), length
        start = firsts(length)
        # words follow each other as in a text, but for those behind a text's last white space
        apart = np.flatnonzero(~common_starts(data)[start])
        parts: list[str] = []
        for i, j in zip(np.append(0, apart), np.append(apart, len(start)), strict=True):
            if i < j:
                parts += self.split.findall(data[start[i]:start[j - 1] + length[j - 1]].tobytes().decode())
        coded = pa.array(parts, pa.string()).dictionary_encode()
        part, width = bytes_of(coded.dictionary.cast(pa.binary()))
        ids, size = self.merges.apply(self.byte[part], width)
        at = np.asarray(coded.indices).astype(np.int64)
        n_parts = np.diff(np.searchsorted(np.cumsum(width[at]), np.cumsum(length), side="right"), prepend=0)
        return ids[ragged(firsts(size)[at], size[at])], sums(size[at], n_parts)


def common_starts(data: np.ndarray) -> np.ndarray:
    """Where no token of either tokenizer reaches across: at a space behind a
    character that is neither white space nor a mark.  Characters of three
    bytes in whose blocks such characters lie count as them, which only makes
    words longer."""
    begin = data == 0x20
    at = np.flatnonzero(begin)
    b1, b2, b3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    blank = (b1 == 0x20) | (b1 >= 0x09) & (b1 <= 0x0D) | (b1 >= 0x1C) & (b1 <= 0x1F)
    blank |= (b1 >= 0x80) & ((b2 == 0xC2) | (b2 >= 0x80) & (b2 < 0xC0) & (b3 >= 0xE1) & (b3 <= 0xE3))
    begin[at[blank]] = False
    return begin


@dataclass
class Fragments:
    """Fragments of several ranges, flat: ``n_*[k]`` entries of each array belong to range ``k``."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray  # tokens of A in the range up to each common end
    cut_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_cut: np.ndarray
    same: np.ndarray  # the tokens join to the text


def compose(parts: Fragments, into: np.ndarray) -> Fragments:
    """Neighbouring fragments joined: fragment ``k`` goes into result ``into[k]``
    (ascending from 0, gapless).  Tokens follow each other, and the common ends
    of each fragment move behind the tokens before it."""
    n = int(into[-1]) + 1 if len(into) else 0
    held = np.bincount(into, minlength=n)

    def moved(cut: np.ndarray, size: np.ndarray) -> np.ndarray:
        before = firsts(size) - np.repeat(firsts(sums(size, held)), held)
        return cut + np.repeat(before, parts.n_cut)

    return Fragments(parts.a, parts.b, moved(parts.cut_a, parts.n_a), moved(parts.cut_b, parts.n_b), sums(parts.n_a, held),
                     sums(parts.n_b, held), sums(parts.n_cut, held), sums(~parts.same, held) == 0)


class Aligner:
    """Both tokenizers, and fragments of byte ranges."""

    def __init__(self, byte_level: tuple, pieces: list):
        self.a, self.b = ByteLevel(*byte_level), PieceModel(pieces)
        self.b_width = np.asarray(pc.binary_length(self.b.bytes)).astype(np.int64)
        self.table_a = pa.array([f"{i}{mark}" for mark in ",|" for i in range(len(self.a.bytes))], pa.binary())
        self.table_b = pa.array([f"{i}{mark}" for mark in (",", ";", "") for i in range(len(self.b.bytes))], pa.binary())

    def fragments(self, texts: pa.Array, lo: np.ndarray, hi: np.ndarray) -> Fragments:
        """The fragment of the tokens of each spaced text that end in its byte range (lo, hi]."""
        words = marked_words(texts, common_starts)
        size_of_text = np.concatenate([[0], np.cumsum(words.text_length)])
        word_at, text_of = firsts(words.length), np.repeat(np.arange(len(texts)), words.per_text)
        out, good = [], []
        for model, width in ((self.a, self.a.width), (self.b, self.b_width)):
            ids, size = model.segment(words.distinct)
            bytes_in = sums(width[ids], size)
            n = size[words.index]
            tok = ids[ragged(firsts(size)[words.index], n)]
            own = np.repeat(np.arange(len(n)), n)
            end = word_at[own] + np.cumsum(width[tok]) - np.repeat(firsts(bytes_in[words.index]), n)
            blob, _ = bytes_of(model.bytes.take(pa.array(tok)))
            whole = len(blob) == len(words.data)
            differs = blob != words.data if whole else np.zeros(0, dtype=bool)
            bad = np.zeros(len(texts), dtype=bool)
            if not whole:  # compare word by word where lengths part
                bad[text_of[bytes_in[words.index] != words.length]] = True
            elif differs.any():
                bad[np.searchsorted(size_of_text, np.flatnonzero(differs), side="right") - 1] = True
            text = text_of[own]
            rel = end - size_of_text[text]
            inside = (rel > lo[text]) & (rel <= hi[text])
            out.append((tok[inside], end[inside], text[inside]))
            good.append(~bad)
        (a, end_a, text_a), (b, end_b, text_b) = out
        at = np.searchsorted(end_b, end_a)
        met = (at < len(end_b)) & (end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.zeros(len(end_a), dtype=bool)
        n_a, n_b = (np.bincount(t, minlength=len(texts)) for t in (text_a, text_b))
        common = np.flatnonzero(met)
        return Fragments(a, b, common + 1 - firsts(n_a)[text_a[common]], at[common] + 1 - firsts(n_b)[text_a[common]],
                         n_a, n_b, np.bincount(text_a[common], minlength=len(texts)), good[0] & good[1])

    def groups_text(self, f: Fragments) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each fragment, whose last token of each kind closes its last group."""
        in_a, in_b = self._in_groups(f)
        group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        last_a, last_b = np.zeros(len(f.a), dtype=bool), np.zeros(len(f.b), dtype=bool)
        last_a[np.cumsum(in_a) - 1] = True
        last_b[np.cumsum(in_b) - 1] = True
        closing = last_b.copy()
        final = np.cumsum(f.n_b)[f.n_b > 0] - 1
        mark_b = np.where(closing, 1, 0)
        mark_b[final] = 2
        # a group's tokens of A stand before its tokens of B
        place_a = np.arange(len(f.a)) + firsts(in_b)[group_a]
        place_b = np.arange(len(f.b)) + np.cumsum(in_a)[group_b]
        entry = np.zeros(len(f.a) + len(f.b), dtype=np.int64)
        entry[place_a] = f.a + len(self.a.bytes) * last_a
        entry[place_b] = len(self.table_a) + f.b + len(self.b.bytes) * mark_b
        joined = pa.concat_arrays([self.table_a, self.table_b]).take(pa.array(entry))
        blob, width = bytes_of(joined)
        size = sums(width, f.n_a + f.n_b)
        data, begin = blob.tobytes(), firsts(size)
        return [data[p:p + n] for p, n in zip(begin, size, strict=True)]

    @staticmethod
    def _in_groups(f: Fragments) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of A and of B in each closed group."""
        first = firsts(f.n_cut)[f.n_cut > 0]
        out = []
        for cut in (f.cut_a, f.cut_b):
            size = np.diff(cut, prepend=0)
            size[first] = cut[first]
            out.append(size)
        return out[0], out[1]

    def links(self, f: Fragments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fragment, id pair (``a`` times the size of B's vocabulary, plus ``b``)
        and number of links, each pair of a closed fragment once."""
        in_a, in_b = self._in_groups(f)
        group_a = np.repeat(np.arange(len(in_a)), in_a)
        owner = np.repeat(np.arange(len(f.n_cut)), f.n_cut)
        ids_b, n_pairs = len(self.b.bytes), len(self.a.bytes) * len(self.b.bytes)
        per_a = in_b[group_a]  # each token of A meets the tokens of B in its group
        found = []
        # whole tokens of A at a time; the tokens of B of one group are met in slices
        slices = np.flatnonzero(np.diff(firsts(per_a) // LINKS_AT_ONCE, prepend=-1))
        for i, j in zip(slices, np.append(slices[1:], len(f.a)), strict=True):
            g, n = group_a[i:j], per_a[i:j]
            key = np.repeat(owner[g] * n_pairs + f.a[i:j] * ids_b, n) + f.b[ragged(firsts(in_b)[g], n)]
            found.append(np.unique(key, return_counts=True))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        key, times = found[0]
        if len(found) > 1:
            key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)
        return key // n_pairs, key % n_pairs, times


def byte_ranges(text: str, size: int) -> list[tuple[int, int, str]]:
    """Ranges (lo, hi] of the bytes of space and text, about ``size`` long, each
    with the stretch of text that holds its tokens whole; lo and hi count from
    the start of that stretch.  A stretch reaches from a common start at or
    before its range to one behind it; ends without a common start between them
    are left out, so stretches overlap by their neighbours at most."""
    data = b" " + text.encode()
    begin = np.flatnonzero(common_starts(np.frombuffer(data, dtype=np.uint8)))
    begin = begin[begin > 0]
    ends, starts = [0], [0]
    for at in range(size, len(data), size):
        k = int(np.searchsorted(begin, at, side="right")) - 1
        if k >= 0 and begin[k] > ends[-1]:
            ends.append(at)
            starts.append(int(begin[k]))
    ends.append(len(data))
    out = []
    for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        j = int(np.searchsorted(begin, hi))
        stop = int(begin[j]) if j < len(begin) else len(data)
        out.append((lo - starts[k], hi - starts[k], data[starts[k] + 1:stop].decode()))
    return out


_FLAT = "a binary, b binary, cut_a binary, cut_b binary, same boolean"
_KEY = "doc_id bigint, row bigint"
_RANGE = f"{_KEY}, k int, n_ranges int, lo bigint, hi bigint, text string"
_FRAGMENT = f"{_KEY}, k int, n_ranges int, {_FLAT}"
_RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_BLOCK = f"kind int, block string, {_FRAGMENT}, {_RESULT}, place binary, times binary, pairs array<bigint>, docs array<bigint>"


def _packed(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each part's values as 32-bit integers in one binary value."""
    data = values.astype("<i4")
    at = np.append(0, np.cumsum(n)) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _flat_columns(f: Fragments) -> list[pa.Array]:
    return [_packed(f.a, f.n_a), _packed(f.b, f.n_b), _packed(f.cut_a, f.n_cut), _packed(f.cut_b, f.n_cut), pa.array(f.same)]


def _from_columns(batch: pa.RecordBatch) -> Fragments:
    flat, size = [], []
    for name in ("a", "b", "cut_a", "cut_b"):
        blob, width = bytes_of(batch.column(name))
        flat.append(np.frombuffer(blob.tobytes(), dtype="<i4").astype(np.int64))
        size.append(width // 4)
    return Fragments(*flat, size[0], size[1], size[2], np.asarray(batch.column("same")).astype(bool))


def _picked(f: Fragments, which: np.ndarray) -> Fragments:
    """The fragments numbered ``which``."""
    def of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        return values[ragged(firsts(n)[which], n[which])]
    return Fragments(of(f.a, f.n_a), of(f.b, f.n_b), of(f.cut_a, f.n_cut), of(f.cut_b, f.n_cut),
                     f.n_a[which], f.n_b[which], f.n_cut[which], f.same[which])


def _without_tokens(f: Fragments, gone: np.ndarray) -> Fragments:
    """Fragments marked ``gone`` lose their tokens."""
    def of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        return values[~np.repeat(gone, n)]
    return Fragments(of(f.a, f.n_a), of(f.b, f.n_b), of(f.cut_a, f.n_cut), of(f.cut_b, f.n_cut),
                     *(np.where(gone, 0, n) for n in (f.n_a, f.n_b, f.n_cut)), f.same)


def _null(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
          "array<bigint>": pa.list_(pa.int64())}
_BLOCK_FIELDS = [tuple(f.split(" ")) for f in _BLOCK.split(", ")]


def _block_rows(n: int, cols: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else _null(n, _ARROW[t]) for c, t in _BLOCK_FIELDS], names=[c for c, _ in _BLOCK_FIELDS])


def _whole_rows(aligner: Aligner, block: str, doc_id: pa.Array, row: pa.Array, f: Fragments) -> Iterator[pa.RecordBatch]:
    """Whole documents of one block: a row for each, and one with the block's distinct pairs."""
    f = _without_tokens(f, ~f.same)
    n_docs = len(doc_id)
    owner, pair, times = aligner.links(f)
    distinct, place = np.unique(pair, return_inverse=True)
    held = np.bincount(owner, minlength=n_docs)
    texts = aligner.groups_text(f)
    yield _block_rows(n_docs, {
        "kind": pa.array(np.full(n_docs, WHOLE, dtype=np.int32)), "block": pa.array([block] * n_docs), "doc_id": doc_id, "row": row,
        "n_a": pa.array(f.n_a, pa.int64()), "n_b": pa.array(f.n_b, pa.int64()), "n_groups": pa.array(f.n_cut, pa.int64()),
        "n_links": pa.array(sums(times, held), pa.int64()),
        "groups_sha256": pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]),
        "place": _packed(place, held), "times": _packed(times, held)})
    if len(distinct):
        one = pa.array([0, len(distinct)], pa.int32())
        docs = np.bincount(place, minlength=len(distinct))
        yield _block_rows(1, {
            "kind": pa.array([PAIRS], pa.int32()), "block": pa.array([block]),
            "pairs": pa.ListArray.from_arrays(one, pa.array(distinct, pa.int64())), "docs": pa.ListArray.from_arrays(one, pa.array(docs, pa.int64()))})


def _aligner(shared) -> Aligner:
    """The aligner of a worker process: built by its first task, kept beside the
    broadcast vocabularies for the others."""
    kept = shared.value
    if "aligner" not in kept:
        kept["aligner"] = Aligner(kept["byte_level"], kept["pieces"])
    return kept["aligner"]


def _aligned_blocks(ranges: DataFrame, shared, mark: str) -> DataFrame:
    """Fragments of all ranges; those of documents with one range are whole and closed here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            lo, hi = (np.asarray(batch.column(c)).astype(np.int64) for c in ("lo", "hi"))
            f = aligner.fragments(batch.column("text"), lo, hi)
            whole = np.asarray(batch.column("n_ranges")) == 1
            if whole.any():
                rows = batch.filter(pa.array(whole))
                yield from _whole_rows(aligner, f"{mark}-{task}-{number}", rows.column("doc_id"), rows.column("row"), _picked(f, np.flatnonzero(whole)))
            if not whole.all():
                rows = batch.filter(pa.array(~whole))
                n, part = rows.num_rows, _picked(f, np.flatnonzero(~whole))
                cols = {"kind": pa.array(np.full(n, PIECE, dtype=np.int32))} | {c: rows.column(c) for c in ("doc_id", "row", "k", "n_ranges")}
                yield _block_rows(n, cols | dict(zip(("a", "b", "cut_a", "cut_b", "same"), _flat_columns(part), strict=True)))

    return ranges.mapInArrow(run, _BLOCK)


def _composed(fragments: DataFrame) -> DataFrame:
    """One level of the tree: up to ``FAN_IN`` neighbouring fragments of a document become one."""

    def join(batch: pa.Table) -> pa.Table:
        rows = batch.sort_by("k").combine_chunks().to_batches()[0]
        f = compose(_from_columns(rows), np.zeros(rows.num_rows, dtype=np.int64))
        head = rows.slice(0, 1)
        k = pa.array(np.asarray(head.column("k")) // FAN_IN, pa.int32())
        n = pa.array((np.asarray(head.column("n_ranges")) + FAN_IN - 1) // FAN_IN, pa.int32())
        return pa.Table.from_arrays([head.column("doc_id"), head.column("row"), k, n, *_flat_columns(f)],
                                    names=["doc_id", "row", "k", "n_ranges", "a", "b", "cut_a", "cut_b", "same"])

    return fragments.groupBy("row", F.floor(F.col("k") / FAN_IN).alias("group")).applyInArrow(lambda key, t: join(t), _FRAGMENT)


def _closed(fragments: DataFrame, shared, mark: str) -> DataFrame:
    """Whole documents from composed fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            yield from _whole_rows(aligner, f"{mark}-{task}-{number}", batch.column("doc_id"), batch.column("row"), _from_columns(batch))

    return fragments.mapInArrow(run, _BLOCK)


def _cut_long(docs: DataFrame, range_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                cut = byte_ranges(text, range_bytes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id] * len(cut), pa.int64()), pa.array([row] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()),
                    pa.array([len(cut)] * len(cut), pa.int32()), pa.array([c[0] for c in cut], pa.int64()),
                    pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.string())],
                    names=["doc_id", "row", "k", "n_ranges", "lo", "hi", "text"])

    return docs.mapInArrow(run, _RANGE)


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: tokens of both kinds, groups, links, links whose pair is
    the commonest of its A id, summed document counts of the links' pairs, and
    the digest of the groups."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    folder = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        # small row groups: the writer holds one of them per task
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    vocabularies = {"byte_level": read_byte_level(byte_level_path), "pieces": read_model(piece_path)}
    shared = spark.sparkContext.broadcast(vocabularies)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    full = docs.where(F.length("text") > 0)
    size = F.octet_length("text") + 1
    short = full.where(size <= range_bytes).select(
        "doc_id", F.lit(0).cast("bigint").alias("row"), F.lit(0).alias("k"), F.lit(1).alias("n_ranges"), F.lit(0).cast("bigint").alias("lo"), size.cast("bigint").alias("hi"), "text")
    # rows of long texts are numbered in a written table, so that equal rows stay apart and a rerun sees the same numbers
    long = kept(_cut_long(full.where(size > range_bytes).withColumn("row", F.monotonically_increasing_id()), range_bytes), "ranges")
    spread = long.repartition(F.col("row"), F.col("k"))
    blocks = [kept(_aligned_blocks(short, shared, "s"), "short"), kept(_aligned_blocks(spread, shared, "r"), "pieces")]
    depth = long.agg(F.max("n_ranges")).first()[0] or 0
    part = blocks[1].where(F.col("kind") == PIECE).select(*(f.split(" ")[0] for f in _FRAGMENT.split(", ")))
    while depth > 1:
        part = _composed(part)
        depth = -(-depth // FAN_IN)
    blocks.append(kept(_closed(part, shared, "c"), "closed"))
    rows = blocks[0].unionByName(blocks[1]).unionByName(blocks[2])
    block_pairs = rows.where(F.col("kind") == PAIRS).select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")) \
        .select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = block_pairs.groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = kept(counts.withColumn("a", F.expr(f"pair div {len(vocabularies['pieces'])}")), "counts")
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = counts.join(best, "a").select("pair", F.col("docs").alias("count"), (F.col("docs") == F.col("most")).alias("best"))
    back = block_pairs.select(F.col("block").alias("home"), "place", "pair").join(counts, "pair").select("home", "place", "count", "best")
    whole = rows.where(F.col("kind") == WHOLE).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "times")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        place = np.asarray(right.column("place")).astype(np.int64)
        count, top = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=bool)
        count[place] = np.asarray(right.column("count"))
        top[place] = np.asarray(right.column("best"))
        left = left.combine_chunks()
        at, held = bytes_of(left.column("place").combine_chunks()) if left.num_rows else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        times, _ = bytes_of(left.column("times").combine_chunks()) if left.num_rows else (np.zeros(0, np.uint8), None)
        at, times = (np.frombuffer(x.tobytes(), dtype="<i4").astype(np.int64) for x in (at, times))
        n_best, total = sums(times * top[at], held // 4), sums(times * count[at], held // 4)
        return pa.Table.from_arrays([left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [
            pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("groups_sha256")], names=_OUT)

    added = whole.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(add_up, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in _OUT))
    zero = F.lit(0).cast("bigint")
    without = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select(
        "doc_id", *(zero.alias(c) for c in _OUT[1:-1]), F.lit("").alias("groups_sha256"))
    return added.unionByName(without)


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
