"""Near-duplicate documents by b-bit MinHash (operator 10).

1. Documents with the same shingle set form a class (128-bit digest of the
   sorted set), so a group of copies costs one row from here on.
2. Each class has ``HASHES`` minima.  Bands of ``ROWS`` full minima give the
   candidate buckets; of the minima themselves only the low ``BITS`` bits are
   kept, packed into four integers.
3. Each member of a bucket is compared with two members of it, the least and
   one that changes from band to band.  Packed signatures first: equal low
   bits are counted and corrected for chance collisions, and a pair goes on if
   the estimate is within five standard deviations of the threshold, and if
   parity bitmaps allow it: a bit of ``PARITY`` tells whether an odd number of
   the set's shingles fall on it, so every bit that differs stands for a shingle
   of one set only.  That bound is exact and loses no link; it is sharp for
   texts of up to some thousand words, longer ones rely on the estimate.  Then
   the whole sets, exactly.
4. Links are contracted to components.  In buckets that still hold several
   components every pair of different components is compared in the same way,
   so no link of a bucket is lost, while a group of n near copies costs about
   n comparisons and not n*n.  The links found there join components, so the
   second contraction runs over components only.

A pair at similarity 0.8 shares none of the 32 bands with probability 5e-8.
No bucket, partner or candidate is capped.  Joins on a member that many
others are compared with have written tables on both sides, which adaptive
execution splits.

Documents without words have an empty set, are linked with nothing and are
kept.  Null ids never name a component unless all ids of it are null.  Repeated
rows belong to the same class.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyforge.llm.common import SPACE_CHARS, WORD_PATTERN, no_null, ship, small_batches, written

ship(__name__)

HASHES, BITS, ROWS, PARITY = 128, 2, 4, 1024
BANDS = HASHES // ROWS
#: Standard deviations of the estimate that a pair may lie under the threshold.
MARGIN = 5

_U = np.uint64
_MIX1, _MIX2, _MIX3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = SPACE_CHARS.encode()
_TO_SPACE = bytes(32 if b in _SPACES else b for b in _LOWER)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _MIX2
    x = (x ^ (x >> _U(27))) * _MIX3
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _MIX1)


def shingle_hashes(text: str | None, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text: ASCII
    letters in lower case, words between ASCII white space; a text with fewer
    words is one shingle."""
    words = (text or "").encode().translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(cache) > 500_000:
        cache.clear()
    ids = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, dtype=np.uint64)
    n = max(1, len(h) - size + 1)
    # The number of words goes in, so a short text never equals a shingle.
    out = np.full(n, _U(min(size, len(h))), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = _mix(out * _MIX1 + h[k:k + n])
    return np.unique(out)


def _minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):  # bounds the table of a long text
        part = hashes[at:at + 4096]
        np.minimum(out, ((part[None, :] ^ _SEEDS[:, None]) * _MIX2).min(axis=1), out=out)
    return out


def _packed(minima: np.ndarray) -> list[int]:
    """The low bits of all minima in 64-bit integers."""
    low = ((minima >> _U(32)) & _U((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return (low << shifts).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()


def _parity(hashes: np.ndarray) -> list[int]:
    """Per bit, whether an odd number of the shingles fall on it, in 64-bit integers."""
    odd = np.bincount((hashes >> _U(20)).astype(np.int64) % PARITY, minlength=PARITY).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


_WORDS = HASHES * BITS // 64
#: Columns of the signature: packed low bits, then the parity bitmap.
_SIG = [f"s{i}" for i in range(_WORDS)] + [f"p{i}" for i in range(PARITY // 64)]
_SIGNED = "id {id}, txt bigint, cls binary, n_shingles bigint, " + ", ".join(f"{c} bigint" for c in _SIG) + ", bands array<bigint>"


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, txt, cls, n_shingles, packed signature, bands) of every document; txt
    is a hash of the text, cls is null for documents without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            cls, n, packed, bands = [], [], [[] for _ in _SIG], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, size, cache)
                n.append(len(hashes))
                if not len(hashes):
                    cls.append(None)
                    bands.append(None)
                    for p in packed:
                        p.append(None)
                    continue
                cls.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                minima = _minima(hashes)
                key = band.copy()
                for row in minima.reshape(BANDS, ROWS).T:
                    key = _mix(key * _MIX1 + row)
                bands.append(key.astype(np.int64))
                for p, x in zip(packed, _packed(minima) + _parity(hashes), strict=True):
                    p.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("txt"), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), *[pa.array(p, pa.int64()) for p in packed], pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "txt", "cls", "n_shingles", *_SIG, "bands"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("txt"))
    return picked.mapInArrow(run, _SIGNED.format(id=picked.schema["id"].dataType.simpleString()))


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(cls, hashes) of documents (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            cls, sets = [], []
            for c, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = shingle_hashes(text, size, cache)
                if hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() == c:
                    cls.append(c)
                    sets.append(hashes.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "hashes"])

    return docs.select("cls", "text").mapInArrow(run, "cls binary, hashes array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal low bits, less
    the share that collides by chance."""
    ones = (1 << BITS) - 1
    low = sum(1 << i for i in range(0, 64, BITS))
    low = low - (1 << 64) if low >= 1 << 63 else low
    differ = F.lit(0)
    for i in range(_WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(low)))
    chance = 1 / (ones + 1)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def odd_bits(a: str, b: str) -> Column:
    """Bits that differ between two parity bitmaps: at most the number of
    shingles that one set alone holds."""
    return sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY // 64)), F.lit(0))


def floor_of(threshold: float) -> float:
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * threshold
    return threshold - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


class _Job:
    """The tables that the steps share."""

    def __init__(self, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str):
        self.docs, self.size, self.percent, self.id_col, self.text_col = docs, size, percent, id_col, text_col
        self.signed = written(signatures(docs, size, id_col, text_col))
        classes = self.signed.where("cls is not null").groupBy("cls").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n"), *[F.first(s).alias(s) for s in _SIG], F.first("bands").alias("bands"))
        self.classes = written(classes)
        self.sig = self.classes.select("cls", "n", *_SIG)

    def buckets(self) -> DataFrame:
        """(band, cls, hub, other) of every class in a bucket with another one: the least member, and one that differs from band to band."""
        rows = self.classes.select("cls", F.explode("bands").alias("band"))
        hubs = written(rows.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("last"), F.max(F.struct(F.xxhash64("cls", "band"), "cls"))["cls"].alias("other")).where("hub <> last").select("band", "hub", "other"))
        return written(rows.join(hubs, "band"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose sizes and signatures allow a link."""
        one = self.sig.select(F.col("cls").alias("a"), F.struct("*").alias("x"))
        two = self.sig.select(F.col("cls").alias("b"), F.struct("*").alias("y"))
        both = pairs.join(one, "a").join(two, "b")
        return both.where(self.may_link("x", "y")).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))

    def may_link(self, x: str, y: str) -> Column:
        """Sizes, estimate and parity bitmaps allow a link.  A pair at the
        threshold has (100 - percent) / (100 + percent) of both sizes in one set only."""
        small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
        apart = (100 + self.percent) * odd_bits(x, y) <= (100 - self.percent) * (small + large)
        return (100 * small >= self.percent * large) & (estimate(x, y) >= floor_of(self.percent / 100)) & apart

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough, without the sizes na and nb."""
        pairs = written(pairs)
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        chosen = self.classes.join(needed, "cls").select("cls", F.col("id").alias("rep"))
        text = self.docs.select(F.col(self.id_col).alias("doc"), F.col(self.text_col).alias("text"))
        # A null id can stand for several texts; the digest tells which is meant.
        texts = text.join(chosen, text["doc"].eqNullSafe(chosen["rep"])).select("cls", "text")
        sets = written(whole_sets(texts, self.size).groupBy("cls").agg(F.first("hashes").alias("hashes")))
        # Both sides are written tables, so AQE splits the partition of a member that many are compared with.
        half = pairs.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
        both = half.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
        common = F.size(F.array_intersect("ha", "hb"))
        return both.where(100 * common >= self.percent * (F.col("na") + F.col("nb") - common)).select(*[c for c in pairs.columns if c not in ("na", "nb")])


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the least class that links (a, b) reach, for every linked
    class.  Rounds of large and small stars, each written, until every class
    has one parent and no parent has a parent of its own."""
    def both_ends(e: DataFrame, one: Column, two: Column) -> DataFrame:
        return e.select(F.inline(F.array(one, two)))

    def stars(e: DataFrame) -> bool:
        nodes = both_ends(e, F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                          F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = nodes.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.where("up > 1 or (up = 1 and down = 1)").agg(F.count(F.lit(1))).first()[0] == 0

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not stars(edges):
        around = both_ends(edges, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: a greater neighbour of x goes to the least one of x.
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        # Small star: x and its lesser neighbours go to the least of them.
        lower = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = written(both_ends(lower, F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    return both_ends(edges, F.struct(F.col("u").alias("cls"), F.col("v").alias("label")), F.struct(F.col("v").alias("cls"), F.col("v").alias("label"))).distinct()


def labelled(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, txt, cls, n_shingles, label) of every document; label is the least class
    of its component, null without words."""
    job = _Job(docs, size, percent, id_col, text_col)
    buckets = job.buckets()
    stars = buckets.select(F.col("cls").alias("a"), F.explode(F.array("hub", "other")).alias("b")).where("a <> b").distinct()
    found = written(components(job.links(job.near(stars))))
    named = buckets.select("band", "cls").join(found, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_ = named.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("band")
    rows = named.join(open_, "band").join(job.sig, "cls").select("band", "label", F.struct(*job.sig.columns).alias("x"))
    rows = written(rows)
    other = rows.select("band", F.col("label").alias("label2"), F.col("x").alias("y"))
    cross = rows.join(other, "band").where(F.col("label") < F.col("label2")).where(job.may_link("x", "y"))
    more = cross.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), "label", "label2").distinct()
    # The components found so far are the nodes of the second run.
    merged = written(components(job.links(more).select(F.col("label").alias("a"), F.col("label2").alias("b"))))
    merged = merged.select(F.col("cls").alias("label"), F.col("label").alias("root"))
    signed = job.signed.select("id", "txt", "cls", "n_shingles").join(found, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return signed.join(merged, "label", "left").select("id", "txt", "cls", "n_shingles", F.coalesce("root", "label").alias("label"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    rows = written(labelled(docs, size, percent, id_col, text_col))
    least = written(rows.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")))
    out = rows.join(least, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    return F.md5(F.concat_ws(":", doc_id.cast("string"), text_hash.cast("string")))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the least id stays (ids before nulls), unchanged; of repeated rows
    one stays.  Rows without words all stay."""
    rows = labelled(docs, size, percent, id_col, text_col)
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "txt")).alias("k"))
    # Digests of (id, text) are the key of the join and of the window, so texts are shuffled once.
    kept = written(first.select(_row_key(F.col("k.id"), F.col("k.txt")).alias("__key")))
    record = docs.select(F.struct("*").alias("__row"), _row_key(F.col(id_col), F.xxhash64(text_col)).alias("__key"), F.regexp_like(no_null(text_col), F.lit(WORD_PATTERN)).alias("__words"))
    chosen = record.where("__words").join(kept, "__key", "left_semi")
    one = Window.partitionBy("__key").orderBy("__row")
    chosen = chosen.withColumn("__n", F.row_number().over(one)).where(F.col("__n") == 1)
    return chosen.select("__row.*").unionByName(record.where(~F.col("__words")).select("__row.*"))
