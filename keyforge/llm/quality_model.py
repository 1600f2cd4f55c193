"""Quality classifier on random Fourier features (operator 5).

A document becomes some statistics of its characters, words and lines, scaled
by the training rows.  ``FEATURES`` random cosines of them approximate a
Gaussian kernel.  Ridge regression on the cosines is fitted from its normal
equations, whose sums are taken per partition and added up; only those fixed-
size sums reach the driver.  Raw scores become probabilities by isotonic
regression (pool adjacent violators) over counted score bins of other training
rows, interpolated between block centres, so that order is kept inside blocks.

The model is fitted on at most ``max_rows`` labelled documents (a hash sample
of the label table), which bounds what is broadcast and gathered; every
document is scored.  Labels enter only through ``learn``; language, source, id
and labels are no inputs of a score.  A document with several labels counts
with their mean.  Null and empty texts have all statistics 0 and are scored
like any other.  Without usable labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyforge.llm.common import no_null, ship, small_batches, written

ship(__name__)

FEATURES, SEED, RIDGE = 256, 20240, 1e-3
SCORE_BINS = 2000
HELD_OUT, FOLDS, CALIBRATE = 0, 5, 4
THRESHOLD = 0.3

_GROUPS = np.full(256, 9)  # other bytes
_GROUPS[65:91] = 0
_GROUPS[97:123] = 1
_GROUPS[48:58] = 2
_GROUPS[192:] = 3  # first bytes of letters beyond ASCII
_GROUPS[128:192] = 10
_GROUPS[list(b"#*$%&<>")] = 4
_GROUPS[ord("|")] = 5
_GROUPS[ord("!")] = 6
_GROUPS[list(b".,")] = 7
_GROUPS[list(b" \t\n\x0b\x0c\r")] = 8
N_STATISTICS = 18


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one text: shares of character groups, word and line measures."""
    out = np.zeros(N_STATISTICS)
    words = (text or "").split()
    if not words:
        return out
    counts = np.bincount(_GROUPS, weights=np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256), minlength=11)
    chars = counts[:8].sum() + counts[9]
    out[:8] = np.sqrt(counts[:8] / max(1.0, chars))
    out[8] = np.sqrt(counts[9] / max(1.0, chars))
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    out[9] = np.log1p(n)
    out[10] = np.log1p(lengths.mean())
    out[11] = np.log1p(lengths.std())
    out[12] = len(set(words)) / n
    out[13] = sum(map(str.__eq__, words, words[1:])) / n
    out[14] = 1 - len(set(zip(words, words[1:], strict=False))) / n
    out[15] = 1 - len(set(lines)) / len(lines)
    out[16] = np.log1p(n / len(lines))
    out[17] = sum(map(str.isupper, words)) / n
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(statistics)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0.0, 1.0)


def _matrix(parts: pd.Series) -> np.ndarray:
    return np.array(parts.tolist(), dtype=np.float64).reshape(len(parts), -1)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of ``mean`` over rising ``at``: centres and values of its blocks."""
    blocks: list[list[float]] = []
    for a, m, w in zip(at, mean, weight, strict=True):
        blocks.append([a * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % FOLDS).cast("int")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, label_col: str = "quality") -> Model:
    """Fit on at most about ``max_rows`` of the labelled documents (documents
    with ids; folds other than the held-out one)."""
    rng = np.random.default_rng(SEED)
    waves = rng.normal(0, np.sqrt(2 / N_STATISTICS), (N_STATISTICS, FEATURES))
    model = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), waves, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.avg(label_col).alias("y"))
    many = labels.count()
    share = F.lit(1.0) if many <= max_rows else F.lit(max_rows / many)
    # At most max_rows (id, label) pairs, some hundred kilobytes.
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = written(rows.select(fold(F.col("doc_id")).alias("fold"), "y", _statistics(no_null("text")).alias("x")).repartition(16))
    stats = rows.agg(*[f(F.get("x", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if stats["avg0"] is None:
        return model
    model.mean = np.array([stats[f"avg{i}"] for i in range(N_STATISTICS)])
    model.scale = np.maximum(np.array([stats[f"stddev_pop{i}"] for i in range(N_STATISTICS)]), 1e-3)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for part in parts:
            if len(part):
                z, y = model.cosines(_matrix(part["x"])), part["y"].to_numpy(np.float64)
                a, b, n = a + z.T @ z, b + z.T @ y, n + len(z)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
    for part in rows.where(F.col("fold") != CALIBRATE).mapInPandas(sums, "a binary, b binary, n bigint").collect():
        a += np.frombuffer(part["a"]).reshape(a.shape)
        b += np.frombuffer(part["b"])
        n += part["n"]
    model.weights = np.linalg.solve(a + RIDGE * max(1, n) / FEATURES * np.eye(FEATURES + 1), b)

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(_matrix(x)))

    # Without calibration rows, those of the fit serve.
    own = rows.where(F.col("fold") == CALIBRATE)
    scored = (own if not own.isEmpty() else rows).select("y", raw("x").alias("s"))
    binned = scored.groupBy(F.floor(F.col("s") * (SCORE_BINS / 2)).alias("bin")).agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    found = sorted((r["s"], r["y"], r["n"]) for r in binned.collect())
    at, mean, weight = (np.array(v, dtype=np.float64) for v in zip(*found, strict=True))
    model.at, model.value = isotonic(at, mean, weight)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a document is good."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATISTICS)), dtype="float64")

    return docs.withColumn(out_col, run(no_null(docs[text_col])))


def document_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Score and prediction of every document, and whether its labels were held out."""
    model = learn(docs, labels, max_rows)
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
