"""Secret scans with a randomness test battery (operator 4), in DataFrame
functions only.

Base spans come from three patterns.  Beyond them every run of 20 or more
encoding characters is a candidate.  Its encoding is inferred (hex, base32,
base62, base64; pure numbers are none), its characters become positions in
that alphabet, and three tests are taken:

- chi-squared uniformity over the alphabet, against what text of that length
  would give (a non-central chi-squared, so the evidence grows with length);
- Wald-Wolfowitz runs above and below the middle of the alphabet;
- serial correlation of neighbours.

The first gives the p-value of "this is text"; sequence tests that speak
against randomness raise it.  Discoveries are controlled by Benjamini-Hochberg
within each encoding and length band, so many short tokens do not use up the
error budget of long ones: p-values are counted in fixed bins, and the cut of
a band is the largest bin edge t with ``m * t <= q * (p-values <= t)``.  The
counts are a partial aggregate of at most some thousand rows; the texts are
scanned twice and never shuffled.

Offsets are code points, ends exclusive.  Null texts count as empty.  Spans
found by the tests inside a base span are not repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyforge.llm.common import no_null

# The base patterns, and characters that encodings use.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_HEX_ALPHABET = "0123456789abcdef"
_B32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Divergence k * sum(p^2) - 1 that text shows in each alphabet.
TEXT_DIVERGENCE = {16: 1.0, 32: 1.3, 62: 2.5, 64: 2.5}
KINDS = ("assign", "access", "hex", "random")
Q = 0.05
BINS_PER_DECADE, MAX_BIN = 8, 400


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, also where it is used for every element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(lengths: Column) -> Column:
    """Prefix sums of an array in log2(n) passes."""
    return F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + F.lit(1))).cast("int")), lengths,
        lambda acc, d: _let(F.pow(F.lit(2.0), d).cast("int"), lambda step: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0)))))


def _spans(text: Column, pattern: str, least_value: int = 0) -> Column:
    """array<struct<start, stop, token, value>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if least_value else 0))

    def placed(m: Column) -> Column:
        steps = F.transform(m["found"], lambda x, i: F.length(F.get(m["between"], i)) + F.when(i > 0, F.length(F.get(m["found"], i - 1))).otherwise(0))
        return _let(_let(steps, _running), lambda starts: F.transform(m["found"], lambda x, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(x)).alias("stop"), x.alias("token"), F.get(m["values"], i).alias("value"))))

    spans = _let(F.struct(found.alias("found"), values.alias("values"), F.split(text, pattern, -1).alias("between")), placed)
    none = F.array().cast("array<struct<start:int,stop:int,token:string,value:string>>")
    spans = F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least_value) if least_value else spans


def _tail(x: Column) -> Column:
    """P(Z > x) for x >= 0, by the polynomial 26.2.17 of Abramowitz and Stegun."""
    t = F.lit(1.0) / (x * 0.2316419 + 1)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) * 0.3989422804014327 * poly


def _below(z: Column) -> Column:
    """P(Z < z)."""
    return F.when(z < 0, _tail(F.abs(z))).otherwise(1 - _tail(F.abs(z)))


def _encoding(token: Column) -> Column:
    """Size of the inferred alphabet; null for pure numbers and single cases of a letter run."""
    return (F.when(token.rlike(r"^[0-9]+$"), F.lit(None))
            .when(token.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), F.lit(16))
            .when(token.rlike(r"^[A-Z2-7]+={0,2}$") & token.rlike("[2-7]"), F.lit(32))
            .when(token.rlike(r"^[A-Za-z0-9]+$"), F.lit(62))
            .otherwise(F.lit(64)))


def _tested(span: Column) -> Column:
    """struct<start, stop, k, n, p> of one candidate."""
    token = span["token"]
    k = _encoding(token)
    symbols = F.when(k == 16, F.lower(token)).otherwise(F.translate(F.rtrim(token, F.lit("=")), "-_", "+/"))
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), k.alias("k"), symbols.alias("symbols"))


def _places(c: Column) -> Column:
    alphabet = F.when(c["k"] == 16, F.lit(_HEX_ALPHABET)).when(c["k"] == 32, F.lit(_B32_ALPHABET)).otherwise(F.lit(_B64_ALPHABET))
    places = F.transform(F.split(c["symbols"], ""), lambda s: (F.instr(alphabet, s) - 1).cast("double"))
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["k"].cast("double").alias("k"), places.alias("x"))


def _centred(c: Column) -> Column:
    n = F.size(c["x"]).cast("double")
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["k"].alias("k"), c["x"].alias("x"), F.array_sort(c["x"]).alias("y"), n.alias("n"),
                    (F.aggregate(c["x"], F.lit(0.0), lambda s, v: s + v) / n).alias("mean"))


def _sums(c: Column) -> Column:
    x, y, k, n, mean = c["x"], c["y"], c["k"], c["n"], c["mean"]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    # The sorted places give the sum of squared counts: each run of length c adds 1 + 3 + ... + (2c - 1).
    squares = F.aggregate(y, F.struct(F.lit(-1.0).alias("v"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda a, v: F.struct(
        v.alias("v"), F.when(v == a["v"], a["c"] + 1).otherwise(1.0).alias("c"),
        (a["s"] + F.when(v == a["v"], 2 * a["c"] + 1).otherwise(1.0)).alias("s")), lambda a: a["s"])
    high = total(F.transform(x, lambda v: (v >= k / 2).cast("double")))
    runs = total(F.transform(x, lambda v, i: F.when((i > 0) & ((v >= k / 2) != (F.get(x, i - 1) >= k / 2)), 1.0).otherwise(0.0))) + 1
    spread = total(F.transform(x, lambda v: v * v)) - n * mean * mean
    serial = total(F.transform(x, lambda v, i: F.when(i > 0, (v - mean) * (F.get(x, i - 1) - mean)).otherwise(0.0)))
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), k.alias("k"), n.alias("n"), squares.alias("squares"), high.alias("high"), runs.alias("runs"), spread.alias("spread"), serial.alias("serial"))


def _judged(c: Column) -> Column:
    k, n, high = c["k"], c["n"], c["high"]
    chi = k * c["squares"] / n - n
    divergence = F.when(k == 16, TEXT_DIVERGENCE[16]).when(k == 32, TEXT_DIVERGENCE[32]).otherwise(TEXT_DIVERGENCE[64])
    p_text = _below((chi - (k - 1) - n * divergence) / F.sqrt(2 * (k - 1) + 4 * n * divergence))
    both = 2 * high * (n - high)
    variance = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(variance > 0, (c["runs"] - both / n - 1) / F.sqrt(variance)).otherwise(F.lit(9.0))
    z_serial = F.when(c["spread"] > 0, c["serial"] / c["spread"] * F.sqrt(n)).otherwise(F.lit(9.0))
    sequence = F.least(F.lit(1.0), 4 * _tail(F.greatest(F.abs(z_runs), F.abs(z_serial))))
    p = F.greatest(F.least(F.lit(1.0), p_text / F.greatest(sequence, F.lit(1e-12))), F.lit(1e-50))
    bin_ = F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), k.cast("int").alias("k"), band(n).alias("band"), F.least(bin_, F.lit(MAX_BIN)).alias("bin"))


def band(n: Column) -> Column:
    """Length band: 20-31, 32-47, 48-63, 64-127, 128-255, 256 and more characters."""
    return F.when(n < 32, 0).when(n < 48, 1).when(n < 64, 2).when(n < 128, 3).when(n < 256, 4).otherwise(5)


def candidates(text: Column) -> Column:
    """array<struct<start, stop, k, band, bin>> of all tested runs of a text."""
    found = F.filter(F.transform(_spans(text, CANDIDATE), _tested), lambda c: c["k"].isNotNull())
    return F.transform(F.transform(F.transform(F.transform(found, _places), _centred), _sums), _judged)


def false_discovery_cuts(docs: DataFrame, text_col: str = "text", q: float = Q) -> dict[tuple[int, int], int]:
    """Least bin that counts as a discovery, by encoding and length band.  At
    most (encodings x bands x bins) counts come to the driver."""
    each = docs.select(F.explode(candidates(no_null(docs[text_col]))).alias("c")).groupBy("c.k", "c.band", "c.bin").count()
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for k, b, bin_, n in each.collect():
        strata.setdefault((k, b), {})[bin_] = n
    cuts = {}
    for key, counts in strata.items():
        m, reached = sum(counts.values()), 0
        for bin_ in sorted(counts, reverse=True):
            reached += counts[bin_]
            if m * 10.0 ** (-bin_ / BINS_PER_DECADE) <= q * reached:
                cuts[key] = bin_
    return cuts


def _found(text: Column, cuts: dict[tuple[int, int], int]) -> Column:
    """array<struct<start, kind, stop>>, kind as a place in KINDS, sorted."""
    def named(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    base = F.concat(*[named(spans, kind) for kind, spans in enumerate((_spans(text, ASSIGN, 6), _spans(text, ACCESS), _spans(text, HEX)))])
    if not cuts:
        return F.array_sort(base)
    passes = lambda c: F.coalesce(F.greatest(*[((c["k"] == k) & (c["band"] == b) & (c["bin"] >= cut)) for (k, b), cut in sorted(cuts.items())], F.lit(False)), F.lit(False))
    return F.array_sort(F.concat(base, named(F.filter(candidates(text), passes), 3)))


def secret_spans(docs: DataFrame, text_col: str = "text", q: float = Q, out_col: str = "secret_spans", cuts: dict | None = None) -> DataFrame:
    """``docs`` with array<struct<start, kind, stop>> of all secrets, by start, then kind."""
    cuts = false_discovery_cuts(docs, text_col, q) if cuts is None else cuts
    every = docs.withColumn(out_col, _found(no_null(docs[text_col]), cuts))
    inside = lambda s: (s["kind"] == 3) & F.exists(F.col(out_col), lambda b: (b["kind"] < 3) & (b["start"] <= s["start"]) & (b["stop"] >= s["stop"]))
    return every.withColumn(out_col, F.filter(out_col, lambda s: ~inside(s)))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def document_secrets(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans, per document."""
    found = secret_spans(docs.select("doc_id", "text"), out_col="found").select("doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_of(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _text_of(F.col("found")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", q: float = Q) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; texts
    without secrets, nulls included, stay as they are."""
    columns, spans = docs.columns, "__secret_spans"
    found = secret_spans(docs, text_col, q, spans)
    # Overlapping spans become one: keep a span's start unless an earlier one reaches over it.
    joined = F.aggregate(
        F.col(spans), F.array().cast("array<struct<start:int,stop:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["stop"] >= s["start"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))))
    found = found.withColumn(spans, joined)
    pieces = F.transform(spans, lambda s, i: F.concat(
        F.substring(F.col(text_col), F.when(i > 0, F.get(F.col(spans), i - 1)["stop"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(F.col(spans), i - 1)["stop"]).otherwise(0)), F.lit(mark)))
    rest = F.substring(F.col(text_col), F.element_at(F.col(spans), -1)["stop"] + 1, F.length(text_col))
    text = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(*columns)
