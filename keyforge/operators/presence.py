"""JOIN4 / JOIN5: is a keyword present in its document?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyforge.functions.text import TOKEN_RE, fold


def presence(kws: DataFrame, docs: DataFrame) -> DataFrame:
    """JOIN4: (doc_id, kw, present) — ``kw`` equals one of the document's word
    tokens (exact, so multi-word phrases never match).  A left join against
    the distinct (doc_id, word) table; both sides are keyed by doc_id."""
    words = (docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN_RE), 0)).alias("word"))
             .distinct().withColumn("present", F.lit(True)))
    return (kws.join(words, (kws.doc_id == words.doc_id) & (kws.kw == words.word), "left")
            .select(kws.doc_id, kws.kw, F.coalesce(words.present, F.lit(False)).alias("present")))


def verbatim(kws: DataFrame, docs: DataFrame) -> DataFrame:
    """JOIN5: (doc_id, kw, verbatim) — the case-folded phrase occurs in the
    case-folded document text."""
    d = docs.select("doc_id", fold(F.col("text")).alias("ftext"))
    return (kws.join(d, "doc_id")
            .select("doc_id", "kw", F.col("ftext").contains(fold(F.col("kw"))).alias("verbatim")))
