"""Term weights as column expressions.

Both ask for the columns tf and df; BM25 for dl and avgdl too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking formulas.
K1 = 1.2
B = 0.75

_MINUS_INFINITY = float("-inf")


def _ln(x: Column) -> Column:
    """Natural logarithm; minus infinity at zero, where Spark's own gives null and would vanish in a sum."""
    return F.when(x > 0, F.ln(x)).when(x.isNotNull(), F.lit(_MINUS_INFINITY))


def idf(n_docs: int, floor: bool = True, df: str = "df") -> Column:
    """ln(N / df), with integer division if ``floor``; null where df is 0 or null."""
    divisor = F.nullif(F.col(df).cast("bigint"), F.lit(0).cast("bigint"))
    if floor:
        return _ln(F.floor(F.lit(float(n_docs)) / divisor))
    return _ln(F.lit(float(n_docs)) / divisor)


def tfidf_weight(n_docs: int, floor: bool = True, df: str = "df") -> Column:
    return (1 + F.ln("tf")) * idf(n_docs, floor, df)


def bm25_weight(n_docs: int, k1: float = K1, b: float = B, df: str = "df") -> Column:
    return F.col("tf") / (F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")) + F.col("tf")) * idf(n_docs, False, df)


def weight(scoring: str, n_docs: int, floor: bool = True, df: str = "df") -> Column:
    if scoring == "tfidf":
        return tfidf_weight(n_docs, floor, df)
    if scoring == "bm25":
        return bm25_weight(n_docs, df=df)
    raise ValueError(f"scoring must be 'tfidf' or 'bm25', not {scoring!r}")
