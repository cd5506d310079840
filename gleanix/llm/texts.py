"""Words of a text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """All maximal runs of letters and digits of the lower-cased text, in order; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bag(text: str | Column) -> Column:
    """The words in sorted order, joined by blanks: equal for texts with the same words equally often."""
    return F.concat_ws(" ", F.array_sort(words(text)))
