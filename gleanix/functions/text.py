"""The analyser: cleaning, tokens, stop words, stems, twenty-character terms."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gleanix.functions.porter import stem

# The patterns and replacements of the cleaning steps, in order.  Control characters are spelled as
# ranges, because the SQL engine that results are checked with has no intersection of classes; classes leave out
# characters that an earlier step has removed.
PREFIX = (r"^[0-9].*\t", " ")
CLEANING = [
    (r"[^\x00-\x7F]", ""),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    (r"\p{C}", ""),
    (r"'s", ""),
    (r"(([a-zA-Z]+)([0-9]+)([a-zA-Z]+))", " "),
    (r"(([a-zA-Z]+)([-_.,#@+*$%&]+)([a-zA-Z]+))", " "),
    (r"([\[\_\(\)\{\}\]]+)([0-9]+)", "$2"),
    (r"([0-9]+)([\[\_\(\)\{\}\]]+)", "$1"),
    (r"([\W])([a-zA-Z]+)", " $2"),
    (r"([a-zA-Z]+)([\W])+", "$1 "),
    (r"[!._'?\"#$,;%&=\{\}\[\]\(\)]", ""),
    (r"(^[a-zA-Z]+)([0-9]+$)", "$1 "),
    (r"(^[0-9]+)([a-zA-Z]+$)", " $2"),
    (r"(^[\W])([a-zA-Z]+$)", " $2"),
    (r"(^[a-zA-Z]+)([\W])+$", "$1 "),
    (r"[^a-zA-Z ]", ""),
    (r"[ ]{2,}", " "),
    (r"^[ ]", ""),
]
TERM_WIDTH = 20


def once(expression: Column) -> Column:
    """For a select: the same values, but a later filter on them doesn't make Spark work them out a second time."""
    return F.explode(F.array(expression))


def one_line(text: str | Column) -> Column:
    """A collection is read line by line; what would break a line is a blank here."""
    return F.regexp_replace(text, r"[\r\n\t]+", " ")


def clean(text: str | Column) -> Column:
    """The cleaning steps in order.  Null stays null."""
    column = F.regexp_replace(text, *PREFIX)
    for pattern, replacement in CLEANING:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def tokens(cleaned: str | Column) -> Column:
    """Lower-cased tokens; an empty text has one blank token."""
    return F.split(F.rtrim(F.lower(cleaned)), r"\s+")


def without(words: Column, stop: Iterable[str]) -> Column:
    stop = sorted(set(stop))
    return F.filter(words, lambda t: ~t.isin(stop)) if stop else words


def cut_terms(words: Column) -> Column:
    return F.transform(words, lambda t: F.substring(t, 1, TERM_WIDTH))


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stem of every token.  Stems are kept by word within a worker, so each word is stemmed once there."""
    return pd.Series([None if ws is None else [stem(w) for w in ws] for ws in words], dtype=object)


def analyse(documents: DataFrame, text: str = "text", stop: Iterable[str] | None = None, stemmed: bool = False, lines: bool = True) -> DataFrame:
    """Replaces ``text`` by ``tokens``, an array of terms in order.

    Null texts, and texts of which every token is a stop word, have no row.  A
    text that cleans to nothing has the one blank term.  The raw variant is
    ``stop=None, stemmed=False``; the stemmed one drops stop words first.
    Without ``lines`` the text did not come as the second field of a line: its
    tabs are kept, and a number at its start is dropped up to the last of them.
    """
    words = tokens(clean(one_line(text) if lines else F.col(text)))
    others = [c for c in documents.columns if c not in (text, "tokens")]
    rows = documents.where(F.col(text).isNotNull())
    if stop is None:
        rows = rows.select(*others, words.alias("tokens"))  # a text has at least the blank token
    else:
        rows = rows.select(*others, once(without(words, stop)).alias("tokens")).where(F.size("tokens") > 0)
    if stemmed:
        rows = rows.withColumn("tokens", stems("tokens"))
    return rows.withColumn("tokens", cut_terms(F.col("tokens")))
