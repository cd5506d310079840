"""Problem 2: per-term figures where a few terms own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanix.operators.skew import heavy_terms, term_figures
from gleanix.sources.tables import table


def _calls(spark: SparkSession, data_dir: str) -> tuple[DataFrame, int]:
    calls = table(spark, data_dir, "term_stream")
    return calls, calls.count()


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    return heavy_terms(*_calls(spark, data_dir)).select("term")


def figures(spark: SparkSession, data_dir: str) -> DataFrame:
    """(term, cf, df, max_tf) of every term; an empty stream gives no rows."""
    return term_figures(*_calls(spark, data_dir))


def heavy(spark: SparkSession, data_dir: str) -> DataFrame:
    """The heavy terms with their figures and their share of all occurrences."""
    return heavy_terms(*_calls(spark, data_dir)).select("term", "cf", "df", "max_tf", F.round(F.col("cf") / F.col("total_cf"), 9).alias("share"))


_FIGURES = """WITH occ AS (SELECT DISTINCT add_id, rtrim(term, ' ') AS term, doc_id FROM term_stream WHERE term IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY 1, 2), f AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df, max(tf) AS max_tf FROM p GROUP BY 1), t AS (SELECT sum(cf)::BIGINT AS total FROM f)"""

QUERIES = {"p2_found": found, "p2_term_figures": figures, "p2_heavy_terms": heavy}
SQL = {
    "p2_found": f"{_FIGURES} SELECT term FROM f, t WHERE cf >= 0.01::DOUBLE * total",
    "p2_term_figures": f"{_FIGURES} SELECT term, cf, df, max_tf FROM f",
    "p2_heavy_terms": f"{_FIGURES} SELECT term, cf, df, max_tf, round(cf / total::DOUBLE, 9) AS share FROM f, t WHERE cf >= 0.01::DOUBLE * total",
}
