"""Problem 5: how distinctive a term is for a record, by probabilistic weighting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanix.functions.scoring import B, K1, bm25_weight, tfidf_weight
from gleanix.operators.skew import join_stats
from gleanix.session import cut
from gleanix.sources.tables import n_documents, record_terms, table


def weights(pairs: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, term, tf) -> (doc_id, term, tf, df, dl, avgdl, w_tfidf, w_bm25) for every record and term.

    df is the number of records with the term, dl the record's occurrences,
    avgdl their mean over the records that have any.  ``pairs`` is read several
    times and should be a written table.  An empty table gives no rows.
    """
    lexicon = cut(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "lexicon")
    lengths = cut(pairs.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("n_terms")), "lengths")
    total = lengths.agg(F.sum("n_terms").alias("pairs"), F.avg("dl").alias("avgdl")).first()
    rows = join_stats(pairs, lexicon, "term", "df", total.pairs or 0)
    rows = rows.join(lengths.select("doc_id", "dl"), "doc_id").withColumn("avgdl", F.lit(total.avgdl).cast("double"))
    return rows.withColumn("w_tfidf", tfidf_weight(n_docs)).withColumn("w_bm25", bm25_weight(n_docs))


def distinctive(weighted: DataFrame, n_docs: int, least: float = 1.5, least_df: int = 2) -> DataFrame:
    """The (doc_id, term) whose TF-IDF weight reaches ``least * ln N``, among those that their BM25 weight lets pass.

    Such a pair has ``1 + ln tf >= least * ln N / ln(N / df)``, hence at least a
    certain tf.  The BM25 weight grows with tf, so a pair whose BM25 weight is
    below that of this tf (same df, same length) is passed over; the rest are
    checked exactly.  The bound loses no pair.
    """
    top = least * math.log(n_docs) if n_docs > 0 else 0.0
    idf = F.ln(F.lit(float(n_docs)) / F.col("df"))
    tf_least = F.when(idf > 0, F.exp(F.lit(top) / idf - 1))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    candidates = weighted.where((F.col("df") >= least_df) & (F.col("df") < n_docs)).where(F.col("w_bm25") >= idf * tf_least / (norm + tf_least) - 1e-9)
    return candidates.where(F.col("w_tfidf") >= F.lit(top) - 1e-12).select("doc_id", "term")


def _inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, int]:
    return cut(record_terms(table(spark, data_dir, "term_stream")), "pairs"), n_documents(table(spark, data_dir, "doc_table"))


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    pairs, n = _inputs(spark, data_dir)
    return distinctive(weights(pairs, n), n)


def all_weights(spark: SparkSession, data_dir: str) -> DataFrame:
    pairs, n = _inputs(spark, data_dir)
    return weights(pairs, n).select("doc_id", "term", "tf", "df", F.round("w_tfidf", 6).alias("w_tfidf"), F.round("w_bm25", 6).alias("w_bm25"))


def top_terms(spark: SparkSession, data_dir: str, k: int = 5) -> DataFrame:
    """The ``k`` terms that are most distinctive of each record: (doc_id, rank, term, w_bm25), ties to the smaller term."""
    pairs, n = _inputs(spark, data_dir)
    best = Window.partitionBy("doc_id").orderBy(F.desc("w_bm25"), "term")  # Spark keeps k rows a record and task before the exchange
    rows = weights(pairs, n).select("doc_id", "term", F.round("w_bm25", 6).alias("w_bm25"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def term_bounds(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each term's highest weights, at least 0, beside the highest bound that the stored lexicon has for it (null where it has none)."""
    pairs, n = _inputs(spark, data_dir)
    zero = F.lit(0.0)
    bounds = weights(pairs, n).groupBy("term").agg(F.max("df").alias("df"), F.round(F.greatest(zero, F.max("w_tfidf")), 6).alias("ub_tfidf"), F.round(F.greatest(zero, F.max("w_bm25")), 6).alias("ub_bm25"))
    stored = table(spark, data_dir, "lexicon_line_final").groupBy(F.expr("rtrim(' ', term)").alias("term")).agg(F.round(F.max(F.col("term_upper_bound_tfidf").cast("double")), 4).alias("stored_ub_tfidf"))
    return bounds.join(stored, "term", "left")


_WEIGHTS = """WITH occ AS (SELECT DISTINCT add_id, rtrim(term, ' ') AS term, doc_id FROM term_stream WHERE term IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1), l AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM p GROUP BY 1),
n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_table), a AS (SELECT avg(dl) AS avgdl FROM l),
w AS (SELECT p.doc_id, p.term, tf, df, n, (1 + ln(tf)) * CASE WHEN n // df < 1 THEN '-inf'::DOUBLE ELSE ln(n // df) END AS w_tfidf,
 tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf) * ln(n::DOUBLE / df) AS w_bm25 FROM p JOIN d ON p.term = d.term JOIN l ON p.doc_id = l.doc_id, n, a)"""

QUERIES = {"p5_found": found, "p5_weights": all_weights, "p5_top_terms": top_terms, "p5_term_bounds": term_bounds}
SQL = {
    "p5_found": f"{_WEIGHTS} SELECT doc_id, term FROM w WHERE df >= 2 AND w_tfidf >= 1.5::DOUBLE * ln(n) - 1e-12",
    "p5_weights": f"{_WEIGHTS} SELECT doc_id, term, tf, df, round(w_tfidf, 6) AS w_tfidf, round(w_bm25, 6) AS w_bm25 FROM w",
    "p5_top_terms": f"{_WEIGHTS} SELECT doc_id, term, round(w_bm25, 6) AS w_bm25, row_number() OVER (PARTITION BY doc_id ORDER BY round(w_bm25, 6) DESC, term) AS rank FROM w QUALIFY rank <= 5",
    "p5_term_bounds": f"""{_WEIGHTS}, b AS (SELECT term, max(df) AS df, round(greatest(0::DOUBLE, max(w_tfidf)), 6) AS ub_tfidf, round(greatest(0::DOUBLE, max(w_bm25)), 6) AS ub_bm25 FROM w GROUP BY term),
s AS (SELECT rtrim(term, ' ') AS term, round(max(term_upper_bound_tfidf::DOUBLE), 4) AS stored_ub_tfidf FROM lexicon_line_final GROUP BY 1)
SELECT b.term, df, ub_tfidf, ub_bm25, stored_ub_tfidf FROM b LEFT JOIN s ON b.term = s.term""",
}
