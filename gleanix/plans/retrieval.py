"""The engine's operators as queries over ``collection_tsv`` and ``queries_test``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanix.functions import text as T
from gleanix.operators import index as I
from gleanix.operators import search as S
from gleanix.plans import oracle as O
from gleanix.session import cut, new_path, scratch_dir
from gleanix.sources.tables import last_query, latest_records, read_collection_tsv, read_run, table, write_collection_tsv, write_run

#: The query of the single-query operators.
QUERY = "The footnote and the canal of Glenwell, 12 lanterns: footnote!"
#: A query as typed in, whose first field is a number and is dropped.
TYPED = "7 old lanterns\tThe canal of Glenwell, and a footnote"
VARIANTS = {"raw": (False, False), "stop": (True, False), "stem": (True, True)}


def documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, text): one row a record; records without a text are left out."""
    rows = table(spark, data_dir, "collection_tsv").where("doc_in IS NOT NULL")
    return latest_records(rows, "doc_in").withColumnRenamed("doc_in", "text")


def _stop(spark: SparkSession, data_dir: str) -> list[str]:
    return I.stop_list(table(spark, data_dir, "stop_words"))


def analysed(spark: SparkSession, data_dir: str, variant: str) -> DataFrame:
    stop, stemmed = VARIANTS[variant]
    return T.analyse(documents(spark, data_dir), "text", _stop(spark, data_dir) if stop else None, stemmed)


_BUILT: dict[tuple[str, str, str], str] = {}


def index(spark: SparkSession, data_dir: str, variant: str) -> I.Index:
    """The index of one variant, built in the scratch folder by the first query that asks for it and loaded by all."""
    key = (scratch_dir(spark), data_dir, variant)
    stop, stemmed = VARIANTS[variant]
    if key not in _BUILT:
        path = new_path(spark, f"index-{variant}")
        I.build_index(cut(documents(spark, data_dir), "documents"), path, _stop(spark, data_dir) if stop else None, stemmed)
        _BUILT[key] = path
    return I.load_index(spark, _BUILT[key], stemmed)


def _queries(spark: SparkSession, data_dir: str) -> DataFrame:
    return last_query(table(spark, data_dir, "queries_test"))


def clean_text(spark: SparkSession, data_dir: str) -> DataFrame:
    return documents(spark, data_dir).select("doc_id", T.clean(T.one_line("text")).alias("cleaned"))


def _tokens(variant: str):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return analysed(spark, data_dir, variant).select("doc_id", F.posexplode("tokens").alias("pos", "term")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")

    return run


def _doc_table(variant: str):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return I.document_table(analysed(spark, data_dir, variant))

    return run


def corpus_stats(spark: SparkSession, data_dir: str) -> DataFrame:
    return I.corpus_stats(documents(spark, data_dir), I.document_table(analysed(spark, data_dir, "raw")))


def _postings(variant: str):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return I.postings(analysed(spark, data_dir, variant))

    return run


def lexicon(spark: SparkSession, data_dir: str) -> DataFrame:
    return I.lexicon(I.postings(analysed(spark, data_dir, "raw")))


def sorted_lexicon(spark: SparkSession, data_dir: str) -> DataFrame:
    """The lexicon in order of the terms' bytes, with each term's place: parts by range, places by the parts before."""
    table_ = cut(lexicon(spark, data_dir).withColumn("head", F.substring("term", 1, 2)), "lexicon")
    ahead = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # one row for each pair of letters
    heads = table_.groupBy("head").agg(F.count(F.lit(1)).alias("n")).select("head", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return table_.join(heads, "head").select("term", "cf", "df", (F.row_number().over(Window.partitionBy("head").orderBy("term")) + F.col("ahead")).cast("bigint").alias("place"))


def term_bounds(spark: SparkSession, data_dir: str) -> DataFrame:
    return index(spark, data_dir, "raw").lexicon.select("term", F.round("ub_tfidf", 6).alias("ub_tfidf"), F.round("ub_bm25", 6).alias("ub_bm25"))


def score_postings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Both weights of every posting."""
    ix = index(spark, data_dir, "stem")
    rows = I.weighted(ix.postings.join(ix.lexicon.select("term", "df"), "term"), ix.n_docs, ix.avgdl)
    return rows.select("term", "doc_id", "tf", F.round("w_tfidf", 6).alias("w_tfidf"), F.round("w_bm25", 6).alias("w_bm25"))


def dgaps(spark: SparkSession, data_dir: str) -> DataFrame:
    return index(spark, data_dir, "raw").postings.select("term", "doc_id", "block", "gap")


def dgap_decode(spark: SparkSession, data_dir: str) -> DataFrame:
    return I.from_gaps(index(spark, data_dir, "raw").postings)


def index_lexicon(spark: SparkSession, data_dir: str) -> DataFrame:
    """The written lexicon."""
    return index(spark, data_dir, "raw").lexicon.select("term", "cf", "df", "n_block")


def skip_blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    """The written skip blocks."""
    return index(spark, data_dir, "raw").skips


def file_offsets(spark: SparkSession, data_dir: str) -> DataFrame:
    return I.file_offsets(index(spark, data_dir, "raw").skips).select("term", "block", "offset_doc", "offset_tf")


def index_size(spark: SparkSession, data_dir: str) -> DataFrame:
    return I.index_size(index(spark, data_dir, "raw").skips)


def codec_roundtrip(spark: SparkSession, data_dir: str) -> DataFrame:
    """All postings, from the coded blocks that the index was written with."""
    return I.decode_blocks(index(spark, data_dir, "raw").coded).select("term", "doc_id", "tf")


def codec_bytes(spark: SparkSession, data_dir: str) -> DataFrame:
    """The length of each written block's codes."""
    return index(spark, data_dir, "raw").coded.select("term", "block", F.length("doc_codes").cast("bigint").alias("len_doc_bytes"), F.length("tf_codes").cast("bigint").alias("len_tf_bytes"))


def collection_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    """The collection written as tab-separated lines and read again."""
    path = new_path(spark, "collection-tsv")
    write_collection_tsv(documents(spark, data_dir), path)
    return read_collection_tsv(spark, path)


def run_sink(spark: SparkSession, data_dir: str) -> DataFrame:
    """The run file, written and read again."""
    path = new_path(spark, "run")
    write_run(run_file(spark, data_dir), path)
    return read_run(spark, path)


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUERY)], "qid INT, text STRING")


def term_lookup(spark: SparkSession, data_dir: str) -> DataFrame:
    ix = index(spark, data_dir, "raw")
    return S.query_terms(_one(spark), ix).join(ix.lexicon, "term").select("term", "cf", "df", "n_block")


def _single(variant: str, mode: str, scoring: str, k: int = 3, text: str = QUERY, **options):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return S.search(text, index(spark, data_dir, variant), mode, scoring, k, **options)

    return run


def _batch(variant: str, mode: str, scoring: str, k: int, **options):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return S.search_batch(_queries(spark, data_dir), index(spark, data_dir, variant), mode, scoring, k, **options)

    return run


def _pruned(scoring: str):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return S.search_pruned(_queries(spark, data_dir), index(spark, data_dir, "raw"), scoring, 3)

    return run


def prefix_bounds(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = S.bound_prefixes(_queries(spark, data_dir), index(spark, data_dir, "stem"))
    return rows.select("qid", "term", F.round("ub", 6).alias("ub"), F.round("upto", 5).alias("upto"))


def run_file(spark: SparkSession, data_dir: str) -> DataFrame:
    return S.batch_run(_queries(spark, data_dir), index(spark, data_dir, "stem"))


def query_set(spark: SparkSession, data_dir: str) -> DataFrame:
    return _queries(spark, data_dir)


def stored_lexicon_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """The blocks' lexicon lines merged by term: counts summed over blocks, a line written twice counted once.

    A null count counts as nothing; a term with null counts only has 0.
    """
    lines = table(spark, data_dir, "lexicon_line").groupBy("block_no", F.expr("rtrim(' ', term)").alias("term")).agg(F.max("cf").alias("cf"), F.max("df").alias("df"))
    return lines.groupBy("term").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("cf"), F.coalesce(F.sum("df"), F.lit(0)).alias("df"), F.count(F.lit(1)).alias("blocks"))


_BLOCKS = """b0 AS (SELECT term, doc_id, tf, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS place, ceil(sqrt(count(*) OVER (PARTITION BY term)))::BIGINT AS size FROM posts),
b1 AS (SELECT term, doc_id, tf, (place // size)::INT AS block FROM b0),
blocks AS (SELECT term, doc_id, tf, block, doc_id + 1 - coalesce(lag(doc_id + 1) OVER (PARTITION BY term, block ORDER BY doc_id), 0) AS gap FROM b1),
skips AS (SELECT term, block, min(doc_id) AS first_doc_id, max(doc_id) AS final_doc_id, count(*)::INT AS n_postings, sum(ceil((2 * (length(bin(gap)) - 1) + 1) / 8.0))::BIGINT AS len_doc_bytes, sum(tf // 8 + 1)::BIGINT AS len_tf_bytes FROM blocks GROUP BY 1, 2)"""
_TYPED = f"qs AS (SELECT 0 AS qid, ' {TYPED.split(chr(9))[1]}' AS text)"
_ONE = f"qs AS (SELECT 0 AS qid, {O.literal(QUERY)} AS text)"


def _sql_one(variant: str, mode: str, weight: str, k: int = 3, query: str = _ONE) -> str:
    return O.index(variant, True).replace(O.QUERIES, query) + ",\n" + O.ranked(weight, mode, k) + " SELECT rank, doc_id, score FROM top"


def _sql_batch(variant: str, mode: str, weight: str, k: int, df: str = "df") -> str:
    return O.index(variant, True) + ",\n" + O.ranked(weight, mode, k, df) + " SELECT qid, rank, doc_id, score FROM top"


_RUN = O.index("stem", True) + ",\n" + O.ranked(O.TFIDF, "or", 1) + " SELECT qid, 0 AS iter, doc_id, 1 AS rel FROM top UNION ALL SELECT qid, 0, -1, 1 FROM qs ANTI JOIN q USING (qid)"

QUERIES = {
    "clean_text": clean_text,
    "tokens_raw": _tokens("raw"),
    "tokens_stop": _tokens("stop"),
    "tokens_stem": _tokens("stem"),
    "doc_table": _doc_table("raw"),
    "doc_table_stem": _doc_table("stem"),
    "corpus_stats": corpus_stats,
    "postings": _postings("raw"),
    "postings_stem": _postings("stem"),
    "lexicon": lexicon,
    "sorted_lexicon": sorted_lexicon,
    "term_bounds": term_bounds,
    "score_postings": score_postings,
    "dgaps": dgaps,
    "dgap_decode": dgap_decode,
    "index_lexicon": index_lexicon,
    "skip_blocks": skip_blocks,
    "file_offsets": file_offsets,
    "index_size": index_size,
    "codec_roundtrip": codec_roundtrip,
    "codec_bytes": codec_bytes,
    "term_lookup": term_lookup,
    "or_tfidf_top3": _single("raw", "or", "tfidf"),
    "or_bm25_top3": _single("raw", "or", "bm25"),
    "pruned_or_tfidf_top3": _single("raw", "or", "tfidf", pruned=True),
    "pruned_or_bm25_top3": _single("raw", "or", "bm25", pruned=True),
    "typed_or_bm25_top3": _single("raw", "or", "bm25", text=TYPED),
    "and_tfidf_top3": _single("raw", "and", "tfidf"),
    "and_bm25_top3": _single("raw", "and", "bm25"),
    "batch_or_tfidf_top1": _batch("stem", "or", "tfidf", 1),
    "batch_or_tfidf_top3": _batch("raw", "or", "tfidf", 3),
    "batch_or_bm25_topk": _batch("stem", "or", "bm25", 10),
    "batch_and_tfidf_top3": _batch("stem", "and", "tfidf", 3),
    "batch_and_bm25_top3": _batch("raw", "and", "bm25", 3),
    "compat_cf_as_df": _batch("stem", "or", "bm25", 3, df_source="cf"),
    "pruned_topk": _pruned("bm25"),
    "pruned_topk_tfidf": _pruned("tfidf"),
    "prefix_bounds": prefix_bounds,
    "run_file": run_file,
    "run_sink": run_sink,
    "collection_scan": collection_scan,
    "query_set": query_set,
    "merged_lexicon_lines": stored_lexicon_lines,
}
SQL = {
    "clean_text": f"WITH {O.DOCS} SELECT doc_id, {O.clean("regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g')")} AS cleaned FROM docs",
    "tokens_raw": O.index("raw") + " SELECT doc_id, pos, term FROM t",
    "tokens_stop": O.index("stop") + " SELECT doc_id, pos, term FROM t",
    "tokens_stem": O.index("stem") + " SELECT doc_id, pos, term FROM t",
    "doc_table": O.index("raw") + " SELECT doc_id, dl FROM dt",
    "doc_table_stem": O.index("stem") + " SELECT doc_id, dl FROM dt",
    "corpus_stats": O.index("raw") + " SELECT n AS n_docs, avgdl FROM stats",
    "postings": O.index("raw") + " SELECT term, doc_id, tf, dl FROM posts",
    "postings_stem": O.index("stem") + " SELECT term, doc_id, tf, dl FROM posts",
    "lexicon": O.index("raw") + " SELECT term, cf, df, ceil(df / ceil(sqrt(df)))::INT AS n_block FROM lex",
    "sorted_lexicon": O.index("raw") + " SELECT term, cf, df, row_number() OVER (ORDER BY term) AS place FROM lex",
    "term_bounds": O.index("raw") + f" SELECT term, round(greatest(0::DOUBLE, max({O.TFIDF})), 6) AS ub_tfidf, round(greatest(0::DOUBLE, max({O.BM25})), 6) AS ub_bm25 FROM posts JOIN lex USING (term), stats GROUP BY term",
    "score_postings": O.index("stem") + f" SELECT term, doc_id, tf, round({O.TFIDF}, 6) AS w_tfidf, round({O.BM25}, 6) AS w_bm25 FROM posts JOIN lex USING (term), stats",
    "dgaps": O.index("raw") + f",\n{_BLOCKS} SELECT term, doc_id, block, gap FROM blocks",
    "dgap_decode": O.index("raw") + f",\n{_BLOCKS} SELECT term, block, doc_id, doc_id AS decoded FROM blocks",
    "index_lexicon": O.index("raw") + " SELECT term, cf, df, ceil(df / ceil(sqrt(df)))::INT AS n_block FROM lex",
    "skip_blocks": O.index("raw") + f",\n{_BLOCKS} SELECT * FROM skips",
    "file_offsets": O.index("raw") + f",\n{_BLOCKS} SELECT term, block, coalesce(sum(len_doc_bytes) OVER w, 0)::BIGINT AS offset_doc, coalesce(sum(len_tf_bytes) OVER w, 0)::BIGINT AS offset_tf FROM skips WINDOW w AS (ORDER BY term, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "index_size": O.index("raw") + f",\n{_BLOCKS} SELECT sum(n_postings * 8)::BIGINT AS doc_bytes_raw, sum(len_doc_bytes)::BIGINT AS doc_bytes, sum(n_postings * 4)::BIGINT AS tf_bytes_raw, sum(len_tf_bytes)::BIGINT AS tf_bytes FROM skips",
    "codec_roundtrip": O.index("raw") + " SELECT term, doc_id, tf FROM posts",
    "codec_bytes": O.index("raw") + f",\n{_BLOCKS} SELECT term, block, len_doc_bytes, len_tf_bytes FROM skips",
    "term_lookup": O.index("raw", True).replace(O.QUERIES, _ONE) + " SELECT term, cf, df, ceil(df / ceil(sqrt(df)))::INT AS n_block FROM lex SEMI JOIN qt USING (term)",
    "or_tfidf_top3": _sql_one("raw", "or", O.TFIDF),
    "or_bm25_top3": _sql_one("raw", "or", O.BM25),
    "pruned_or_tfidf_top3": _sql_one("raw", "or", O.TFIDF),
    "pruned_or_bm25_top3": _sql_one("raw", "or", O.BM25),
    "typed_or_bm25_top3": _sql_one("raw", "or", O.BM25, query=_TYPED),
    "and_tfidf_top3": _sql_one("raw", "and", O.TFIDF),
    "and_bm25_top3": _sql_one("raw", "and", O.BM25),
    "batch_or_tfidf_top1": _sql_batch("stem", "or", O.TFIDF, 1),
    "batch_or_tfidf_top3": _sql_batch("raw", "or", O.TFIDF, 3),
    "batch_or_bm25_topk": _sql_batch("stem", "or", O.BM25, 10),
    "batch_and_tfidf_top3": _sql_batch("stem", "and", O.TFIDF, 3),
    "batch_and_bm25_top3": _sql_batch("raw", "and", O.BM25, 3),
    "compat_cf_as_df": _sql_batch("stem", "or", O.BM25, 3, "cf"),
    "pruned_topk": _sql_batch("raw", "or", O.BM25, 3),
    "pruned_topk_tfidf": _sql_batch("raw", "or", O.TFIDF, 3),
    "prefix_bounds": O.index("stem", True)
    + f""", ub AS (SELECT term, greatest(0::DOUBLE, max({O.TFIDF})) AS ub FROM posts JOIN lex USING (term), stats GROUP BY term)
SELECT qid, term, round(ub, 6) AS ub, round(sum(ub) OVER (PARTITION BY qid ORDER BY ub, term ROWS UNBOUNDED PRECEDING), 5) AS upto FROM qt JOIN ub USING (term)""",
    "run_file": _RUN,
    "run_sink": _RUN,
    "collection_scan": f"WITH {O.DOCS} SELECT doc_id, regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g') AS text FROM docs",
    "query_set": f"WITH {O.QUERIES} SELECT qid, text FROM qs",
    "merged_lexicon_lines": """WITH l AS (SELECT block_no, rtrim(term, ' ') AS term, max(cf) AS cf, max(df) AS df FROM lexicon_line GROUP BY 1, 2)
SELECT term, coalesce(sum(cf), 0)::BIGINT AS cf, coalesce(sum(df), 0)::BIGINT AS df, count(*) AS blocks FROM l GROUP BY 1""",
}
