"""Ranked retrieval over an index, for one query or many at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanix.functions.scoring import weight
from gleanix.functions.text import analyse
from gleanix.operators.index import LEVELS, Index
from gleanix.operators.skew import join_stats
from gleanix.session import cut

#: Scores must be above this to be admitted.
ADMITTED = -1.0
#: Most (query, term) rows that are broadcast, and most distinct terms that are pushed to a scan as literals.
BROADCAST_ROWS, PUSHED_TERMS = 200_000, 1_000
#: Most ranges of documents that are pushed to a scan as literals.
PUSHED_RANGES = 64
#: Ids of a cell, in which documents and blocks meet.
CELL = 4096
#: Postings of a chunk of documents that a batch is scored against at once, about.
CHUNK_POSTINGS = 1_000_000
#: Scores are rounded to six places, so bounds are compared with as much tolerance.
EPSILON = 2e-6


def query_terms(queries: DataFrame, index: Index, lines: bool = True) -> DataFrame:
    """(qid, text) -> distinct (qid, term), by the analyser of the index.  Queries of stop words only have none.

    Without ``lines`` a query was typed in, not read as a field of a line (see :func:`analyse`).
    """
    return analyse(queries.select("qid", F.coalesce("text", F.lit("")).alias("text")), "text", index.stop, index.stemmed, lines).select("qid", F.explode("tokens").alias("term")).distinct()


def _source(df_source: str) -> Column:
    if df_source not in ("df", "cf"):
        raise ValueError("df_source must be 'df' or 'cf'")
    return F.col(df_source).alias("df")


def query_lexicon(queries: DataFrame, index: Index, df_source: str = "df", *more: str) -> DataFrame:
    """(qid, term, df, n_terms): the query terms that the index has; n_terms counts those of the query.

    ``df_source='cf'`` weights with collection instead of document frequencies.
    ``more`` columns of the lexicon are added.
    """
    known = query_terms(queries, index).join(index.lexicon.select("term", _source(df_source), *more), "term")
    return known.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("qid")))


def _weighted(rows: DataFrame, index: Index, scoring: str, floor: bool) -> DataFrame:
    return rows.withColumn("avgdl", F.lit(index.avgdl).cast("double")).withColumn("w", weight(scoring, index.n_docs, floor))


def _matches(terms: DataFrame, index: Index, scoring: str, floor: bool) -> DataFrame:
    """The weighted postings of ``terms``, a written table (qid, term, df, ...).

    The terms go to the postings, not the other way: they are broadcast while
    they are few, and pushed to the scan while they are few enough for that.
    More of them are joined with the terms' many postings split off.
    """
    size = terms.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("term").alias("terms")).first()
    postings = index.postings.select("term", "doc_id", "tf", "dl")
    if size.rows <= BROADCAST_ROWS:
        if size.terms <= PUSHED_TERMS:
            postings = postings.where(F.col("term").isin([r.term for r in terms.select("term").distinct().collect()]))
        return _weighted(postings.join(F.broadcast(terms), "term"), index, scoring, floor)
    others = [c for c in terms.columns if c not in ("term", "df")]
    by_term = cut(terms.groupBy("term", "df").agg(F.collect_list(F.struct(*others)).alias("of")), "by-term")
    total = by_term.agg(F.sum("df")).first()[0] or 0
    return _weighted(join_stats(postings, by_term, "term", "df", total).select("term", "doc_id", "tf", "dl", "df", F.explode("of").alias("of")).select("term", "doc_id", "tf", "dl", "df", "of.*"), index, scoring, floor)


def _top(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scores.where(F.col("score") > ADMITTED).withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def _mode(mode: str) -> None:
    if mode not in ("or", "and"):
        raise ValueError("mode must be 'or' or 'and'")


def _lookup(ids: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ids`` are in the ascending ``listed``, and the places there of those that are."""
    at = np.minimum(np.searchsorted(listed, ids), len(listed) - 1)
    hit = listed[at] == ids
    return hit, at[hit]


def _foremost(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents that can be among the k best once scores are rounded: of equal scores the k smallest ids."""
    if len(score) > k:
        keep = score >= np.partition(score, -k)[-k] - EPSILON
        ids, score = ids[keep], score[keep]
    if len(score) > k:
        order = np.lexsort((ids, -score))
        ids, score, n = ids[order], score[order], np.arange(len(order))
        keep = n - np.maximum.accumulate(np.where(np.r_[True, score[1:] != score[:-1]], n, 0)) < k
        ids, score = ids[keep], score[keep]
    return ids, score


def _chunk_scores(mode: str, k: int):
    """A function that scores the queries of a slice against the postings of a chunk of documents.

    'and' goes from a query's shortest list to its longest, so it costs what the
    shortest holds.  'or' adds up the lists of the needed terms and looks the
    others up only for documents that can still be among the k best.
    """

    def run(postings: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"no": np.zeros(0, "int64"), "doc_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        if postings.empty or terms.empty:
            return none
        docs, place = np.unique(postings["doc_id"].to_numpy(), return_inverse=True)
        tid, w = postings["tid"].to_numpy(), postings["w"].to_numpy()
        order = np.lexsort((place, tid))
        tid, place, w = tid[order], place[order], w[order]
        listed, starts = np.unique(tid, return_index=True)
        lists = {t: (place[a:b], w[a:b]) for t, a, b in zip(listed.tolist(), starts.tolist(), [*starts[1:].tolist(), len(tid)], strict=True)}
        total, seen = np.zeros(len(docs)), np.zeros(len(docs), dtype=bool)

        def conjunctive(found: list) -> tuple[np.ndarray, np.ndarray]:
            found = sorted(found, key=lambda x: len(x[0]))
            ids, score = found[0]
            for more, weights in found[1:]:
                hit, at = _lookup(ids, more)
                ids, score = ids[hit], score[hit] + weights[at]
            return ids, score

        def disjunctive(found: list, rest: list, least: float, open_: float) -> tuple[np.ndarray, np.ndarray]:
            if len(found) == 1:
                ids, score = found[0][0], found[0][1].copy()
            else:
                for more, weights in found:
                    total[more] += weights
                    seen[more] = True
                ids = np.flatnonzero(seen)
                score = total[ids]
                total[ids], seen[ids] = 0, False
            if rest:
                reach = max(least, np.partition(score, -k)[-k]) if len(score) >= k else least
                keep = score + open_ >= reach - EPSILON
                ids, score = ids[keep], score[keep]
                for more, weights in rest:
                    hit, at = _lookup(ids, more)
                    score[hit] += weights[at]
            keep = score >= least - EPSILON
            return ids[keep], score[keep]

        terms = terms.sort_values("no")
        asked, begins = np.unique(terms["no"].to_numpy(), return_index=True)
        ends = [*begins[1:].tolist(), len(terms)]
        words, needed, least, opens = (terms[c].tolist() for c in ("word", "needed", "least", "open"))
        out = []
        for no, a, b in zip(asked.tolist(), begins.tolist(), ends, strict=True):
            if mode == "and":
                found = [lists[t] for t in words[a:b] if t in lists]
                if len(found) < b - a:
                    continue
                ids, score = conjunctive(found)
            else:
                found = [lists[t] for t, n in zip(words[a:b], needed[a:b], strict=True) if n and t in lists]
                if not found:
                    continue
                rest = [lists[t] for t, n in zip(words[a:b], needed[a:b], strict=True) if not n and t in lists]
                ids, score = disjunctive(found, rest, least[a], opens[a])
            ids, score = _foremost(ids, score, k)
            out.append((np.full(len(ids), no), docs[ids], score))
        if not out:
            return none
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("no", "doc_id", "score"), zip(*out, strict=True), strict=True)})

    return run


def _batch_scores(sets: DataFrame, index: Index, mode: str, scoring: str, k: int, floor: bool) -> DataFrame:
    """(no, doc_id, score) of the documents that can be among the k best of a term set; ``sets`` is a written table (no, of, least, open).

    Postings are exchanged once, by document, as numbers: all that a document
    scores in any query is then known in its chunk, and only a chunk's best
    leave it.  Each chunk meets each slice of BROADCAST_ROWS (set, term) rows.
    """
    rows = sets.select("no", "least", "open", F.explode("of").alias("t")).select("no", "least", "open", "t.*")
    words = cut(rows.select("term", "df").distinct().withColumn("tid", F.monotonically_increasing_id()), "words")
    size = words.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    chunks = max(2 * sets.sparkSession.sparkContext.defaultParallelism, -(-size.postings // CHUNK_POSTINGS))
    slices = max(1, -(-(sets.agg(F.sum(F.size("of"))).first()[0] or 0) // BROADCAST_ROWS))
    postings = index.postings.select("term", "doc_id", "tf", "dl")
    if size.terms <= PUSHED_TERMS:
        postings = postings.where(F.col("term").isin([r.term for r in words.select("term").collect()]))
    postings = postings.join(F.broadcast(words), "term") if size.terms <= BROADCAST_ROWS else join_stats(postings, words, "term", "df", size.postings)
    of = lambda by, n, name: F.pmod(F.xxhash64(by), F.lit(n)).alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    left = _weighted(postings, index, scoring, floor).select(of("doc_id", chunks, "chunk"), each(slices, "slice"), "tid", "doc_id", "w")
    right = rows.join(words.select("term", F.col("tid").alias("word")), "term").select(each(chunks, "chunk"), of("no", slices, "slice"), "no", "word", "needed", "least", "open")
    return left.groupBy("chunk", "slice").cogroup(right.groupBy("chunk", "slice")).applyInPandas(_chunk_scores(mode, k), "no BIGINT, doc_id BIGINT, score DOUBLE")


def search_batch(queries: DataFrame, index: Index, mode: str = "or", scoring: str = "tfidf", k: int = 3, floor: bool = True, df_source: str = "df") -> DataFrame:
    """(qid, text) -> (qid, rank, doc_id, score): the k best documents of every query in one job.

    'or' takes documents with any query term, 'and' those with all terms that
    the index has; unknown terms are passed over and repeated ones count once.
    Scores are rounded to six places before they are ordered; ties go to the
    smaller doc_id.  Queries without a known term have no row.

    Queries of the same terms are scored once.  In mode 'or' with df and floor
    of the index, the lexicon's bounds tell which terms of a query are needed
    (see :func:`search_pruned`), unless one of its weights may be negative.
    """
    _mode(mode)
    if mode == "or" and df_source == "df" and floor == index.floor:
        terms = bound_prefixes(queries, index, scoring, k).withColumn("least", F.when(F.max("df").over(Window.partitionBy("qid")) <= index.n_docs, F.col("least")))
        terms = terms.withColumn("needed", F.coalesce(F.col("upto") >= F.col("least") - EPSILON, F.lit(True)))
    else:
        terms = query_lexicon(queries, index, df_source).select("*", F.lit(0.0).alias("ub"), F.lit(None).cast("double").alias("least"), F.lit(True).alias("needed"))
    asked = terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "df", "needed"))).alias("of"), F.coalesce(F.first("least"), F.lit(float("-inf"))).alias("least"), F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("ub"))).alias("open"))
    asked = cut(asked, "asked")
    sets = cut(asked.groupBy("of").agg(F.first("least").alias("least"), F.max("open").alias("open")).withColumn("no", F.monotonically_increasing_id()), "sets")
    best = _top(_batch_scores(sets, index, mode, scoring, k, floor).withColumnRenamed("no", "qid"), k).withColumnRenamed("qid", "no")
    return asked.select("qid", "of").join(sets.select("of", "no"), "of").select("qid", "no").join(best, "no").select("qid", "rank", "doc_id", "score")


def search(text: str, index: Index, mode: str = "or", scoring: str = "tfidf", k: int = 3, floor: bool = True, df_source: str = "df", pruned: bool = False) -> DataFrame:
    """(rank, doc_id, score) of one query as it was typed in; rows as in :func:`search_batch`.

    The query's few terms are looked up in the lexicon and pushed to the scan of
    the postings.  With ``pruned`` (mode 'or', df and floor of the index) the
    terms that cannot bring a document into the result on their own are left
    out at first (see :func:`search_pruned`); of their lists only the blocks
    are read that can hold a document which the others have brought in.
    """
    _mode(mode)
    spark = index.postings.sparkSession
    words = [r.term for r in query_terms(spark.createDataFrame([(0, text)], "qid INT, text STRING"), index, lines=False).collect()]
    found = index.lexicon.where(F.col("term").isin(words)).select("term", _source(df_source), F.col(f"ub_{scoring}").alias("ub"), F.col(f"reached_{scoring}").alias("reached")).collect()
    found = sorted(found, key=lambda r: (r.ub, r.term))

    def scored(rows: DataFrame) -> DataFrame:
        df = F.coalesce(*[F.when(F.col("term") == r.term, F.lit(r.df)) for r in found], F.lit(None).cast("bigint"))
        return _weighted(rows.select("term", "doc_id", "tf", "dl", df.alias("df")), index, scoring, floor)

    def lists(terms: list[str]) -> DataFrame:
        return index.postings.where(F.col("term").isin(terms))

    terms, rest, least = [r.term for r in found], [], 0.0
    if pruned and mode == "or" and df_source == "df" and floor == index.floor and (level := next((i for i, n in enumerate(LEVELS) if n >= k), None)) is not None:
        least = max((r.reached[level] for r in found), default=0.0) - EPSILON
        upto = 0.0
        for r in found:
            upto += r.ub
            if upto < least:
                rest.append(r)
    if not rest:
        scores = scored(lists(terms)).groupBy("doc_id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("n"))
        scores = scores.where(F.col("n") == len(terms)) if mode == "and" else scores
    else:
        open_ = sum(r.ub for r in rest)
        first = scored(lists(terms[len(rest) :])).groupBy("doc_id").agg(F.sum("w").alias("w"))
        first = cut(first.where(F.col("w") + open_ >= least), "survivors")
        more = scored(block_lists(first, index, [r.term for r in rest]).join(first.select("doc_id"), "doc_id", "left_semi"))
        scores = first.unionByName(more.select("doc_id", "w")).groupBy("doc_id").agg(F.sum("w").alias("score"))
    top = scores.where(F.col("score") > ADMITTED).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")  # k rows


def needed_blocks(documents: DataFrame, index: Index, terms: list[str]) -> DataFrame:
    """(term, block, first_doc_id, final_doc_id): the blocks of the terms' lists within which one of the documents lies.

    Documents and blocks meet in cells of CELL ids; a block is copied into the cells that it spans.
    """
    blocks = index.skips.where(F.col("term").isin(terms)).select("term", "block", "first_doc_id", "final_doc_id")
    blocks = blocks.withColumn("cell", F.explode(F.expr(f"sequence(first_doc_id div {CELL}, final_doc_id div {CELL})")))
    met = documents.select("doc_id", F.expr(f"doc_id div {CELL}").alias("cell")).join(blocks, "cell").where("doc_id BETWEEN first_doc_id AND final_doc_id")
    return met.select("term", "block", "first_doc_id", "final_doc_id").distinct()


def block_lists(documents: DataFrame, index: Index, terms: list[str]) -> DataFrame:
    """The postings of the terms in the blocks that any of ``documents`` needs: neighbouring blocks as ranges pushed to the scan while there are few, whole lists beyond that."""
    blocks = needed_blocks(documents, index, terms)
    run = F.col("block") - F.row_number().over(Window.partitionBy("term").orderBy("block"))
    runs = blocks.withColumn("run", run).groupBy("term", "run").agg(F.min("first_doc_id").alias("a"), F.max("final_doc_id").alias("b")).limit(PUSHED_RANGES + 1).collect()
    if len(runs) > PUSHED_RANGES:
        return index.postings.where(F.col("term").isin(terms))
    return index.postings.where(reduce(lambda x, y: x | y, [(F.col("term") == r.term) & F.col("doc_id").between(r.a, r.b) for r in runs], F.lit(False)))


def bound_prefixes(queries: DataFrame, index: Index, scoring: str = "tfidf", k: int = 3) -> DataFrame:
    """(qid, term, df, n_terms, ub, upto, least): each query's terms by ascending bound, with the sum of the bounds up to each.

    ``least`` is a score that the k-th best document reaches: the highest weight
    that k postings of one of the terms reach, null for k beyond the lexicon's levels.
    """
    w = Window.partitionBy("qid").orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = next((i for i, n in enumerate(LEVELS) if n >= k), len(LEVELS))
    terms = query_lexicon(queries, index, "df", f"ub_{scoring}", f"reached_{scoring}").withColumnRenamed(f"ub_{scoring}", "ub")
    return terms.select("qid", "term", "df", "n_terms", "ub", F.sum("ub").over(w).alias("upto"), F.max(F.get(f"reached_{scoring}", F.lit(level))).over(Window.partitionBy("qid")).alias("least"))


def search_pruned(queries: DataFrame, index: Index, scoring: str = "bm25", k: int = 3) -> DataFrame:
    """The same rows as :func:`search_batch` in mode 'or', scoring fewer postings.

    The lexicon gives each query a threshold that its result must reach and the
    bounds of its terms.  Terms whose bounds, summed from the lowest, stay
    below the threshold cannot bring a document into the result on their own:
    their postings are looked up only for documents that the other terms have
    brought in and that can still reach the threshold.
    """
    terms = bound_prefixes(queries, index, scoring, k).withColumn("needed", F.coalesce(F.col("upto") >= F.col("least") - EPSILON, F.lit(True)))
    terms = cut(terms.withColumn("open", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("ub"))).over(Window.partitionBy("qid")), F.lit(0.0))), "terms")
    first = _matches(terms.where("needed").select("qid", "term", "df", "least", "open"), index, scoring, index.floor)
    known = first.groupBy("qid", "doc_id").agg(F.sum("w").alias("w"), F.first("least").alias("least"), F.first("open").alias("open"))
    known = cut(known.where(F.coalesce(F.col("w") + F.col("open") >= F.col("least") - EPSILON, F.lit(True))).select("qid", "doc_id", "w", "open"), "survivors")
    rest = terms.where("NOT needed").select("qid", "term", "df")
    wanted = known.where("open > 0").select("qid", "doc_id").join(rest, "qid")
    listed = [r.term for r in rest.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings = index.postings.where(F.col("term").isin(listed)) if len(listed) <= PUSHED_TERMS else index.postings
    more = _weighted(postings.select("term", "doc_id", "tf", "dl").join(wanted, ["term", "doc_id"]), index, scoring, index.floor)
    return _top(known.select("qid", "doc_id", "w").unionByName(more.select("qid", "doc_id", "w")).groupBy("qid", "doc_id").agg(F.sum("w").alias("score")), k)


def batch_run(queries: DataFrame, index: Index, scoring: str = "tfidf") -> DataFrame:
    """(qid, iter, doc_id, rel): the best document of every query.

    A query that has no token after analysis, because it is blank text in every
    word or all its words are stop words, gets doc_id -1; one whose words the
    index doesn't have gets no row.
    """
    analysed = analyse(queries.select("qid", F.coalesce("text", F.lit("")).alias("text")), "text", index.stop, index.stemmed)
    empty = queries.select("qid").join(analysed.select("qid"), "qid", "left_anti").select("qid", F.lit(-1).cast("bigint").alias("doc_id"))
    best = search_batch(queries, index, "or", scoring, 1).select("qid", "doc_id")
    return best.unionByName(empty).select("qid", F.lit(0).alias("iter"), "doc_id", F.lit(1).alias("rel"))
