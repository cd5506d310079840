"""The inverted index as plain tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanix.functions.codec import decode_gaps, decode_tfs, encode_gaps, encode_tfs, gamma_size, unary_size
from gleanix.functions.scoring import bm25_weight, idf, tfidf_weight
from gleanix.functions.text import analyse
from gleanix.session import cut

#: Most entries of a stop word list.
MOST_STOP_WORDS = 100_000
#: Numbers of postings for which the lexicon keeps a weight that so many reach.
LEVELS = (1, 3, 10, 30, 100)


def stop_list(words: DataFrame) -> list[str]:
    """The words of a one-column table, as a list for the analyser."""
    rows = words.where(F.col(words.columns[0]).isNotNull()).distinct().limit(MOST_STOP_WORDS + 1).collect()
    if len(rows) > MOST_STOP_WORDS:
        raise ValueError("a stop word list has at most 100000 entries")
    return sorted(r[0] for r in rows)


def document_table(analysed: DataFrame) -> DataFrame:
    """(doc_id, tokens) -> (doc_id, dl)."""
    return analysed.select("doc_id", F.size("tokens").alias("dl"))


def corpus_stats(documents: DataFrame, lengths: DataFrame, floor: bool = True) -> DataFrame:
    """One row (n_docs, avgdl): all documents of the collection, and the mean length of those in the document table.

    ``floor`` truncates the mean to a whole number.
    """
    mean = F.sum(F.col("dl").cast("bigint")) / F.nullif(F.count(F.lit(1)), F.lit(0).cast("bigint"))
    return lengths.agg((F.floor(mean) if floor else mean).cast("double").alias("avgdl")).select(F.lit(documents.count()).cast("bigint").alias("n_docs"), "avgdl")


def postings(analysed: DataFrame) -> DataFrame:
    """(doc_id, tokens) -> (term, doc_id, tf, dl), one row per term and document.

    ``doc_id`` must be unique.  Occurrences are added up before the shuffle.
    """
    rows = analysed.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", "doc_id", "tf", "dl")


def block_size(df: str = "df"):
    return F.ceil(F.sqrt(F.col(df)))


def lexicon(rows: DataFrame, n_docs: int | None = None, avgdl: float | None = None, floor: bool = True) -> DataFrame:
    """postings -> (term, cf, df, n_block), and with ``n_docs`` and ``avgdl`` also the upper bounds ub_tfidf and ub_bm25.

    A bound is the highest weight of a posting and at least 0.  Both come from
    one aggregation: for a fixed df the TF-IDF weight grows with tf and the BM25
    weight with tf / (norm + tf), so their maxima are kept and weighted last.
    """
    counts = [F.sum(F.col("tf").cast("bigint")).alias("cf"), F.count(F.lit(1)).alias("df")]
    blocks = F.ceil(F.col("df") / block_size()).cast("int").alias("n_block")
    if n_docs is None:
        return rows.groupBy("term").agg(*counts).select("term", "cf", "df", blocks)
    table = rows.groupBy("term").agg(*counts, F.max("tf").alias("tf"), F.max(_saturation(avgdl)).alias("part"))
    return table.select("term", "cf", "df", blocks, F.greatest(F.lit(0.0), tfidf_weight(n_docs, floor)).alias("ub_tfidf"), F.greatest(F.lit(0.0), F.col("part") * F.ln(F.lit(float(n_docs)) / F.col("df"))).alias("ub_bm25"))


def _saturation(avgdl: float | None) -> Column:
    return F.col("tf") / (F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("dl") / F.lit(avgdl).cast("double")) + F.col("tf"))


def reached_weights(rows: DataFrame, n_docs: int, avgdl: float | None, floor: bool = True) -> DataFrame:
    """postings -> (term, reached_tfidf, reached_bm25): weights that at least LEVELS[i] of the term's postings reach, 0 where it has fewer.

    The k-th best document of a query scores at least what k postings of one of
    its terms reach, so a threshold is known before any posting is read.
    Postings are counted in steps of tf (whole numbers to 64, then powers of
    two) and of 1/256 of the BM25 saturation, so a term has a few hundred
    counts at most, made before the shuffle.
    """
    tf = F.when(F.col("tf") <= 64, F.col("tf")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("tf")))).cast("double")
    part = F.floor(_saturation(avgdl) * 256) / 256
    steps = rows.select("term", F.posexplode(F.array(tf, part)).alias("kind", "step")).groupBy("term", "kind", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("term", "kind").orderBy(F.desc("step"))))
    best = [F.max(F.when((F.col("kind") == kind) & (F.col("upto") >= k), F.col("step"))).alias(f"s{kind}_{k}") for kind in (0, 1) for k in LEVELS]
    wide = upto.groupBy("term").agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("df"), *best)
    zero = lambda w: F.coalesce(F.greatest(F.lit(0.0), w), F.lit(0.0))
    tfidf = F.array(*[zero((1 + F.ln(f"s0_{k}")) * idf(n_docs, floor)) for k in LEVELS])
    bm25 = F.array(*[zero(F.col(f"s1_{k}") * idf(n_docs, False)) for k in LEVELS])
    return wide.select("term", tfidf.alias("reached_tfidf"), bm25.alias("reached_bm25"))


def weighted(rows: DataFrame, n_docs: int, avgdl: float | None, floor: bool = True) -> DataFrame:
    """postings with df -> both weights of every posting."""
    rows = rows.withColumn("avgdl", F.lit(avgdl).cast("double"))
    return rows.withColumn("w_tfidf", tfidf_weight(n_docs, floor)).withColumn("w_bm25", bm25_weight(n_docs))


def with_blocks(rows: DataFrame, width: int = 1_000_000) -> DataFrame:
    """postings -> (term, doc_id, tf, dl, block, gap): blocks of ceil(sqrt(df)) postings and document gaps.

    The first gap of a block is the number itself; numbers are doc_id + 1,
    because codes start at 1.  A list is put in order in parts of ``width``
    consecutive ids: the place of a posting is its place in its part and the
    postings in the parts before it, so that the list of a term in every
    document is spread over many tasks.  ``rows`` is read twice and should be a
    written table.
    """
    rows = rows.select("term", "doc_id", "tf", "dl").withColumn("part", F.floor(F.col("doc_id") / width))
    ahead = Window.partitionBy("term").orderBy("part")
    parts = rows.groupBy("term", "part").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    parts = parts.select("term", "part", F.sum("n").over(Window.partitionBy("term")).alias("df"), (F.sum("n").over(ahead) - F.col("n")).alias("ahead"), F.lag("last").over(ahead).alias("last"))
    inner = Window.partitionBy("term", "part").orderBy("doc_id")
    placed = rows.join(parts, ["term", "part"]).withColumn("place", F.row_number().over(inner) + F.col("ahead") - 1).withColumn("before", F.coalesce(F.lag("doc_id").over(inner), "last"))
    starts = F.col("place") % block_size() == 0
    return placed.select("term", "doc_id", "tf", "dl", F.floor(F.col("place") / block_size()).cast("int").alias("block"), F.when(starts, F.col("doc_id") + 1).otherwise(F.col("doc_id") - F.col("before")).alias("gap"))


def from_gaps(blocks: DataFrame) -> DataFrame:
    """(term, block, doc_id order, gap) -> the document ids again, as a running sum of the gaps of each block."""
    run = Window.partitionBy("term", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.select("term", "block", "doc_id", (F.sum("gap").over(run) - 1).alias("decoded"))


def skip_blocks(blocks: DataFrame) -> DataFrame:
    """(term, block, first_doc_id, final_doc_id, n_postings, len_doc_bytes, len_tf_bytes)."""
    return blocks.groupBy("term", "block").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("final_doc_id"), F.count(F.lit(1)).cast("int").alias("n_postings"), F.sum(gamma_size("gap")).alias("len_doc_bytes"), F.sum(unary_size("tf")).alias("len_tf_bytes"))


def file_offsets(skips: DataFrame) -> DataFrame:
    """Adds offset_doc and offset_tf: where each block starts if all are laid end to end in order of (term, block).

    Bytes are summed by the first three letters, then by term, then by block;
    a running sum passes through each level, so only the few thousand sums of
    the first level pass through one task.
    """

    def running(table: DataFrame, group: list[str], order: str, add: list[str]) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return table.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{order}") for c in add])

    rows = skips.withColumn("head", F.substring("term", 1, 3)).withColumn("d", F.col("len_doc_bytes")).withColumn("t", F.col("len_tf_bytes"))
    terms = rows.groupBy("head", "term").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    heads = running(terms.groupBy("head").agg(F.sum("d").alias("d"), F.sum("t").alias("t")), [], "head", ["d", "t"]).drop("d", "t")
    base = running(terms, ["head"], "term", ["d", "t"]).drop("d", "t").join(heads, "head").drop("head")
    rows = running(rows, ["term"], "block", ["d", "t"]).join(base, "term")
    total = lambda c: F.col(f"{c}_head") + F.col(f"{c}_term") + F.col(f"{c}_block")
    return rows.select(*skips.columns, total("d").alias("offset_doc"), total("t").alias("offset_tf"))


def index_size(skips: DataFrame) -> DataFrame:
    """One row: bytes of ids and frequencies before and after compression."""
    return skips.agg(F.sum(F.col("n_postings").cast("bigint") * 8).alias("doc_bytes_raw"), F.sum("len_doc_bytes").alias("doc_bytes"), F.sum(F.col("n_postings").cast("bigint") * 4).alias("tf_bytes_raw"), F.sum("len_tf_bytes").alias("tf_bytes"))


def encode_blocks(blocks: DataFrame) -> DataFrame:
    """(term, block, doc_codes, tf_codes): the coded bytes of every block, which holds at most ceil(sqrt(df)) postings."""
    listed = blocks.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "gap", "tf"))).alias("p"))
    return listed.select("term", "block", encode_gaps(F.col("p.gap")).alias("doc_codes"), encode_tfs(F.col("p.tf")).alias("tf_codes"))


def decode_blocks(coded: DataFrame) -> DataFrame:
    """(term, block, doc_codes, tf_codes) -> (term, block, doc_id, tf)."""
    lists = coded.select("term", "block", decode_gaps("doc_codes").alias("gaps"), decode_tfs("tf_codes").alias("tfs"))
    run = lists.select("term", "block", "tfs", F.posexplode("gaps").alias("i", "gap"))
    order = Window.partitionBy("term", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return run.select("term", "block", (F.sum("gap").over(order) - 1).alias("doc_id"), F.get("tfs", F.col("i")).cast("int").alias("tf"))


@dataclass
class Index:
    """The tables of an index and what its scores need."""

    postings: DataFrame
    lexicon: DataFrame
    documents: DataFrame
    skips: DataFrame
    coded: DataFrame
    n_docs: int
    avgdl: float | None
    stop: list[str] | None
    stemmed: bool
    floor: bool


def build_index(documents: DataFrame, path: str, stop: Iterable[str] | None = None, stemmed: bool = False, partitions: int | None = None, n_docs: int | None = None, floor: bool = True) -> Index:
    """(doc_id, text) -> an index written under ``path/variant=stem|raw``.

    Tables: doc_table, postings (with the block of each), lexicon (with score
    bounds), skip_blocks, coded_blocks (the blocks' ids and frequencies as byte
    codes) and corpus_stats.  All but the first are range-partitioned and sorted
    by term, then document or block, so a lookup of some terms reads only the
    row groups that can hold them.  ``n_docs`` overrides the number of documents
    in the scores, ``floor=False`` keeps the fractions of the mean length and of
    N / df.  Raises if a doc_id occurs twice.
    """
    spark = documents.sparkSession
    twice = documents.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).collect()
    if twice:
        raise ValueError(f"doc_id must be unique and not null: {twice[0].doc_id}")
    stop = None if stop is None else sorted(set(stop))
    where = f"{path}/variant={'stem' if stemmed else 'raw'}"

    def write(rows: DataFrame, name: str, *order: str) -> DataFrame:
        if order:
            rows = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
        rows.write.mode("overwrite").parquet(f"{where}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{where}/{name}")

    tokens = cut(analyse(documents, "text", stop, stemmed), "tokens")
    lengths = write(document_table(tokens), "doc_table")
    rows = write(cut(with_blocks(cut(postings(tokens), "postings")), "blocks"), "postings", "term", "doc_id")
    stats = corpus_stats(documents, lengths, floor)
    if n_docs is not None:
        stats = stats.withColumn("n_docs", F.lit(n_docs).cast("bigint"))
    row = write(stats.select("*", F.lit(stop).cast("array<string>").alias("stop"), F.lit(stemmed).alias("stemmed"), F.lit(floor).alias("floor")), "corpus_stats").first()
    write(cut(lexicon(rows, row.n_docs, row.avgdl, floor).join(reached_weights(rows, row.n_docs, row.avgdl, floor), "term"), "lexicon"), "lexicon", "term")
    write(cut(skip_blocks(rows), "skips"), "skip_blocks", "term", "block")
    write(cut(encode_blocks(rows), "coded"), "coded_blocks", "term", "block")
    return load_index(spark, path, stemmed)


def load_index(spark: SparkSession, path: str, stemmed: bool = False) -> Index:
    where = f"{path}/variant={'stem' if stemmed else 'raw'}"
    row = spark.read.parquet(f"{where}/corpus_stats").first()
    tables = [spark.read.parquet(f"{where}/{name}") for name in ("postings", "lexicon", "doc_table", "skip_blocks", "coded_blocks")]
    return Index(*tables, row.n_docs, row.avgdl, row.stop, row.stemmed, row.floor)
