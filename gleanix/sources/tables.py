"""Readers of the collection's tables, and the text formats of collections, queries and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanix.session import cut, width

COLLECTION_SCHEMA = "doc_id BIGINT, text STRING"
QUERIES_SCHEMA = "qid INT, text STRING"
RUN_COLUMNS = ["qid", "iter", "doc_id", "rel"]
#: Calls of a chunk, the part of a stream that one step combines locally, about.
CHUNK_ROWS = 250_000
#: Tasks that chunks are dealt to, at most.
MOST_TASKS = 10_000


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def read_collection_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``doc_id <tab> text``; further columns are ignored, a missing second one is an empty text.

    Lines without a numeric id are dropped.
    """
    parts = F.split("value", "\t")
    return (
        spark.read.text(path)
        .select(F.expr("try_cast(split(value, '\\t')[0] AS BIGINT)").alias("doc_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))
        .where("doc_id IS NOT NULL")
    )


def read_queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``qid <tab> text``.  File order decides which of a repeated qid is the last, so the line number is kept.

    One text file is read per call and the order is that of its lines.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    return last_query(lines.select("line_no", F.expr("try_cast(split(value, '\\t')[0] AS INT)").alias("qid"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text")).where("qid IS NOT NULL"))


def last_query(queries: DataFrame) -> DataFrame:
    """(line_no, qid, text) -> (qid, text): a repeated qid keeps the text of its highest line; a null text is empty."""
    return queries.groupBy("qid").agg(F.max_by(F.struct("text"), "line_no").alias("q")).select("qid", F.coalesce("q.text", F.lit("")).alias("text"))


def write_collection_tsv(documents: DataFrame, path: str) -> None:
    """(doc_id, text) as lines ``doc_id <tab> text``; what would break a line is a blank there."""
    documents.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\r\n\t]+", " ")).alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid INT, iter INT, doc_id BIGINT, rel INT").csv(path, sep="\t")


def write_run(run: DataFrame, path: str) -> None:
    """Tab-separated ``qid iter doc_id rel``, no header."""
    run.select(*RUN_COLUMNS).write.mode("overwrite").csv(path, sep="\t", header=False)


def latest_records(collection: DataFrame, *columns: str, tie: Column | None = None) -> DataFrame:
    """One row per doc_id: that of the latest ``read_at``; of equal times that whose ``doc_in`` has the larger SHA-256.

    A null time is the earliest.  Only ``doc_id``, the hash and the named
    columns are shuffled, into a number of parts that stays, because what
    follows is usually work on each text.  ``tie`` replaces the hash where the
    table no longer has ``doc_in``.  Rows with a null id are dropped.
    """
    rows = collection.where("doc_id IS NOT NULL").select("doc_id", "read_at", (F.sha2("doc_in", 256) if tie is None else tie).alias("tie"), *columns)
    return rows.repartition(width(rows), "doc_id").groupBy("doc_id").agg(F.max(F.struct("read_at", "tie", *columns)).alias("r")).select("doc_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def record_terms(term_stream: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, doc_id, term, tf) of the calls; tf is a bigint.

    A call logged more than once counts once; rows without term or doc_id are
    no occurrences; terms lose their trailing blanks.  Calls are exchanged once,
    into chunks of about ``chunk_rows`` by a hash of the record; finding calls
    logged again and counting tf is then local, as is every aggregation by chunk
    and other columns.  Records that fill more than a chunk on their own (and
    1/4096 of all calls) are taken out: their calls are spread by all columns,
    and the few pairs that are left of them are dealt to the chunks by term.
    """
    calls = term_stream.where("term IS NOT NULL AND doc_id IS NOT NULL").select("add_id", F.expr("rtrim(' ', term)").alias("term"), "doc_id")
    sizes = cut(term_stream.where("term IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-total // chunk_rows))
    hot = sizes.where(F.col("n") > max(chunk_rows, total // 4096)).select("doc_id")
    chunk = lambda *by: F.pmod(F.xxhash64(*by), F.lit(chunks)).alias("chunk")
    some = not hot.isEmpty()
    cold = calls.join(F.broadcast(hot), "doc_id", "left_anti") if some else calls
    cold = cold.select(chunk("doc_id"), "add_id", "term", "doc_id").repartition(min(chunks, MOST_TASKS), "chunk").distinct()
    pairs = cold.groupBy("chunk", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    if not some:
        return pairs
    large = calls.join(F.broadcast(hot), "doc_id").distinct().groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return pairs.unionByName(large.select(chunk("doc_id", "term"), "doc_id", "term", "tf"))


def n_documents(doc_table: DataFrame) -> int:
    """Distinct documents of the document table, which has lines written twice."""
    return doc_table.agg(F.countDistinct("doc_id")).first()[0]
