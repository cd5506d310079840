"""Problem 4: records that differ only in how they are written down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleanix.functions.text import once
from gleanix.llm.bloom import MOST, n_slices, possibly_repeated, repeat_filter
from gleanix.llm.texts import bag
from gleanix.operators.skew import join_stats
from gleanix.plans.oracle import LATEST
from gleanix.session import cut, new_path, spread
from gleanix.sources.tables import latest_records, table


def forms(collection: DataFrame) -> DataFrame:
    """(doc_id, digest, h): the SHA-256 of each record's canonical form and a 64-bit hash of that.

    The canonical form is the sorted list of the words, so white space, case,
    punctuation and order do not matter.  A doc_id read several times counts
    once, with its latest text that is not null; if that has no word, the record
    has no row.  Only ids and hashes are shuffled.
    """
    rows = spread(collection.where("doc_in IS NOT NULL").select("doc_id", "read_at", "doc_in")).select("doc_id", "read_at", F.unhex(F.sha2("doc_in", 256)).alias("tie"), once(bag("doc_in")).alias("form"))
    rows = rows.select("doc_id", "read_at", "tie", F.when(F.col("form") != "", F.unhex(F.sha2("form", 256))).alias("digest"))
    return latest_records(rows, "digest", tie=F.col("tie")).where("digest IS NOT NULL").withColumn("h", F.xxhash64("digest"))


def split_by_filter(records: DataFrame, most_bits: int = MOST) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of (records whose hash may be repeated, records that are certainly single).  ``records`` must be a written table.

    One pair for every slice of the hashes: where one filter of ``2**most_bits``
    bits would be too full, records are put down by slices of their hash (each
    task writes its own, nothing is shuffled), and every slice has a filter of
    its own, so that the share of single records that pass is the same at every size.
    """
    n = records.count()
    slices = n_slices(n, most=most_bits)
    if slices == 1:
        parts = [records]
    else:
        path = new_path(records.sparkSession, "slices")
        records.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("int")).write.partitionBy("slice").parquet(path)
        sliced = records.sparkSession.read.schema(StructType([*records.schema.fields, StructField("slice", IntegerType())])).parquet(path)
        parts = [sliced.where(F.col("slice") == i).drop("slice") for i in range(slices)]
    out = []
    for part in parts:
        maybe = possibly_repeated(part, "h", *repeat_filter(part.select("h"), -(-n // slices), most_bits))
        out.append((part.where(maybe), part.where(~maybe)))
    return out


def group_copies(records: DataFrame, most_bits: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(groups, copies) of (doc_id, digest, h).

    groups: one row per canonical form, (doc_id, digest, copies), doc_id being
    the smallest.  copies: (doc_id_a, doc_id_b), one row for every record that
    has a smaller one in its group.  Only records that the Bloom filters let
    pass are shuffled, and partial counts are made before that, so a form that
    a third of all records share costs one row a task.
    """
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    split = split_by_filter(records, most_bits)
    maybe = union([cut(m.select("doc_id", "digest"), "maybe") for m, _ in split])
    single = union([s for _, s in split])
    counted = cut(maybe.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "groups")
    groups = counted.select(F.col("first_id").alias("doc_id"), "digest", "copies").unionByName(single.select("doc_id", "digest", F.lit(1).cast("bigint").alias("copies")))
    repeated = counted.where("copies > 1")
    total = repeated.agg(F.sum("copies")).first()[0] or 0
    copies = join_stats(maybe, repeated, "digest", "copies", total).where("doc_id <> first_id").select(F.col("first_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
    return groups, copies


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    return group_copies(cut(forms(table(spark, data_dir, "collection_tsv")), "forms"))[1]


def copy_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per distinct record: its smallest doc_id and the number of copies."""
    return group_copies(cut(forms(table(spark, data_dir, "collection_tsv")), "forms"))[0].select("doc_id", "copies")


_FORMS = f"""WITH r AS (SELECT doc_id, arg_max(doc_in, {LATEST}) AS doc_in FROM collection_tsv WHERE doc_in IS NOT NULL GROUP BY doc_id),
f AS (SELECT doc_id, array_to_string(list_sort(regexp_extract_all(lower(doc_in), '[\\p{{L}}\\p{{N}}]+')), ' ') AS form FROM r),
g AS (SELECT form, min(doc_id) AS doc_id, count(*) AS copies FROM f WHERE form <> '' GROUP BY form)"""

QUERIES = {"p4_found": found, "p4_copy_counts": copy_counts}
SQL = {
    "p4_found": f"{_FORMS} SELECT g.doc_id AS doc_id_a, f.doc_id AS doc_id_b FROM f JOIN g ON f.form = g.form WHERE f.doc_id <> g.doc_id",
    "p4_copy_counts": f"{_FORMS} SELECT doc_id, copies FROM g",
}
