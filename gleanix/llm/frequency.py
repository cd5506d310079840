"""Problem 1: how often every term occurs and in how many records, kept up to date by signed deltas."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanix.session import cut, new_path
from gleanix.sources.tables import MOST_TASKS, n_documents, record_terms, table

COUNTS = "term STRING, cf BIGINT, df BIGINT"
CALLS = "add_id BIGINT, term STRING, doc_id BIGINT, gone BOOLEAN"
#: Calls, or terms, of a bucket of the first load, about.
BUCKET_ROWS = 1_000_000


def signed_deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of the touched records before and after a change -> (term, d_cf, d_df).

    An added record has rows only in ``after``, a deleted one only in
    ``before``, a changed one in both.  Records that did not change may be left
    out or given in both; they cancel.  Terms whose counts stay give no row.
    The sums are combined before the shuffle, so a term in every record costs
    one row a task.
    """
    signed = after.select("term", "tf", F.lit(1).alias("sign"))
    if before is not None:
        signed = signed.unionByName(before.select("term", "tf", F.lit(-1).alias("sign")))
    deltas = signed.groupBy("term").agg(F.sum(F.col("tf") * F.col("sign")).alias("d_cf"), F.sum(F.col("sign").cast("bigint")).alias("d_df"))
    return deltas.where("d_cf <> 0 OR d_df <> 0")


class CountStore:
    """Term counts, and the calls they come from, in a folder that outlives the job.

    ``v=<n>/bucket=<b>`` holds the counts of the terms of a bucket as of version
    n, ``calls/v=<n>/bucket=<b>`` the calls that came (or were withdrawn) with
    version n for the records of a bucket.  ``manifest-<n>.json`` says which of
    these make up the store.  :meth:`apply` adds a layer of calls, reads only
    the buckets of the records that it touches, and rewrites only the buckets of
    the terms whose counts change.  The number of buckets follows the first
    load.  The manifest is written last: a change that dies leaves the store as
    it was, and running it again overwrites its half-written version.  One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path, bucket_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.buckets, self._at = 0, buckets, {}
        self.record_buckets, self._layers, self._withdrawn = 0, {}, False
        if self._fs.exists(self._path(path)):
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
            self.version = max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)
            if self.version:
                kept = json.loads(self._read(f"manifest-{self.version}.json"))
                self.buckets, self._at = kept["buckets"], {int(b): v for b, v in kept["at"].items()}
                self.record_buckets, self._layers, self._withdrawn = kept["record_buckets"], {int(b): v for b, v in kept["layers"].items()}, kept["withdrawn"]

    def _read(self, name: str) -> str:
        return "".join(r.value for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(self._path(f"{self.path}/{name}.tmp"), self._path(f"{self.path}/{name}"))

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _folders(self, path: str) -> list[int]:
        return [int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("bucket=")]

    def calls(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """(add_id, term, doc_id) that hold, of the records of some buckets or of all, as of a version; a call may come more than once."""
        where = [(v, b) for b, vs in self._layers.items() if buckets is None or b in buckets for v in vs if before is None or v < before]
        if not where:
            return self.spark.createDataFrame([], CALLS).drop("gone")
        layers: dict[int, list[str]] = {}
        for v, b in where:
            layers.setdefault(v, []).append(f"{self.path}/calls/v={v}/bucket={b}")
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(CALLS).parquet(*paths).withColumn("v", F.lit(v)) for v, paths in layers.items()])
        if self._withdrawn:  # of a version that both adds and withdraws a call, the withdrawal holds
            rows = rows.groupBy("add_id", "term", "doc_id").agg(F.max(F.struct("v", "gone")).alias("last")).where("NOT last.gone")
        return rows.select("add_id", "term", "doc_id")

    def apply(self, calls: DataFrame) -> CountStore:
        """Take in a change: calls (add_id, term, doc_id), and where there is a column ``gone`` that is true, calls to withdraw.

        A record is added by its first call, changed by further ones, and
        deleted when all are withdrawn.  A call that the store has already, and
        withdrawing one that it has not, changes nothing.
        """
        new = self.version + 1
        gone = F.coalesce("gone", F.lit(False)) if "gone" in calls.columns else F.lit(False)
        rows = calls.where("term IS NOT NULL AND doc_id IS NOT NULL").select("add_id", F.expr("rtrim(' ', term)").alias("term"), "doc_id", gone.alias("gone"))
        if not self.record_buckets:
            self.record_buckets = max(16, -(-rows.count() // self.bucket_rows))
        at = f"{self.path}/calls/v={new}"
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.record_buckets)).cast("int").alias("bucket")
        # rebalancing splits a bucket that is much larger than others, which one record may make it
        rows.select("*", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        touched = self._folders(at)
        layers = self._layers
        known = sorted(set(touched) & set(layers))
        self._layers = {b: [v for v in layers.get(b, []) if v < new] + ([new] if b in touched else []) for b in sorted({*layers, *touched})}
        if touched and "gone" in calls.columns:
            self._withdrawn = self._withdrawn or not self.spark.read.schema(CALLS).parquet(at).where("gone").isEmpty()
        if not known:
            return self.merge(signed_deltas(None, record_terms(self.calls(touched))))
        records = cut(self.spark.read.schema(CALLS).parquet(at).select("doc_id").distinct(), "touched")
        of_them = lambda rows: record_terms(rows.join(records, "doc_id", "left_semi"))
        return self.merge(signed_deltas(of_them(self.calls(known, before=new)), of_them(self.calls(touched))))

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """(term, cf, df) as of the last merge; of the given buckets only, if any are given."""
        where = sorted(self._at if buckets is None else set(buckets) & set(self._at))
        if not where:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/v={self._at[b]}/bucket={b}" for b in where])

    def merge(self, deltas: DataFrame) -> CountStore:
        """Add (term, d_cf, d_df).  Terms that come down to no occurrence leave the store.

        Raises where a count would become negative: the deltas do not fit the store.
        """
        spark, new = self.spark, self.version + 1
        deltas = cut(deltas.select("term", "d_cf", "d_df"), "deltas")
        if not self.version:
            self.buckets = max(self.buckets, -(-deltas.count() // self.bucket_rows))
        deltas = deltas.withColumn("bucket", self._bucket())
        touched = [r.bucket for r in deltas.select("bucket").distinct().collect()]  # a number for each bucket
        if touched:
            old = self.counts(touched).select("term", F.col("cf").alias("d_cf"), F.col("df").alias("d_df"), self._bucket().alias("bucket"))
            sums = old.unionByName(deltas).groupBy("bucket", "term").agg(F.sum("d_cf").alias("cf"), F.sum("d_df").alias("df"))
            bad = F.raise_error(F.concat(F.lit("count below zero: "), F.coalesce("term", F.lit("null"))))
            sums = sums.withColumn("cf", F.when((F.col("cf") < 0) | (F.col("df") < 0), bad.cast("bigint")).otherwise(F.col("cf"))).where("cf <> 0 OR df <> 0")
            sums.repartition(min(len(touched), MOST_TASKS), "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={new}")
            there = set(self._folders(f"{self.path}/v={new}"))
            self._at = {b: v for b, v in self._at.items() if b not in touched} | {b: new for b in there}
        self._fs.mkdirs(self._path(self.path))
        self._write(f"manifest-{new}.json", json.dumps({"buckets": self.buckets, "at": self._at, "record_buckets": self.record_buckets, "layers": self._layers, "withdrawn": self._withdrawn}))
        self.version = new
        return self


def marked(counts: DataFrame, n_docs: int, rare_df: int = 2, common_share: float = 0.3) -> DataFrame:
    """Adds ``mark``: 'rare' (df <= rare_df), else 'common' (df > common_share * n_docs), else null."""
    return counts.withColumn("mark", F.when(F.col("df") <= rare_df, "rare").when(F.col("df") > F.lit(common_share) * F.lit(float(n_docs)), "common"))


def count_in_two_loads(calls: DataFrame, path: str, first_share: float = 0.9) -> CountStore:
    """Counts of all calls, from a first load and the signed deltas of what came after.

    The first load is what was logged within the first ``first_share`` of the
    time span (and calls without a time); the rest arrives as a change.  It adds
    records, and it changes records of which calls came late.
    """
    spark = calls.sparkSession
    span = calls.agg(F.min(F.unix_micros("logged_at")).alias("lo"), F.max(F.unix_micros("logged_at")).alias("hi")).first()
    until = span.lo + int((span.hi - span.lo) * first_share) if span.lo is not None else 0
    late = F.coalesce(F.unix_micros("logged_at") > F.lit(until), F.lit(False))
    return CountStore(spark, path).apply(calls.where(~late).drop("gone")).apply(calls.where(late).drop("gone"))


def term_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """(term, cf, df, mark) of every term of ``term_stream``.

    Null terms and null doc_ids are no occurrences, the blank term is a term.
    An empty stream gives no rows.
    """
    calls = table(spark, data_dir, "term_stream").select("add_id", "term", "doc_id", "logged_at")
    store = count_in_two_loads(calls, new_path(spark, "counts"))
    return marked(store.counts(), n_documents(table(spark, data_dir, "doc_table")))


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    return term_counts(spark, data_dir).where("mark IS NOT NULL").select("term", "mark")


def block_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per block and term the counts of the calls beside those of the block's lexicon line.

    A line written twice keeps its larger counts; a null count stays null.
    ``late_cf`` is what came after the flush (null where the line has no count).
    """
    calls = table(spark, data_dir, "term_stream").where("term IS NOT NULL AND doc_id IS NOT NULL AND block_no IS NOT NULL")
    each = calls.select("block_no", "add_id", F.expr("rtrim(' ', term)").alias("term"), "doc_id").distinct()
    counted = each.groupBy("block_no", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("block_no", "term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    lines = table(spark, data_dir, "lexicon_line").groupBy("block_no", F.expr("rtrim(' ', term)").alias("term")).agg(F.max("cf").cast("bigint").alias("line_cf"), F.max("df").cast("bigint").alias("line_df"))
    return counted.join(lines, ["block_no", "term"], "full").select("block_no", "term", F.coalesce("cf", F.lit(0)).alias("cf"), F.coalesce("df", F.lit(0)).alias("df"), "line_cf", "line_df", (F.coalesce("cf", F.lit(0)) - F.col("line_cf")).alias("late_cf"))


_OCC = "occ AS (SELECT DISTINCT add_id, rtrim(term, ' ') AS term, doc_id FROM term_stream WHERE term IS NOT NULL AND doc_id IS NOT NULL)"
_COUNTS = f"""WITH {_OCC}, c AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM occ GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_table)
SELECT term, cf, df, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.3::DOUBLE * n THEN 'common' END AS mark FROM c, n"""

QUERIES = {"p1_found": found, "p1_term_counts": term_counts, "p1_block_counts": block_counts}
SQL = {
    "p1_found": f"SELECT term, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p1_term_counts": _COUNTS,
    "p1_block_counts": """WITH e AS (SELECT DISTINCT block_no, add_id, rtrim(term, ' ') AS term, doc_id FROM term_stream WHERE term IS NOT NULL AND doc_id IS NOT NULL AND block_no IS NOT NULL),
c AS (SELECT block_no, term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM e GROUP BY 1, 2),
l AS (SELECT block_no, rtrim(term, ' ') AS term, max(cf)::BIGINT AS line_cf, max(df)::BIGINT AS line_df FROM lexicon_line GROUP BY 1, 2)
SELECT coalesce(c.block_no, l.block_no) AS block_no, coalesce(c.term, l.term) AS term, coalesce(cf, 0) AS cf, coalesce(df, 0) AS df, line_cf, line_df, coalesce(cf, 0) - line_cf AS late_cf
FROM c FULL JOIN l ON c.block_no = l.block_no AND c.term = l.term""",
}
