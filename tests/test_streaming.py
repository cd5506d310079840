from gleanix.functions.text import analyse
from gleanix.operators.index import postings
from gleanix.streaming.ingest import postings_stream


def test_stream_equals_batch(spark, tmp_path):
    first = spark.createDataFrame([(1, "solar farms"), (2, None)], "doc_id BIGINT, text STRING")
    second = spark.createDataFrame([(3, "solar solar wind"), (4, "")], "doc_id BIGINT, text STRING")
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in (first, second):
        part.write.mode("append").parquet(source)
        postings_stream(spark.readStream.schema(part.schema).parquet(source), out, kept).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    assert sorted(got.collect()) == sorted(postings(analyse(first.union(second))).collect())
