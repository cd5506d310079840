import hashlib
from datetime import datetime

import pytest

from gleanix.sources import tables as S


def test_collection_tsv(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("0\tsome text\tmore\n1\t\n2\nx\tno id\n3\tcafé \"quoted\"\n", encoding="utf-8")
    got = sorted((r.doc_id, r.text) for r in S.read_collection_tsv(spark, str(tmp_path / "c.tsv")).collect())
    assert got == [(0, "some text"), (1, ""), (2, ""), (3, 'café "quoted"')]


def test_queries_tsv_keeps_the_last(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("7\tfirst\n8\tother\n7\tsecond\n9\n")
    assert {r.qid: r.text for r in S.read_queries_tsv(spark, str(tmp_path / "q.tsv")).collect()} == {7: "second", 8: "other", 9: ""}


def test_last_query_may_be_null(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, None)], "line_no BIGINT, qid INT, text STRING")
    assert S.last_query(rows).collect() == [(5, "")]


def test_run_file(spark, tmp_path):
    S.write_run(spark.createDataFrame([(1, 0, 42, 1)], "qid INT, iter INT, doc_id BIGINT, rel INT").coalesce(1), str(tmp_path / "run"))
    assert "".join(p.read_text() for p in (tmp_path / "run").glob("*.csv")) == "1\t0\t42\t1\n"


def test_latest_records(spark):
    rows = spark.createDataFrame([(1, "old", datetime(2031, 1, 1)), (1, "new", datetime(2031, 1, 2)), (2, None, None), (None, "x", None)], "doc_id BIGINT, doc_in STRING, read_at TIMESTAMP")
    assert sorted(S.latest_records(rows, "doc_in").collect()) == [(1, "new"), (2, None)]
    tied = spark.createDataFrame([(1, t, datetime(2031, 1, 1)) for t in "abc"], rows.schema)
    assert S.latest_records(tied, "doc_in").first().doc_in == max("abc", key=lambda t: hashlib.sha256(t.encode()).hexdigest())


def test_collection_tsv_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\tb\r\nc"), (2, ""), (-3, "plain")], "doc_id BIGINT, text STRING")
    S.write_collection_tsv(docs, str(tmp_path / "c"))
    assert sorted(S.read_collection_tsv(spark, str(tmp_path / "c")).collect()) == [(-3, "plain"), (1, "a b c"), (2, "")]


def test_occurrences_and_documents(spark):
    calls = spark.createDataFrame([(1, "a ", 1, "x"), (1, "a", 1, "y"), (2, None, 1, "x"), (3, "a", None, "x"), (4, "", 1, "x")], "add_id BIGINT, term STRING, doc_id BIGINT, tf STRING")
    assert sorted(S.record_terms(calls).select("doc_id", "term", "tf").collect()) == [(1, "", 1), (1, "a", 1)]
    assert S.n_documents(spark.createDataFrame([(1, 3), (1, 3), (2, None), (None, 1)], "doc_id BIGINT, dl INT")) == 2


def test_scratch_needs_a_shared_folder():
    from gleanix.session import scratch_dir

    class Fake:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            applicationId, master = "none-such", "yarn"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError):
        scratch_dir(Fake)
