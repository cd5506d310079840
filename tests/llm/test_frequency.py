from collections import Counter
from datetime import datetime, timedelta

import pytest

from gleanix.llm import frequency as P

T0 = datetime(2031, 1, 1)


def _deltas(spark, rows):
    return spark.createDataFrame(rows, "term STRING, d_cf BIGINT, d_df BIGINT")


def test_signed_deltas_of_added_changed_and_deleted_records(spark):
    before = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (9, "same", 4)], "doc_id BIGINT, term STRING, tf BIGINT")
    after = spark.createDataFrame([(1, "a", 5), (1, "c", 1), (3, "a", 1), (9, "same", 4)], "doc_id BIGINT, term STRING, tf BIGINT")
    got = {r.term: (r.d_cf, r.d_df) for r in P.signed_deltas(before, after).collect()}
    assert got == {"a": (3, 0), "b": (-1, -1), "c": (1, 1)}


def test_store_merges_and_reopens(spark, tmp_path):
    path = str(tmp_path / "store")
    store = P.CountStore(spark, path, buckets=4).merge(_deltas(spark, [("a", 3, 2), ("b", 1, 1), ("", 2, 1)]))
    store.merge(_deltas(spark, [("a", -1, -1), ("b", -1, -1), ("c", 5, 5)]))
    again = P.CountStore(spark, path)
    assert (again.version, again.buckets) == (2, 4)
    assert {r.term: (r.cf, r.df) for r in again.counts().collect()} == {"a": (2, 1), "c": (5, 5), "": (2, 1)}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "store")
    store = P.CountStore(spark, path, buckets=16).merge(_deltas(spark, [(f"t{i}", 1, 1) for i in range(200)]))
    store.merge(_deltas(spark, [("t1", 1, 1)]))
    assert sorted(store._at.values()) == [1] * 15 + [2]
    store.merge(_deltas(spark, []))
    assert store.counts().count() == 200


def test_negative_counts_are_refused_and_change_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    store = P.CountStore(spark, path, buckets=2).merge(_deltas(spark, [("a", 1, 1)]))
    with pytest.raises(Exception, match="below zero"):
        store.merge(_deltas(spark, [("a", -2, -1)]))
    assert P.CountStore(spark, path).counts().collect() == [("a", 1, 1)]


def test_an_unfinished_merge_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "store")
    store = P.CountStore(spark, path, buckets=2).merge(_deltas(spark, [("a", 1, 1)]))
    spark.createDataFrame([("junk", 7, 7)], P.COUNTS).write.parquet(f"{path}/v=2/bucket=0")  # a merge that died before its manifest
    assert P.CountStore(spark, path).counts().collect() == [("a", 1, 1)]
    store.merge(_deltas(spark, [("a", 1, 1)]))
    assert P.CountStore(spark, path).counts().collect() == [("a", 2, 2)]


def _calls(spark, rows):
    return spark.createDataFrame(rows, "add_id BIGINT, term STRING, doc_id BIGINT, gone BOOLEAN")


def test_records_are_added_changed_and_deleted(spark, tmp_path):
    """Also in a store that is opened again, with calls that are known, withdrawn twice or never made."""
    path = str(tmp_path / "store")
    store = P.CountStore(spark, path, bucket_rows=10)
    first = [(i, f"t{i % 9}", i // 4, False) for i in range(400)]
    store.apply(_calls(spark, first))
    change = [(0, "t0", 0, True), (1, "t1", 0, True), (2, "t2", 0, True), (3, "t3", 0, True), (4, "t4", 1, True), (900, "new", 2, False), (901, "new ", 500, False), (8, "t8", 2, False), (777, "never", 3, True), (None, None, 1, None)]
    P.CountStore(spark, path).apply(_calls(spark, change))
    again = P.CountStore(spark, path).apply(_calls(spark, [(0, "t0", 0, True), (4, "t4", 1, None)]))
    held = {(a, t, d) for a, t, d, _ in first} - {(a, t, d) for a, t, d, _ in change[:4]} | {(900, "new", 2), (901, "new", 500)}
    cf, df = Counter(t for _, t, _ in held), Counter(t for t, _ in {(t, d) for _, t, d in held})
    assert {r.term: (r.cf, r.df) for r in P.CountStore(spark, path).counts().collect()} == {t: (cf[t], df[t]) for t in cf}
    assert again.record_buckets == 40 and again.version == 3


def test_a_small_change_reads_few_calls(spark, tmp_path):
    store = P.CountStore(spark, str(tmp_path / "store"), bucket_rows=10).apply(_calls(spark, [(i, f"t{i % 9}", i // 4, False) for i in range(2000)]))
    read = []
    calls = store.calls
    store.calls = lambda *a, **k: read.append(calls(*a, **k)) or read[-1]
    store.apply(_calls(spark, [(5000, "t1", 7, False)]))
    assert max(df.count() for df in read) < 60


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_two_loads_equal_one(spark, tmp_path, share):
    rows, i = [], 0
    for d in range(40):
        for k in range(1 + d % 6):
            rows.append((i, f"w{(d * k) % 7}" + " " * (i % 3), d, T0 + timedelta(seconds=(i * 37) % 400)))
            i += 1
    rows += [(3, "w0", 0, T0 + timedelta(days=1)), (i, None, 1, T0), (i + 1, "x", None, T0), (i + 2, "", 5, None), (i + 3, "hot", 2, T0)]
    calls = spark.createDataFrame(rows, "add_id BIGINT, term STRING, doc_id BIGINT, logged_at TIMESTAMP")
    seen = {(a, t.rstrip(" "), d) for a, t, d, _ in rows if t is not None and d is not None}
    cf, df = Counter(t for _, t, _ in seen), Counter(t for t, _ in {(t, d) for _, t, d in seen})
    got = {r.term: (r.cf, r.df) for r in P.count_in_two_loads(calls, str(tmp_path / "s"), share).counts().collect()}
    assert got == {t: (cf[t], df[t]) for t in cf}


def test_queries_over_dirty_tables(tables, same_as_sql, spark):
    calls = [(i, i % 2, "the ", i, 0, T0 + timedelta(seconds=i)) for i in range(10)] + [(10, 1, "rare", 1, 0, T0), (10, 1, "rare  ", 1, 0, T0), (11, None, "none", 1, 0, T0), (12, 0, None, 1, 0, T0), (13, 0, "", 3, 0, None)]
    lines = [(0, "the", 4, 4, 0, 0, 0, 0, 1, 0), (0, "the  ", None, 4, 0, 0, 0, 0, 1, 0), (1, "gone", None, None, 0, 0, 0, 0, 1, 0)]
    data = tables(extra="bucket,sign,mark,cf,gone,chunk,v", term_stream=calls, lexicon_line=lines, doc_table=[(i, 1) for i in range(10)] + [(1, None)])
    for name in P.QUERIES:
        same_as_sql(P.QUERIES[name], P.SQL[name], data)
    assert {tuple(r) for r in P.found(spark, data).collect()} == {("the", "common"), ("rare", "rare"), ("none", "rare"), ("", "rare")}
    empty = tables()
    for query in P.QUERIES.values():
        assert query(spark, empty).collect() == []
