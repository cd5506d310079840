from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanix.operators.skew import heavy_terms, join_blocks, join_stats, term_figures, tree_aggregate
from gleanix.plans import heavy
from gleanix.session import cut
from gleanix.sources.tables import record_terms


def _calls(spark):
    pairs = [(d, "hot", 1 + d % 5) for d in range(400)] + [(d, f"t{d % 17}", 1 + d % 3) for d in range(400)] + [(2, "", 3)] + [(7, f"u{i}", 4) for i in range(500)]
    rows = [(d, t) for d, t, tf in pairs for _ in range(tf)]
    calls = [(i, t + " " * (i % 2), d) for i, (d, t) in enumerate(rows)]
    return pairs, spark.createDataFrame(calls + calls[::3] + [(1, None, 2), (1, "x", None)], "add_id BIGINT, term STRING, doc_id BIGINT").repartition(5)


@pytest.mark.parametrize("chunk, fan_in", [(1, 2), (10, 3), (100, 16), (100_000, 16)])
def test_tree_equals_plain_aggregation(spark, chunk, fan_in):
    """At small chunks record 7, and others, fill more than one and are split."""
    pairs, df = _calls(spark)
    cf, n, top = Counter(), Counter(), defaultdict(int)
    for _, t, tf in pairs:
        cf[t] += tf
        n[t] += 1
        top[t] = max(top[t], tf)
    got = term_figures(df, df.count(), chunk, fan_in)
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, cf[t], n[t], top[t]) for t in cf)
    assert sorted((r.doc_id, r.term, r.tf) for r in record_terms(df, chunk).collect()) == sorted(pairs)


def test_calls_are_exchanged_once_before_the_rounds(spark):
    _, df = _calls(spark)
    plan = term_figures(df, 20_000, 5000, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange RoundRobin") == 1  # the last is the test's own


def test_tree_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(50)] + [("a", 3, 1)], "k STRING, c BIGINT, v BIGINT")
    got = tree_aggregate(df, ["k"], {"n": F.sum("v")}, {"n": F.sum("n")}, "c", 50, 4)
    assert {r.k: r.n for r in got.collect()} == {None: 1225, "a": 1}


def test_heavy_terms(spark):
    pairs, df = _calls(spark)
    got = {r.term: r.cf for r in heavy_terms(df, df.count(), 0.2).collect()}
    assert got == {"hot": sum(tf for _, t, tf in pairs if t == "hot")}
    assert heavy_terms(df.limit(0), 0).collect() == []


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_join_blocks(spark, block):
    left = [("hot", i) for i in range(60)] + [("one", 1), ("left", 2), (None, 3)]
    right = [("hot", i) for i in range(45)] + [("one", i) for i in range(20)] + [("right", 2), (None, 3)]
    x, y = (cut(spark.createDataFrame(rows, f"k STRING, {c} INT"), "side") for rows, c in ((left, "v"), (right, "w")))
    got = sorted((r.k, r.v, r.w) for r in join_blocks(x, y, "k", block).collect())
    assert got == sorted((k, v, w) for k, v in left for m, w in right if k == m and k)
    assert join_blocks(x.limit(0), y, "k", block).collect() == []


def test_join_stats_with_a_hot_key(spark):
    rows = cut(spark.createDataFrame([("hot", i) for i in range(9000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k STRING, v INT"), "rows")
    stats = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = join_stats(rows, stats, "k", "n", rows.count())
    assert joined.count() == 9050
    assert joined.where("k = 'hot'").select("n").distinct().collect()[0].n == 9000
    assert join_stats(rows.limit(0), stats.limit(0), "k", "n", 0).count() == 0


def test_queries_over_dirty_calls(spark, tables, same_as_sql):
    from datetime import datetime

    t = datetime(2031, 1, 1)
    calls = [(1, 0, "a", 1, 0, t), (1, 0, "a   ", 1, 0, t), (2, 0, "a", 1, 1, t), (3, 0, "", 2, 0, t), (4, 0, "   ", 2, 1, None), (5, 0, None, 2, 2, t), (6, 0, "b", None, 0, t), (7, 0, "b", 3, 0, t)]
    data = tables(extra="chunk,tf,cf,df,r", term_stream=calls)
    for name in heavy.QUERIES:
        same_as_sql(heavy.QUERIES[name], heavy.SQL[name], data)
    assert {r.term: (r.cf, r.df, r.max_tf) for r in heavy.figures(spark, data).collect()} == {"a": (2, 1, 2), "": (2, 1, 2), "b": (1, 1, 1)}
    empty = tables()
    for query in heavy.QUERIES.values():
        assert query(spark, empty).collect() == []
