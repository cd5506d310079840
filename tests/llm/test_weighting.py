import math
import random
from collections import Counter

from gleanix.llm import weighting as W
from tests_llm_rows import T0


def test_against_plain_python(spark, tables, same_as_sql):
    rng = random.Random(5)
    calls, i = [], 0
    for d in range(60):
        for w in rng.choices(["the", "of", *(f"t{k}" for k in range(40))], [40, 20, *[1] * 40], k=30) + [f"own{d % 20}"] * (d % 5):
            calls.append((i, 0, w + " " * (i % 2), d, 0, T0))
            i += 1
    calls += [(0, 0, calls[0][2], 0, 0, T0), (i, 0, None, 1, 0, T0), (i + 1, 0, "x", None, 0, T0), (i + 2, 0, "", 7, 0, None)]
    data = tables(extra="tf,df,dl,avgdl", term_stream=calls, doc_table=[(d, 30) for d in range(60)] + [(3, None)], lexicon_line_final=[(0, "the ", 1, 1, 1, 0, None, None), (1, "the", 1, 1, 1, 0, 2.5, None)])
    for name in W.QUERIES:
        same_as_sql(W.QUERIES[name], W.SQL[name], data)
    seen = {(a, t.rstrip(" "), d) for a, _, t, d, _, _ in calls if t is not None and d is not None}
    tf = Counter((d, t) for _, t, d in seen)
    df = Counter(t for _, t in tf)
    expected = {(d, t) for (d, t), n in tf.items() if df[t] >= 2 and (1 + math.log(n)) * math.log(60 // df[t]) >= 1.5 * math.log(60)}
    assert expected and {tuple(r) for r in W.found(spark, data).collect()} == expected


def test_rare_terms_stand_above_common_ones(spark, tables):
    calls = [(d, 0, "the", d, 0, T0) for d in range(50)] + [(100, 0, "rare", 3, 0, T0)]
    data = tables(term_stream=calls, doc_table=[(d, 1) for d in range(50)])
    rows = {r.term: r.w_bm25 for r in W.all_weights(spark, data).where("doc_id = 3").collect()}
    assert rows["rare"] > rows["the"] == 0


def test_empty_tables_and_more_records_than_documents(spark, tables):
    empty = tables()
    for query in W.QUERIES.values():
        assert query(spark, empty).collect() == []
    data = tables(term_stream=[(d, 0, "a", d, 0, T0) for d in range(5)], doc_table=[(1, 1)])
    assert W.found(spark, data).collect() == []
    assert all(r.w_tfidf == float("-inf") for r in W.all_weights(spark, data).collect())
