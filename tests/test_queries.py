import pytest

from gleanix.plans import registry, retrieval

QUERIES, SQL = registry.queries(), registry.sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_dirty_collection(spark, tables, same_as_sql):
    from datetime import datetime

    a, b = datetime(2031, 1, 1), datetime(2031, 1, 2)
    long = "canal footnote " * 20_000
    docs = [(1, "The canal.", "f", a), (1, "The canal.", "f", b), (2, None, None, a), (3, "", "f", a), (4, "the of", "f", a), (5, long, "f", a), (6, "canal\r\nfootnote\tGlenwell", None, b)]
    queries = [(1, 1, "canal footnote"), (2, 1, "Canal"), (3, 2, None), (4, 3, "the of"), (5, 4, "unknown words"), (6, 5, "  ")]
    data = tables(extra="text,tokens,tf,w,score,rank,r", collection_tsv=docs, queries_test=queries, stop_words=[("the",), ("of",), (None,)])
    for name in ("tokens_raw", "tokens_stem", "doc_table_stem", "corpus_stats", "lexicon", "dgaps", "file_offsets", "batch_or_tfidf_top3", "batch_and_bm25_top3", "pruned_topk", "run_file"):
        same_as_sql(QUERIES[name], SQL[name], data)


def test_empty_tables(spark, tables):
    data = tables()
    for name, query in QUERIES.items():
        rows = query(spark, data).collect()
        assert rows == [] or name in ("corpus_stats", "index_size"), name


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert retrieval.QUERY
