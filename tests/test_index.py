import random

import pytest
from pyspark.sql import functions as F

from gleanix.functions import text as T
from gleanix.operators import index as I
from gleanix.operators import search as S

DOCS = [(0, "solar panels power solar farms"), (1, "wind farms power cities"), (2, "solar energy"), (3, "cities need water"), (4, "water wind wind wind")]
BOUNDS = {
    "cities": (2, 2, 0.693147, 0.416496), "energy": (1, 1, 1.609438, 0.847073), "farms": (2, 2, 0.693147, 0.366516), "need": (1, 1, 1.609438, 0.731563), "panels": (1, 1, 1.609438, 0.574799),
    "power": (2, 2, 0.693147, 0.366516), "solar": (2, 3, 1.173600, 0.482258), "water": (2, 2, 0.693147, 0.416496), "wind": (2, 4, 1.454647, 0.610860),
}
TOP = {
    ("solar farms", "tfidf", "or"): [(0, 1.866747), (1, 0.693147), (2, 0.693147)],
    ("solar farms", "bm25", "or"): [(0, 0.809505), (2, 0.482258), (1, 0.366516)],
    ("solar farms", "tfidf", "and"): [(0, 1.866747)],
    ("wind farms missingword", "tfidf", "or"): [(4, 1.454647), (1, 1.386294), (0, 0.693147)],
    ("wind farms missingword", "bm25", "or"): [(1, 0.733033), (4, 0.610860), (0, 0.327247)],
    ("wind farms missingword", "bm25", "and"): [(1, 0.733033)],
    ("water", "tfidf", "or"): [(3, 0.693147), (4, 0.693147)],
    ("water", "bm25", "and"): [(3, 0.416496), (4, 0.366516)],
    ("missingword", "tfidf", "or"): [],
    ("water water water", "tfidf", "or"): [(3, 0.693147), (4, 0.693147)],
}


@pytest.fixture(scope="module")
def ix(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id BIGINT, text STRING")
    return I.build_index(docs, str(tmp_path_factory.mktemp("index")))


def test_lexicon(ix):
    assert ix.n_docs == 5 and ix.avgdl == 3.0
    got = {r.term: (r.df, r.cf, round(r.ub_tfidf, 6), round(r.ub_bm25, 6)) for r in ix.lexicon.collect()}
    assert got == BOUNDS


@pytest.mark.parametrize("case", TOP)
def test_search(ix, case):
    text, scoring, mode = case
    assert [(r.doc_id, r.score) for r in S.search(text, ix, mode, scoring).orderBy("rank").collect()] == TOP[case]


def test_pruned_is_exhaustive(spark, ix):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["solar farms", "wind water power", "cities need water energy", "", "x", "solar wind farms power"])], "qid INT, text STRING")
    for scoring in ("tfidf", "bm25"):
        for k in (1, 2, 3):
            assert sorted(S.search_pruned(queries, ix, scoring, k).collect()) == sorted(S.search_batch(queries, ix, "or", scoring, k).collect())


def test_batch_outcomes(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id BIGINT, text STRING")
    ix = I.build_index(docs, str(tmp_path), stop=["the", "of"], stemmed=True)
    queries = spark.createDataFrame([(1, "the of"), (2, "nothing known"), (3, "Cities!"), (4, None)], "qid INT, text STRING")
    assert sorted((r.qid, r.iter, r.doc_id, r.rel) for r in S.batch_run(queries, ix).collect()) == [(1, 0, -1, 1), (3, 0, 1, 1)]


def _plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_lookups_are_pushed_to_the_scans(spark, ix, capsys):
    capsys.readouterr()
    plan = _plan(S.search("wind water", ix), capsys)
    assert "PushedFilters: [In(term, [water,wind])]" in plan and "ReadSchema: struct<term:string,doc_id:bigint,tf:int>" in plan
    queries = spark.createDataFrame([(1, "wind water"), (2, "wind")], "qid INT, text STRING")
    assert "In(term, [" in _plan(S.search_batch(queries, ix), capsys)


WORDS = [f"w{''.join(chr(97 + int(c)) for c in str(k))}" for k in range(400)]


@pytest.fixture(scope="module", params=[True, False])
def large(request, spark, tmp_path_factory):
    """An index, once with whole-number division and once without, and its path; odd stop words."""
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("large"))
    docs = [(i, " ".join(["the", "of"] + rng.choices(WORDS, [1 / (k + 1) ** 1.3 for k in range(400)], k=rng.randrange(5, 60)))) for i in range(3000)]
    return I.build_index(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), path, stop=["a,b", "", "of"], floor=request.param), path


def test_pruned_equals_exhaustive_on_a_larger_index(spark, large):
    (ix, _), words, rng, floor = large, WORDS, random.Random(9), large[0].floor
    texts = [" ".join(rng.sample(words, n) + ["the", "of"] * (n % 2)) for n in range(1, 9)]
    queries = spark.createDataFrame(list(enumerate(texts)), "qid INT, text STRING")
    for scoring in ("tfidf", "bm25"):
        for k in (1, 11):
            full = sorted(S.search_batch(queries, ix, "or", scoring, k, floor).collect())
            assert sorted(S.search_pruned(queries, ix, scoring, k).collect()) == full
        for i, text in enumerate(texts[:2]):
            one = S.search(text, ix, "or", scoring, 3, floor, pruned=True).collect()
            assert [(i, *r) for r in one] == sorted(r for r in S.search_batch(queries, ix, "or", scoring, 3, floor).collect() if r.qid == i)


def test_pruning_reads_few_blocks(spark, large, capsys):
    ix, words = large[0], WORDS
    rare = [r.term for r in ix.lexicon.where("df BETWEEN 4 AND 8").collect()]
    terms = S.bound_prefixes(spark.createDataFrame([(1, f"{words[0]} {rare[0]}")], "qid INT, text STRING"), ix, "bm25").collect()
    assert any(r.upto < r.least for r in terms)
    some = ix.postings.where(F.col("term") == rare[0])
    blocks, whole = S.needed_blocks(some, ix, [words[0]]), ix.skips.where(F.col("term") == words[0]).count()
    assert 0 < blocks.count() <= 8 < whole
    rows = S.block_lists(some, ix, [words[0]])
    assert rows.count() < ix.postings.where(F.col("term") == words[0]).count() / 3
    plan = _plan(rows, capsys)
    assert "GreaterThanOrEqual(doc_id" in plan and "LessThanOrEqual(doc_id" in plan


def test_more_terms_than_are_broadcast(spark, large, monkeypatch):
    ix, words, rng = large[0], WORDS, random.Random(10)
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, 4))) for i in range(20)], "qid INT, text STRING")
    full = sorted(S.search_batch(queries, ix, floor=ix.floor).collect())
    monkeypatch.setattr(S, "BROADCAST_ROWS", 10)
    assert sorted(S.search_batch(queries, ix, floor=ix.floor).collect()) == full
    monkeypatch.setattr(S, "PUSHED_TERMS", 3)
    monkeypatch.setattr(S, "PUSHED_RANGES", 1)
    assert sorted(S.search_pruned(queries, ix, "tfidf").collect()) == full
    assert S.search("the wa wb", ix, pruned=True, scoring="bm25").collect() == S.search("the wa wb", ix, scoring="bm25").collect()


def test_written_tables(spark, large):
    """Lexicon, skip blocks and coded blocks are sorted, and the codes give the postings again; odd stop words survive."""
    ix, path = large
    assert I.load_index(spark, path).stop == ["", "a,b", "of"] and ix.lexicon.where("term = 'of'").count() == 0
    for table, key in ((ix.lexicon, ["term"]), (ix.skips, ["term", "block"]), (ix.coded, ["term", "block"])):
        files = {}
        for r in table.select(F.input_file_name().alias("f"), *key).collect():
            files.setdefault(r.f, []).append(tuple(r)[1:])
        spans = sorted((rows[0], rows[-1]) for rows in files.values())
        assert all(rows == sorted(rows) for rows in files.values()) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    postings = ix.postings.select("term", "block", "doc_id", "tf")
    assert sorted(I.decode_blocks(ix.coded).collect()) == sorted(postings.collect())
    assert {(r.term, r.block): (r.first_doc_id, r.final_doc_id) for r in ix.skips.collect()} == {(r.term, r.block): (r.a, r.b) for r in postings.groupBy("term", "block").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()}


def test_as_many_postings_reach_the_weight(spark, large):
    ix = large[0]
    rows = I.weighted(ix.postings.join(ix.lexicon.select("term", "df", "reached_tfidf", "reached_bm25"), "term"), ix.n_docs, ix.avgdl, ix.floor)
    many = [F.count_if(F.col(f"w_{w}") >= F.col(f"reached_{w}")[i] - 1e-9).alias(f"{w}{i}") for w in ("tfidf", "bm25") for i in range(len(I.LEVELS))]
    for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *many).collect():
        assert all(r[f"{w}{i}"] >= min(k, r.df) for w in ("tfidf", "bm25") for i, k in enumerate(I.LEVELS) if r.df >= k)


def test_duplicates_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        I.build_index(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id BIGINT, text STRING"), str(tmp_path))


def test_empty_collection(spark, tmp_path):
    ix = I.build_index(spark.createDataFrame([], "doc_id BIGINT, text STRING"), str(tmp_path))
    assert ix.n_docs == 0 and ix.avgdl is None
    assert S.search("anything", ix).collect() == [] and S.search("anything", ix, scoring="bm25").collect() == []


def _postings(spark, ids, term="t"):
    return spark.createDataFrame([(term, i, 1 + i % 9, 10) for i in ids], "term STRING, doc_id BIGINT, tf INT, dl INT")


@pytest.mark.parametrize("df, blocks", [(1, 1), (2, 1), (5, 2), (10, 3), (16, 4), (17, 4)])
def test_blocks(spark, df, blocks):
    rows = I.with_blocks(_postings(spark, range(df)))
    assert rows.select("block").distinct().count() == blocks
    assert I.lexicon(_postings(spark, range(df))).first().n_block == blocks


@pytest.mark.parametrize("width", [2, 3, 7, 1_000_000])
def test_gaps(spark, width):
    rows = I.with_blocks(_postings(spark, [2, 6, 7, 19, 20]), width)
    got = sorted((r.block, r.doc_id, r.gap) for r in rows.collect())
    assert [(b, g) for b, _, g in got] == [(0, 3), (0, 4), (0, 1), (1, 20), (1, 1)]
    skips = {r.block: r for r in I.skip_blocks(rows).collect()}
    assert (skips[0].final_doc_id, skips[1].final_doc_id) == (7, 20)
    assert all(r.doc_id == r.decoded for r in I.from_gaps(rows).collect())
    again = I.decode_blocks(I.encode_blocks(rows)).collect()
    assert sorted((r.doc_id, r.tf) for r in again) == [(i, 1 + i % 9) for i in (2, 6, 7, 19, 20)]


def test_invariants(spark):
    docs = spark.createDataFrame(DOCS, "doc_id BIGINT, text STRING")
    rows = I.postings(T.analyse(docs))
    lex = I.lexicon(rows)
    assert rows.agg(F.sum("tf")).first()[0] == lex.agg(F.sum("cf")).first()[0] == 18
    assert rows.count() == lex.agg(F.sum("df")).first()[0]
