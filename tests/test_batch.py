"""Batches with terms that are in nearly every document."""

import math
import re
from collections import Counter

import pytest

from gleanix.operators import index as I
from gleanix.operators import search as S

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
DOCS = {i: ["is"] * (1 + i % 3) + ["the"] * (i % 10 > 0) + [WORDS[i % 60], WORDS[i * i % 60], WORDS[i * 7 % 31]] for i in range(240)}
#: Two queries of the same terms, one without a number, one of common terms only, one of few documents, one of unknown ones.
QUERIES = [(1, "is the waa"), (2, "The WAA is"), (None, "is wab"), (3, "is the"), (4, "is the wah wbc zz"), (5, "zz"), (6, "wac wad is")]


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in DOCS.items()], "doc_id BIGINT, text STRING")
    return I.build_index(docs, str(tmp_path_factory.mktemp("common")))


def _expected(mode, scoring, k):
    df = Counter(t for words in DOCS.values() for t in set(words))
    mean, rows = sum(map(len, DOCS.values())) // len(DOCS), []
    for qid, text in QUERIES:
        terms, scores = [t for t in set(text.lower().split()) if t in df], []
        for i, words in DOCS.items():
            tf = Counter(words)
            found = [t for t in terms if t in tf]
            if not found or mode == "and" and len(found) < len(terms):
                continue
            if scoring == "tfidf":
                score = sum((1 + math.log(tf[t])) * math.log(len(DOCS) // df[t]) for t in found)
            else:
                score = sum(tf[t] / (1.2 * (0.25 + 0.75 * len(words) / mean) + tf[t]) * math.log(len(DOCS) / df[t]) for t in found)
            scores.append((-round(score, 6), i))
        rows += [(qid, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=str)


def _check(spark, common, capsys, mode, scoring):
    """The rows are right, and matches of queries and documents are not exchanged."""
    queries = spark.createDataFrame(QUERIES, "qid INT, text STRING")
    capsys.readouterr()
    got = S.search_batch(queries, common, mode, scoring, 3)
    got.explain("formatted")
    assert not re.search(r"hashpartitioning\(qid[^)]*doc_id", capsys.readouterr().out)
    assert sorted([(r.qid, r.rank, r.doc_id, r.score + 0.0) for r in got.collect()], key=str) == _expected(mode, scoring, 3)


def test_common_terms_and(spark, common, capsys):
    _check(spark, common, capsys, "and", "bm25")


def test_common_terms_or(spark, common, capsys):
    _check(spark, common, capsys, "or", "tfidf")
