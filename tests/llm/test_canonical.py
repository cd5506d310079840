import numpy as np
import pytest

from gleanix.llm import bloom as B
from gleanix.llm import canonical as C
from gleanix.session import cut
from tests_llm_rows import T0, T1


def test_found_and_counts(spark, tables, same_as_sql):
    texts = ["The red fox.", "the RED  fox", "fox, red, the!", "the red fox fox", None, "", " ... ", "Größe 12\tm", "größe: 12 M", "ab​c", "ab c", "long " * 50_000, "LONG " * 50_000, "fox red the"]
    rows = [(i, t, "f", T0) for i, t in enumerate(texts)] + [(0, "The red fox.", "f", T1), (0, "The red fox.", None, T1)]
    rows += [(20, "a b c d", "f", T0), (20, None, "f", T1), (21, "A b. c d", "f", T0), (22, "a b c d", "f", T0), (22, "...", "f", T1)]  # the latest text that is not null counts
    data = tables(extra="form,h,r,digest,copies,tie,slice", collection_tsv=rows)
    for name in C.QUERIES:
        same_as_sql(C.QUERIES[name], C.SQL[name], data)
    assert {tuple(r) for r in C.found(spark, data).collect()} == {(0, 1), (0, 2), (0, 13), (7, 8), (9, 10), (11, 12), (20, 21)}
    empty = tables()
    assert C.found(spark, empty).collect() == C.copy_counts(spark, empty).collect() == []


def test_one_form_holds_most_rows(spark, tables):
    rows = [(i, "Same words here" if i % 3 else f"other {i}", "f", T0) for i in range(3000)]
    data = tables(collection_tsv=rows)
    got = C.copy_counts(spark, data).where("copies > 1").collect()
    assert got == [(1, 2000)]
    assert C.found(spark, data).count() == 1999


def test_filter_lets_all_repeats_pass_and_few_others(spark):
    rng = np.random.default_rng(1)
    single, twice = rng.integers(-(2**63), 2**63, 20_000), rng.integers(-(2**63), 2**63, 500)
    df = spark.createDataFrame([(int(h),) for h in [*single, *twice, *twice]] + [(None,)], "h BIGINT").repartition(7)
    bits, log_bits = B.repeat_filter(df, df.count())
    passed = {r.h for r in df.where(B.possibly_repeated(df, "h", bits, log_bits)).collect()}
    assert {int(h) for h in twice} <= passed and None not in passed
    assert len(passed) - 500 < 400


@pytest.mark.parametrize("most, slices", [(21, 1), (20, 4)])
def test_slices_give_the_same(spark, monkeypatch, most, slices):
    """Where one filter would be too full there are several, of slices of the hashes."""
    monkeypatch.setattr(C, "n_slices", lambda n, most: slices)
    records = cut(spark.createDataFrame([(i, bytes([i % 251, i // 251 % 251]), i % 50_000) for i in range(60_000)], "doc_id BIGINT, digest BINARY, h BIGINT"), "records")
    groups, copies = C.group_copies(records.selectExpr("doc_id", "digest", "xxhash64(digest) AS h"), most)
    n = len({(i % 251, i // 251 % 251) for i in range(60_000)})
    assert groups.count() == n and copies.count() == 60_000 - n


def test_sizes():
    assert B.filter_bits(0) == B.SEGMENT and B.filter_bits(10**12) == B.MOST
    assert B.n_slices(0) == 1 and B.n_slices(10**9) == 15 and B.n_slices(2 * 10**9) == 30


def test_few_single_hashes_pass_at_ten_million():
    """Sixteen bits a hash, as for every size: 100,000 hashes twice among 8 million, in one filter of 2**27 bits."""
    rng = np.random.default_rng(5)
    h = rng.integers(-(2**63), 2**63, 8_000_000)
    log_bits = B.filter_bits(len(h))
    at, counts = np.unique(B._positions(np.concatenate([h, h[:100_000]]), log_bits), return_counts=True)
    again = np.packbits(np.bincount(at[counts > 1].astype(np.int64), minlength=1 << log_bits).astype(bool), bitorder="little")
    hit = np.ones(len(h), bool)
    for row in B._positions(h, log_bits).astype(np.int64):
        hit &= B._has(again, row)
    assert hit[:100_000].all() and hit[100_000:].mean() < 0.01
