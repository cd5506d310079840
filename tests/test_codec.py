import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleanix.functions import codec as C

GAMMA = {1: 1, 7: 1, 8: 1, 15: 1, 16: 2, 255: 2, 256: 3, 4096: 4}
UNARY = {1: 1, 7: 1, 8: 2, 9: 2, 16: 3}


def test_sizes(spark):
    df = spark.createDataFrame([(v,) for v in GAMMA], "v BIGINT").select("v", C.gamma_size("v").alias("n"))
    assert {r.v: r.n for r in df.collect()} == GAMMA
    df = spark.createDataFrame([(v,) for v in UNARY], "v BIGINT").select("v", C.unary_size("v").alias("n"))
    assert {r.v: r.n for r in df.collect()} == UNARY
    for v, n in GAMMA.items():
        assert len(C.gamma_encode([v])) == n
    for v, n in UNARY.items():
        assert len(C.unary_encode([v])) == n


@given(st.lists(st.integers(1, 300)))
def test_unary_round_trip(values):
    assert C.unary_decode(C.unary_encode(values)) == values


@given(st.lists(st.integers(1, 2**62)))
def test_gamma_round_trip(values):
    assert C.gamma_decode(C.gamma_encode(values)) == values


def test_layout():
    assert C.unary_encode([3]) == bytes([0b011])  # two ones, then zeros; the lowest bit first
    assert C.gamma_encode([5]) == bytes([0b10011])  # two ones, a zero, then 0 and 1


def test_zero_is_refused():
    for f in (C.unary_encode, C.gamma_encode):
        with pytest.raises(ValueError):
            f([0])


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([([1, 5, 9],), (None,), ([],)], "v ARRAY<BIGINT>")
    rows = df.select("v", C.decode_gaps(C.encode_gaps("v")).alias("g"), C.decode_tfs(C.encode_tfs("v")).alias("t")).collect()
    assert all(r.v == r.g == r.t for r in rows)
