from gleanix.llm import tokens as T
from hypothesis import given, settings
from hypothesis import strategies as st


def test_sizes_are_those_of_the_tokenizer(spark):
    texts = ["", "one", "two words", "<|endoftext|>", "naïve café\n\n  x", None]
    rows = T.with_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    e = T.encoding()
    assert [r.tokens for r in sorted(rows)] == [0 if t is None else len(e.encode_ordinary(t)) for t in texts]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 99, [1])], "doc_id BIGINT, text STRING, tokens INT, other ARRAY<INT>")
    out = T.with_tokens(df)
    assert out.columns == ["doc_id", "other", "tokens"] and out.first().tokens == 2


@settings(deadline=None, max_examples=40)
@given(st.text(st.sampled_from("ab é1 \n.'"), max_size=300), st.integers(3, 40))
def test_parts_size_like_the_whole(text, most):
    e = T.encoding()
    parts = list(T._pieces(text, most))
    assert "".join(parts) == text
    assert sum(len(e.encode_ordinary(p)) for p in parts) == len(e.encode_ordinary(text))


def test_very_long_text():
    text = "The canal of Glenwell. " * 40_000
    assert T.count_tokens(text) == len(T.encoding().encode_ordinary(text))
