"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str, most: int = 400_000) -> Iterator[str]:
    """The text in parts that tokenise like the whole: cut before a blank that follows a letter or digit and precedes one."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end > at + 1 and not (text[end] == " " and text[end - 1].isalnum() and end + 1 < len(text) and text[end + 1].isalnum()):
            end -= 1
        if end == at + 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a whole text, however long; special strings count as ordinary text."""
    e = encoding(path)
    if len(text) <= 400_000:
        return len(e.encode_ordinary(text))
    return sum(len(e.encode_ordinary(p)) for p in _pieces(text))


def with_tokens(documents: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Replaces the text by ``tokens`` (int), its size; null texts have size 0.

    Texts are read and sized in the same task; only sizes go on.
    """
    others = [f for f in documents.schema.fields if f.name != text and f.name != "tokens"]
    names = [f.name for f in others]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["tokens INT"])

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [0 if t is None else count_tokens(t, path) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(tokens, pa.int32())], names=[*names, "tokens"])

    return documents.select(*names, text).mapInArrow(size, schema)
