"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text: str = "text", tokens: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the number of tokens of each whole text; null and empty texts have 0."""

    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield batch.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return docs.withColumn(tokens, F.pandas_udf(size, "long")(F.col(text)))
