"""Sizes in tokens of a public tokenizer, counted in Arrow batches; the vocabulary loads once per worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that goes with the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_column(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text: null for null, 0 for the empty text; whole texts are read."""

    @F.pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        e = encoder(vocabulary)
        return pd.Series([None if x is None else len(e.encode_ordinary(x)) for x in t], dtype="Int32")

    return count(text)


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    return df.withColumn(out, count_column(F.col(text), vocabulary))
