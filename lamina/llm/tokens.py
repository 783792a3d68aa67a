"""Token counts of a public tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("LAMINA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The byte-level BPE of the file, loaded once per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; 0 for a null or empty text.  Special tokens' names are ordinary text."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return counted(F.col(text) if isinstance(text, str) else text)
