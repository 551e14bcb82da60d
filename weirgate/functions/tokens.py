"""Token counts under a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import importlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The module that gives the folder and the splitting pattern of the public vocabularies.
VOCABULARIES = "public_tokenizers"


def vocabulary_path(name: str) -> str:
    return importlib.import_module(VOCABULARIES).path(name)


@lru_cache(maxsize=4)
def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    pattern = importlib.import_module(VOCABULARIES).PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens={})


def token_counts(text: Column, vocabulary: str) -> Column:
    """Number of tokens of each text, special strings read as ordinary text; null and empty texts have 0."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        code = encoder(vocabulary).encode_ordinary
        return pd.Series([len(code(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
