"""Token counts by a public tokenizer. The folder of its vocabulary files is a parameter; the files stay there."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
_loaded: dict[tuple[str, str], object] = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once in each worker process."""
    if (folder, vocabulary) not in _loaded:
        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizer_pattern", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[folder, vocabulary] = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, vocabulary]


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null."""

    @F.pandas_udf(T.IntegerType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for texts in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


def with_tokens(df: DataFrame, text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    return df.withColumn("tokens", token_count(F.col(text), folder, vocabulary))
