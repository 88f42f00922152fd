"""Token counts with the public tokenizers' vocabulary files; the folder is a parameter and nothing is trained."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splitting pattern of the byte-level vocabularies, as their documentation gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


def file_of(folder: str, name: str) -> str:
    path = os.path.join(folder, name)
    if not os.path.exists(path) and (spec := importlib.util.find_spec("public_tokenizers")) and spec.origin:
        path = os.path.join(os.path.dirname(spec.origin), name)
    return path


@functools.lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, name: str = VOCABULARY):
    """One encoder a worker process and vocabulary."""
    import tiktoken

    with open(file_of(folder, name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(f"{folder}/{name}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, name: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null and empty. Whole texts, whatever their length."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(folder, name).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)
