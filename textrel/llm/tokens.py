"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's texts are parted before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
_LOADED: dict = {}


def default_path() -> str:
    """Where the installed vocabulary files have the default one."""
    import public_tokenizers

    return str(public_tokenizers.path(DEFAULT_FILE))


def encoding(path: str):
    """The encoding of a file of base64 tokens and ranks; loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text, whole texts of any length; null and empty texts have 0."""
    path = path or default_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return count(text)
