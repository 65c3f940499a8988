"""Counting and cutting by a public tokenizer's tokens, in Arrow batches."""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Folder of the tokenizer vocabularies; a parameter, never a copy in this repository.
VOCABULARY = os.environ.get("CTXSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Python module whose ``PATTERN`` says how that vocabulary cuts text before its ranks apply.
PATTERN_MODULE = os.environ.get("CTXSPARK_PATTERN_MODULE", "public_tokenizers")
_encodings: dict[tuple[str, str | None], object] = {}


def encoding(path: str = VOCABULARY, pattern: str | None = None):
    """The tokenizer of a rank file, read once in each Python worker. ``pattern``: its cutting pattern, if it isn't the module's."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cut = pattern or importlib.import_module(PATTERN_MODULE).PATTERN
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=cut, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_counter(path: str = VOCABULARY):
    """A pandas UDF from text to its number of tokens; null and empty text have 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def token_pieces(text: str, limit: int, enc) -> list[str]:
    """``text`` in pieces of at most ``limit`` tokens."""
    ids = enc.encode_ordinary(text)
    return [enc.decode(ids[i : i + limit]) for i in range(0, len(ids), limit)] or [text]


def token_slicer(limit: int, path: str = VOCABULARY):
    """A pandas UDF from text to its pieces of at most ``limit`` tokens; the pieces concatenate to the text
    but for characters that a cut splits."""

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([token_pieces(t or "", limit, enc) for t in texts])

    return pieces
