"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.tokens import VOCABULARY, token_counter
from ctxspark.session import materialise


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, text_id, tokens`` as a table; each text is tokenized once per row, and left behind.

    ``text_id`` is a hash of the text with plain line ends. Null and empty texts have no row.
    """
    rows = documents.filter("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "source", "text")
    text_id = F.md5(F.replace("text", F.lit("\r\n"), F.lit("\n")))
    counted = rows.select("doc_id", "source", text_id.alias("text_id"), token_counter(vocabulary)("text").alias("tokens"))
    return materialise(counted.dropDuplicates(["doc_id", "text_id"]).filter("tokens > 0"))
