"""The engine's functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ctxspark.functions.syntax import source_imports, syntax_spans
from ctxspark.functions.tokens import VOCABULARY, token_counter


@udtf(returnType="spec string, reexport boolean")
class ImportsOf:
    """Imports and re-exports of a source: ``SELECT * FROM files, LATERAL imports_of(path, text)``."""

    def eval(self, path: str, text: str) -> Iterator[tuple[str, bool]]:
        if path and text:
            for reexport, specs in enumerate(source_imports(path, text)):
                for spec in specs:
                    yield spec, bool(reexport)


@udtf(returnType="start_line int, end_line int")
class SpansOf:
    """Line spans of a source's chunks along its definitions: ``LATERAL spans_of(path, text, 120)``."""

    def eval(self, path: str, text: str, window: int) -> Iterator[tuple[int, int]]:
        if path and text:
            count = text.count("\n") + (not text.endswith("\n"))
            yield from syntax_spans(path, text, window, 0) or [(a, min(a + window - 1, count)) for a in range(1, count + 1, window)]


def register(spark: SparkSession, vocabulary: str = VOCABULARY) -> None:
    """Registers ``count_tokens``, ``imports_of`` and ``spans_of``."""
    spark.udf.register("count_tokens", token_counter(vocabulary))
    spark.udtf.register("imports_of", ImportsOf)
    spark.udtf.register("spans_of", SpansOf)
