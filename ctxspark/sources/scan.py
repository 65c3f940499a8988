"""Repository trees as a Spark data source: ``spark.read.format("repotree")``.

Partitions are the entries below each root; skipped and ignored directories are never entered, and size, extension and
first bytes are tested before a file's content becomes a row. Unlike ``binaryFile`` it returns dot and underscore names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ctxspark.functions.text import BINARY_EXTENSIONS, MAX_FILE_BYTES, SKIPPED_NAMES, SNIFFED_BYTES
from ctxspark.operators.filters import ignore_pattern
from ctxspark.schema import FILES


class RepoTree(DataSource):
    """Options: ``roots`` (JSON object of repo_id to folder), ``ignores`` (JSON list of gitignore lines)."""

    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return RepoTreeReader(json.loads(self.options["roots"]), json.loads(self.options.get("ignores", "[]")))


class RepoTreeReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], ignores: list[str]):
        self.roots, self.ignores = roots, ignores

    def partitions(self) -> list[InputPartition]:
        """One per directory directly below a root, and one for the files in the root."""
        parts = []
        for repo, root in self.roots.items():
            names = sorted(os.listdir(root)) if os.path.isdir(root) else []
            parts += [InputPartition((repo, root, n)) for n in names if os.path.isdir(os.path.join(root, n))]
            parts.append(InputPartition((repo, root, "")))
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo, root, below = partition.value
        lines = list(self.ignores)
        if os.path.exists(at := os.path.join(root, ".gitignore")):
            with open(at, encoding="utf-8", errors="replace") as f:
                lines = f.read().split("\n") + lines
        rules = [(re.compile(rx), neg) for rx, neg in filter(None, map(ignore_pattern, lines))]

        def ignored(rel: str) -> bool:
            out = False
            for rx, neg in rules:
                if rx.search(rel):
                    out = not neg
            return out

        def walk(folder: str, deep: bool) -> Iterator[tuple]:
            try:
                names = sorted(os.listdir(folder))
            except OSError:
                return
            for name in names:
                path = os.path.join(folder, name)
                rel = os.path.relpath(path, root)
                if name in SKIPPED_NAMES or ignored(rel):
                    continue
                try:
                    size = os.stat(path).st_size
                except OSError:
                    continue
                if os.path.isdir(path):
                    if deep and not ignored(rel + "/"):
                        yield from walk(path, True)
                elif 0 < size <= MAX_FILE_BYTES and "." + name.lower().rpartition(".")[2] not in BINARY_EXTENSIONS:
                    with open(path, "rb") as f:
                        content = f.read()
                    if b"\0" not in content[:SNIFFED_BYTES]:
                        yield repo, rel, size, content

        if not below:
            yield from walk(root, False)
        elif below not in SKIPPED_NAMES and not ignored(below) and not ignored(below + "/"):
            yield from walk(os.path.join(root, below), True)


def scanned(spark: SparkSession, roots: dict[str, str], ignores: list[str] = []) -> DataFrame:
    """``repo_id, path, size, text`` of all admitted files; bad bytes become U+FFFD. A missing root has none."""
    spark.dataSource.register(RepoTree)
    files = spark.read.format("repotree").option("roots", json.dumps(roots)).option("ignores", json.dumps(ignores)).load()
    return files.select("repo_id", "path", "size", F.expr("make_valid_utf8(cast(content as string))").alias("text"))
