"""Small driver-side files: the options file, path aliases, and the usage log."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.schema import METRICS_LOG


def options_file(path: str) -> dict:
    """The options of a JSON file; ``{}`` where there is none. A malformed file raises a ValueError that says so."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} isn't valid JSON ({e}); correct or remove it") from e


def relaxed_json(text: str):
    """JSON that may hold comments and trailing commas."""
    try:
        return json.loads(text)
    except ValueError:
        bare = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
        bare = re.sub(r"(?<!:)//[^\n]*", "", bare)
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))


def alias_rows(repo_id: str, text: str) -> list[tuple]:
    """``repo_id, prefix, suffix, target, base_url, ord`` of a compiler configuration's path patterns."""
    options = (relaxed_json(text) or {}).get("compilerOptions") or {}
    rows = []
    for pattern, targets in (options.get("paths") or {}).items():
        prefix, _, suffix = pattern.partition("*")
        rows += [(repo_id, prefix, suffix, t, options.get("baseUrl", "."), len(rows) + i + 1) for i, t in enumerate(targets)]
    return rows


ALIASES = "repo_id string, prefix string, suffix string, target string, base_url string, ord int"


def append_log(entries: DataFrame, path: str) -> None:
    """Add usage entries to a folder of JSON lines."""
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Usage entries of JSON lines; blank and corrupt lines are left out, a missing path has none."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], METRICS_LOG)
    return spark.read.schema(METRICS_LOG).option("mode", "DROPMALFORMED").json(path).filter(F.col("type").isNotNull())
