"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Attribute access to the Parquet tables in a folder: ``Tables(spark, folder).chunks``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def latest_chunks(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per ``chunk_id``, the one loaded last (ties: the greatest hash of the text). Null ids are dropped.

    ``keep``: the columns that are needed beside the id, so that a query that needs no text doesn't shuffle any.
    """
    rest = ["loaded_at", *[c for c in chunks.columns if c not in ("chunk_id", "loaded_at")]] if keep is None else keep
    order = F.struct(F.col("loaded_at"), F.xxhash64("text"))
    rows = chunks.filter("chunk_id IS NOT NULL").select("chunk_id", F.struct(*rest).alias("r"), order.alias("_o"))
    return rows.groupBy("chunk_id").agg(F.max_by("r", "_o").alias("r")).select("chunk_id", "r.*")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """The documents as files of one path each: ``source/doc_id.lang``, null parts written ``none``."""
    part = lambda c: F.coalesce(F.lower(F.col(c)), F.lit("none"))
    path = F.concat(part("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), part("lang"))
    return documents.filter("text IS NOT NULL").select(
        F.coalesce("repo_id", F.lit("none")).alias("repo_id"), path.alias("path"), "doc_id", "text",
        F.octet_length("text").cast("bigint").alias("size"))
