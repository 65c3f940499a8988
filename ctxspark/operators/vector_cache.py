"""The content-addressed vector cache: keys, hits, misses and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_VERSION = 2


def cache_key(namespace: Column, text: Column) -> Column:
    """sha256 of namespace, NUL and text, in hex; null text has no key."""
    return F.sha2(F.concat(namespace, F.lit("\x00"), text), 256)


def live_entries(cache: DataFrame, version: int = CACHE_VERSION) -> DataFrame:
    """One row per namespace and key of the current version that holds a vector: the one saved last."""
    rest = [c for c in cache.columns if c not in ("provider_ns", "entry_key")]
    newest = F.max_by(F.struct(*rest), F.struct("saved_at", "repo_id")).alias("r")
    usable = cache.filter((F.col("cache_version") == version) & F.col("vector").isNotNull() & F.col("entry_key").isNotNull())
    return usable.groupBy("provider_ns", "entry_key").agg(newest).select("provider_ns", "entry_key", "r.*")


def looked_up(texts: DataFrame, entries: DataFrame, namespace: str, text: str = "text") -> DataFrame:
    """``texts`` with their ``entry_key`` and, where it is cached, the ``vector``."""
    keyed = texts.withColumn("entry_key", cache_key(F.lit(namespace), F.col(text)))
    stored = entries.filter(F.col("provider_ns") == namespace).select("entry_key", "vector")
    return keyed.join(stored, "entry_key", "left")


def misses(texts: DataFrame, entries: DataFrame, namespace: str, text: str = "text") -> DataFrame:
    """One row ``entry_key, text`` for each text without an entry; repeats once, null texts never."""
    keyed = texts.select(cache_key(F.lit(namespace), F.col(text)).alias("entry_key"), F.col(text).alias("text"))
    stored = entries.filter(F.col("provider_ns") == namespace).select("entry_key")
    return keyed.filter("entry_key IS NOT NULL").join(stored, "entry_key", "left_anti").dropDuplicates(["entry_key"])


def save_misses(new: DataFrame, path: str, namespace: str) -> None:
    """Append the embedded misses to the Parquet cache, partitioned by namespace."""
    new.select(F.lit(CACHE_VERSION).alias("cache_version"), F.lit(namespace).alias("provider_ns"), "entry_key", "vector",
               F.current_timestamp().alias("saved_at")).write.mode("append").partitionBy("provider_ns").parquet(path)
