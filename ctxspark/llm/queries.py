"""The queries of the numbered problems, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.llm import broken, handwritten, mixing, packing, secrets, sentences, similar, sizes, splitting
from ctxspark.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of :class:`Tables` under its own name."""
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


@query
def p1_found(t: Tables) -> DataFrame:
    """Lines of chunks that carry a credential."""
    return secrets.found_lines(t.chunks)


@query
def p1_redacted(t: Tables) -> DataFrame:
    """Texts of the chunks with a credential, masked."""
    return secrets.redacted(t.chunks)


@query
def p2_found(t: Tables) -> DataFrame:
    """Files that were not written by hand in their repository."""
    return handwritten.not_handwritten(t.chunks).select("repo_id", "path")


@query
def p2_reasons(t: Tables) -> DataFrame:
    """Number of such files by repository and reason, and how many of them the Merkle hashes alone find."""
    files = handwritten.not_handwritten(t.chunks).groupBy("repo_id", "reason")
    return files.agg(F.count("*").alias("files"), F.count_if("copied").alias("by_hashes"))


@query
def p4_found(t: Tables) -> DataFrame:
    """Natural cut lines of the chunks above the size limit."""
    return splitting.natural_cuts(splitting.boundary_table(splitting.oversized(t.chunks)))


@query
def p4_pieces(t: Tables) -> DataFrame:
    """The pieces of the chunks above the size limit."""
    return splitting.pieces(t.chunks)


@query
def p5_found(t: Tables) -> DataFrame:
    """Pairs of entries where one is among the 5 most similar of the other and their cosine is 0.85 at least."""
    rows = similar.usable(t.cache_entries, t.provider_dims).withColumn("asks", F.lit(True))
    near = similar.with_copies(rows, 5, 0.85).filter(F.round("cosine", 6) >= 0.85)
    return near.select(F.least("entry_key", "near").alias("key_a"), F.greatest("entry_key", "near").alias("key_b")).filter("key_a < key_b").distinct()


@query
def p5_neighbours(t: Tables) -> DataFrame:
    """The 5 most similar entries, whatever their cosine, of every entry whose key is divisible by 50."""
    asks = F.conv(F.substring("entry_key", 1, 12), 16, 10).cast("bigint") % 50 == 0
    rows = similar.usable(t.cache_entries, t.provider_dims).withColumn("asks", F.coalesce(asks, F.lit(False)))
    return similar.with_copies(rows, 5).select("provider_ns", "entry_key", "near", F.round("cosine", 5).alias("cosine"))


@query
def p6_packing(t: Tables) -> DataFrame:
    """Every document in a container of every capacity."""
    return packing.packed(sizes.sized(t.documents).select("doc_id", "tokens").dropDuplicates(["doc_id"]), t.pack_limits)


@query
def p6_fill(t: Tables) -> DataFrame:
    """Containers, tokens and fill by capacity, and what the least-squares step has to do with it."""
    items = sizes.sized(t.documents).select("doc_id", "tokens").dropDuplicates(["doc_id"])
    by = packing.packed(items, t.pack_limits).groupBy("limit_id", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    sums = by.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"), F.max("items").alias("most_items"))
    return sums.join(t.pack_limits, "limit_id").join(packing.planned_fill(items, t.pack_limits), "limit_id").withColumn("fill", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6))


@query
def p7_drawn(t: Tables) -> DataFrame:
    """The drawn texts, with how often each is taken."""
    return mixing.drawn(mixing.once_per_text(sizes.sized(t.documents), t.mix_targets), t.mix_targets)


@query
def p7_shares(t: Tables) -> DataFrame:
    """The share of all tokens that each source reached."""
    return mixing.shares(p7_drawn(t), t.mix_targets)


@query
def p8_found(t: Tables) -> DataFrame:
    """Sentences of all documents."""
    return sentences.sentences(t.documents)


@query
def p8_lengths(t: Tables) -> DataFrame:
    """Number and mean length of sentences by language tag of the document."""
    spans = sentences.sentences(t.documents).join(t.documents.select("doc_id", F.lower("lang").alias("lang")).dropDuplicates(["doc_id"]), "doc_id")
    return spans.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.avg(F.col("end_char") - F.col("start_char")), 4).alias("mean_chars"))


@query
def p3_found(t: Tables) -> DataFrame:
    """Files that break the grammar of their language."""
    return broken.broken(t.chunks, t.ext_langs).select("repo_id", "path")


@query
def p3_rates(t: Tables) -> DataFrame:
    """Share of such files by repository and language."""
    return broken.rates(t.chunks, t.ext_langs)


@query
def p3_repairs(t: Tables) -> DataFrame:
    """Least number of edits and kind of damage of each such file."""
    return broken.broken(t.chunks, t.ext_langs)


# Brute force over all pairs of a namespace; on the small tables that DuckDB gets here that is quick.
SQL["p5_found"] = """
WITH one AS (
    SELECT provider_ns, entry_key, any_value(vector) AS v FROM cache_entries JOIN provider_dims USING (provider_ns)
    WHERE cache_version = 2 AND vector IS NOT NULL AND entry_key IS NOT NULL AND len(vector) = dims
        AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1, 2),
usable AS (SELECT * FROM one WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
pair AS (
    SELECT a.provider_ns, a.entry_key AS k, b.entry_key AS n, round(list_cosine_similarity(a.v, b.v), 6) AS c
    FROM usable a JOIN usable b ON a.provider_ns = b.provider_ns AND a.entry_key <> b.entry_key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY provider_ns, k ORDER BY c DESC, n) AS r FROM pair)
SELECT DISTINCT least(k, n) AS key_a, greatest(k, n) AS key_b FROM ranked WHERE r <= 5 AND c >= 0.85
"""
