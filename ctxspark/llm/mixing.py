"""Problem 7: records drawn from several sources so that each has its share of all tokens.

Tokens are summed by source and hash bucket. The budget of a source is so many full passes and a rest; the rest is the texts below
a hash threshold, found in the nested histograms: only the bucket that the budget ends in is summed again by finer
hash bits. Drawing is then a filter on the hash; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.session import materialise

#: Hash bits of each level; the levels together tell single texts apart.
BITS, LEVELS = 12, 4


def once_per_text(items: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per text: the one of the least ``doc_id``. A text delivered again, from whatever source, counts once.

    With ``targets`` only copies of the sources that can give something count.
    """
    if targets is not None:
        items = items.join(F.broadcast(targets.filter("target_share > 0 AND max_repeats > 0").select("source").distinct()), "source", "left_semi")
    return items.groupBy("text_id").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("r")).select("r.*")


def drawn(items: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, draws``: how often each text is taken, at least once.

    The total is the largest for which every source can give its share within its ``max_repeats``. Sources without a
    positive target, or with a null one, and texts without a source give nothing; if a source with a target has no texts,
    the others share out as if it weren't listed. ``targets`` is a fixed small table.
    """
    spark = items.sparkSession
    rows = items.join(F.broadcast(targets.select("source").distinct()), "source").withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 64 - BITS * LEVELS))
    totals = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row per target
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect() if (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0 and totals.get(r["source"])}
    if not wanted:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, draws int")
    whole = sum(s for s, _ in wanted.values())
    total = min(totals[s] * times / (share / whole) for s, (share, times) in wanted.items())
    passes, rest, prefix = {}, {}, {}
    for s, (share, _) in wanted.items():
        passes[s] = int(total * share / whole / totals[s] + 1e-12)
        rest[s] = total * share / whole - passes[s] * totals[s]
        prefix[s] = 0
    bound, near = dict(prefix), rows
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        edge = spark.createDataFrame([(s, p) for s, p in prefix.items()], "source string, _p long")
        if level > 1:  # only the boundary buckets go on
            inside = near.select("source", "_h", "tokens").join(F.broadcast(edge), "source").filter(F.shiftright("_h", shift + BITS) == F.col("_p")).drop("_p")
            near = materialise(inside, replaces=near if level > 2 else None)
        counts = near.groupBy("source", F.shiftright("_h", shift).alias("b")).agg(F.sum("tokens").alias("n")).collect()  # 2^BITS per target at most
        by = {s: sorted((r["b"], r["n"]) for r in counts if r["source"] == s) for s in prefix}
        for s, buckets in by.items():
            at = prefix[s] << BITS
            bound[s] = at << shift
            for b, n in buckets:
                if n > rest[s]:
                    at = b + (level == LEVELS and rest[s] >= n / 2)  # the last text comes in if that is nearer
                    break
                rest[s] -= n
                at = b + 1
            prefix[s] = at
            bound[s] = at << shift
    cut = spark.createDataFrame([(s, passes[s], bound[s]) for s in wanted], "source string, _k int, _bound long")
    draws = F.col("_k") + F.when(F.col("_h") < F.col("_bound"), 1).otherwise(0)
    return rows.join(F.broadcast(cut), "source").withColumn("draws", draws.cast("int")).filter("draws > 0").select("doc_id", "source", "tokens", "draws")


def shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, tokens, share, texts, most_draws`` of every target; 0 where nothing was drawn."""
    sums = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("draws")).alias("tokens"), F.count("*").alias("texts"), F.max("draws").alias("most_draws"))
    all_tokens = sums.agg(F.sum("tokens").alias("_all"))
    joined = targets.select("source", "target_share").join(sums, "source", "left").join(F.broadcast(all_tokens))
    return joined.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"),
                         F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_draws", F.lit(0)).alias("most_draws"))
