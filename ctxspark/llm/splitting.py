"""Problem 4: texts above a size limit cut into pieces under it, at natural boundaries, with overlapping lines.

Every boundary of a text is joined to its farthest legal successor, overlap included; squaring that successor table again
and again gives all greedy cuts of all texts in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.boundaries import natural_lines
from ctxspark.session import materialise
from ctxspark.sources.tables import latest_chunks

LIMIT, OVERLAP_LINES = 8000, 10


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``chunk_id, path, start_line, text`` of the texts above the limit; repeated rows once, null texts never."""
    large = chunks.filter(F.length("text") > limit).select("chunk_id", "path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "text", "loaded_at")
    return latest_chunks(large).drop("loaded_at")


def boundary_table(large: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> DataFrame:
    """``chunk_id, at, next, begin, line_no, natural``: every boundary of every text with its farthest legal successor.

    ``line_no`` is the boundary's line of the file, ``natural`` says whether a definition or heading starts there.
    """

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, p, n, b, s + line, natural) for c, path, s, t in zip(batch.chunk_id, batch.path, batch.start_line, batch.text)
                    for p, n, b, line, natural in successors(t, path or "", limit, overlap)]
            yield pd.DataFrame(rows, columns=["chunk_id", "at", "next", "begin", "line_no", "natural"])

    kind = "chunk_id long, at int, next int, begin int, line_no int, natural boolean"
    return large.select("chunk_id", "path", "start_line", "text").mapInPandas(table, kind)


def natural_cuts(table: DataFrame) -> DataFrame:
    """``chunk_id, line_no``: the natural cut lines of a :func:`boundary_table`, numbered as in the file, without the texts' first."""
    return table.filter("natural AND at > 0").select("chunk_id", "line_no")


def successors(text: str, path: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, bool]]:
    """``(boundary, farthest legal successor, where a piece from the boundary begins, line from 0, natural)``, places in code points.

    A piece reaches to the last natural line within the limit; without one to the last line after a blank, then the
    last line of any kind, and inside a line that alone is too long by characters. It begins up to ``overlap`` lines
    before its boundary, as many as leave it at least half of the limit.
    """

    at = np.array([0, *(np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10) + 1)])
    at = at[at < len(text)] if len(text) else at
    natural = np.array([at[n - 1] for n in natural_lines(text, path)], dtype=int)
    blank = np.array([p for p, q in zip(at[1:], at[:-1]) if not text[q:p].strip()], dtype=int)
    hard = [int(p) for p, q in zip(at, [*at[1:], len(text)]) if q - p > limit for p in range(p + limit, q, limit)]
    known = set(natural.tolist())
    every = np.unique(np.concatenate([at, np.array(hard, dtype=int), [len(text)]]))
    out = []
    for p in every[:-1]:
        begin = int(p)
        i = int(np.searchsorted(at, p, side="right")) - 1
        if p and at[i] == p:
            for k in range(1, overlap + 1):
                if i - k < 0 or p - at[i - k] > limit // 2:
                    break
                begin = int(at[i - k])
        end = begin + limit
        if end >= len(text):
            nxt = len(text)
        else:
            nxt = 0
            for kind in (natural, blank, at, every):
                j = int(np.searchsorted(kind, end, side="right")) - 1
                if j >= 0 and kind[j] > p and (kind is every or kind is at or kind[j] - begin >= limit // 4):
                    nxt = int(kind[j])
                    break
            if nxt == 0:
                begin = int(p)
                nxt = int(every[np.searchsorted(every, begin + limit, side="right") - 1])
        out.append((int(p), nxt, begin, i, int(p) in known))
    return out


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> DataFrame:
    """``chunk_id, piece, start_line, end_line, text`` of every text above the limit; each piece is at most ``limit`` long."""
    large = materialise(oversized(chunks, limit))
    first = materialise(boundary_table(large, limit, overlap))
    hops, cuts = first.select("chunk_id", "at", "next"), first.filter("at = 0").select("chunk_id", "at")
    while True:
        ends = cuts.join(hops, ["chunk_id", "at"]).select("chunk_id", F.col("next").alias("at"))
        cuts = materialise(cuts.unionByName(ends).distinct(), replaces=cuts)
        far = hops.withColumnRenamed("next", "_mid").join(hops.select("chunk_id", F.col("at").alias("_mid"), "next"), ["chunk_id", "_mid"])
        hops = materialise(far.select("chunk_id", "at", "next"), replaces=hops)
        if hops.filter("at = 0").isEmpty():
            break
    spans = first.join(cuts, ["chunk_id", "at"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "begin", "next"))).alias("_s"))
    cut = large.join(spans, "chunk_id").select("*", F.posexplode("_s").alias("piece", "_c"))
    part = F.expr("substring(text, _c.begin + 1, _c.next - _c.begin)")
    before = F.expr("substring(text, 1, _c.begin)")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return cut.withColumn("_t", part).select(
        "chunk_id", "piece", (F.col("start_line") + breaks(before)).alias("start_line"),
        (F.col("start_line") + breaks(before) + breaks(F.col("_t")) - F.when(F.col("_t").endswith("\n"), 1).otherwise(0)).alias("end_line"),
        F.col("_t").alias("text"))
