"""Problem 5: the k most similar vectors of every vector, by stable projections and a kd-tree.

Unit vectors are projected to a few dimensions with Gaussian weights: a pair at distance d lies at d^2 times a chi-square
variable in the projection. A kd-tree over the projection, fitted on a bounded sample, cuts each namespace into blocks of
bounded size. A vector's k-th best distance so far bounds the search: blocks are verified, by true cosines, in the order of their
projected distance while that is below the bound times the chi-square quantile; beyond it the stopping test holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxspark.session import materialise

PROJECTED, SEED = 8, 20240607
#: Rows per namespace that the kd-tree is fitted on; every row is indexed.
SAMPLE = 20_000
#: Vectors in a block, and in a slice of it, which is what a row of a table holds; cosines at hand at once.
BLOCK_BYTES, SLICE_BYTES, CELLS = 4 << 20, 1 << 18, 2 << 20
#: Blocks that a row asks before its radius is tightened; neighbouring blocks that ask, or are asked, in one task.
FIRST, GROUPED = 2, 4
#: Parts into which the members of one class fall.
SALTS = 16
#: Probability with which the stopping test keeps a true neighbour.
CONFIDENCE_Z = 3.1


def chi_square_bound(m: int = PROJECTED, z: float = CONFIDENCE_Z) -> float:
    """The quantile of a chi-square variable with ``m`` degrees at the normal quantile ``z`` (Wilson and Hilferty)."""
    return m * (1 - 2 / (9 * m) + z * math.sqrt(2 / (9 * m))) ** 3


def usable(entries: DataFrame, dims: DataFrame, version: int = 2) -> DataFrame:
    """``provider_ns, entry_key, unit, at``: one row per entry with a finite vector of the right length that isn't zero.

    ``unit`` holds the unit vector as 32-bit floats, ``at`` its projection. ``dims`` is the fixed table of namespaces.
    """
    rows = entries.filter((F.col("cache_version") == version) & F.col("vector").isNotNull() & F.col("entry_key").isNotNull())
    rows = rows.select("provider_ns", "entry_key", "vector").join(F.broadcast(dims.select("provider_ns", "dims").distinct()), "provider_ns")
    rows = rows.filter((F.size("vector") == F.col("dims")) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("dims"):
                m = np.stack(part.vector.to_numpy()).astype(float)
                m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
                norm = np.linalg.norm(m, axis=1)
                ok = norm > 0
                if not ok.any():
                    continue
                u = (m[ok] / norm[ok, None]).astype(np.float32)
                at = u @ np.random.default_rng(SEED).standard_normal((n, PROJECTED)).astype(np.float32)
                yield pd.DataFrame({"provider_ns": part.provider_ns[ok], "entry_key": part.entry_key[ok], "unit": [x.tobytes() for x in u], "at": list(at)})

    out = rows.mapInPandas(unit, "provider_ns string, entry_key string, unit binary, at array<float>")
    return out.groupBy("provider_ns", "entry_key").agg(F.min(F.struct("unit", "at")).alias("v")).select("provider_ns", "entry_key", "v.*")


def kd_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits of a kd-tree in heap order, at the median of the widest dimension; small parts aren't split further."""
    splits: list[tuple[int, float]] = []
    parts = [points]
    for _ in range(depth):
        below = []
        for p in parts:
            if len(p) < 16:
                splits.append((0, math.inf))
                below += [p, p[:0]]
                continue
            d = int(np.argmax(p.var(axis=0)))
            t = float(np.median(p[:, d]))
            splits.append((d, t))
            below += [p[p[:, d] <= t], p[p[:, d] > t]]
        parts = below
    return splits


def leaves_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), dtype=np.int64)
    if not splits:
        return node
    dims, cuts = np.array([d for d, _ in splits]), np.array([t for _, t in splits])
    while node[0] < len(splits) if len(node) else False:
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > cuts[node])
    return node - len(splits)


def best(a: np.ndarray, b: np.ndarray, k: int, floor: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of a, row of b, cosine)``: the k best rows of ``b`` for each row of ``a``, none below ``floor``, itself left out."""
    rows, cols, cosines = [], [], []
    step = max(16, CELLS // max(1, len(b)))
    for s in range(0, len(a), step):
        c = a[s:s + step] @ b.T
        if same:
            c[np.arange(len(c)), np.arange(s, s + len(c))] = -2
        if floor > -1:
            i, j = np.nonzero(c >= floor - 1e-6)
            v = c[i, j]
            order = np.lexsort((j, -v, i))
            i, j, v = i[order], j[order], v[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < k
            rows.append(i[keep] + s), cols.append(j[keep]), cosines.append(v[keep])
        elif c.shape[1]:
            n = min(k, c.shape[1])
            j = np.argpartition(-c, n - 1, axis=1)[:, :n]
            v = np.take_along_axis(c, j, axis=1)
            ok = v > -1.5
            rows.append(np.repeat(np.arange(s, s + len(c)), n)[ok.ravel()]), cols.append(j.ravel()[ok.ravel()]), cosines.append(v.ravel()[ok.ravel()])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.array([], dtype=t)
    return join(rows, np.int64), join(cols, np.int64), join(cosines, np.float64)


FOUND = "provider_ns string, block string, slice int, row int, entry_key string, near string, cosine double"
BLOCK = (
    "provider_ns string, block string, leaf long, part long, slice int, n int, keys array<string>, asks binary, units binary, ats binary, reach binary, lo array<float>, hi array<float>, "
    "mine array<int>, near array<string>, cosines array<double>")  # fmt: skip
PROBES = "provider_ns string, target int, part int, block string, slice int, n int, rows array<int>, keys array<string>, units binary, wants binary"


def blocks_of(rows: DataFrame, k: int, floor: float) -> DataFrame:
    """The rows in blocks of the kd-tree, one wide row per slice of a block, with the k best in the own block and the search radius.

    ``rows`` has ``provider_ns, entry_key, unit, at, asks``. A block holds about ``BLOCK_BYTES`` of vectors; leaves with more rows
    are cut by hash. A slice holds ``SLICE_BYTES``: rows of megabytes would fill an executor as they are sorted and written.
    """
    sizes = rows.groupBy("provider_ns").agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("bytes")).collect()  # a row per namespace
    fits = {r["provider_ns"]: max(1, BLOCK_BYTES // r["bytes"]) for r in sizes}
    order = Window.partitionBy("provider_ns").orderBy(F.xxhash64("entry_key"), "entry_key")
    picked = rows.select("provider_ns", "entry_key", "at").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= SAMPLE)
    sample = picked.select("provider_ns", "at").toPandas()
    count = {r["provider_ns"]: r["n"] for r in sizes}
    trees = {}
    for ns, part in sample.groupby("provider_ns"):
        depth = max(0, math.ceil(math.log2(count[ns] / fits[ns])))
        trees[ns] = kd_tree(np.stack(part["at"].to_numpy()), depth)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ns, part in batch.groupby("provider_ns"):
                yield part.assign(leaf=leaves_of(np.stack(part["at"].to_numpy()), trees[ns]), fits=fits[ns])

    placed = materialise(rows.mapInPandas(assign, "provider_ns string, entry_key string, unit binary, at array<float>, asks boolean, leaf long, fits int"))
    parts = placed.groupBy("provider_ns", "leaf").agg(F.ceil(F.count("*") / F.max("fits")).alias("_parts"))
    salted = placed.join(parts, ["provider_ns", "leaf"]).withColumn("_part", F.pmod(F.xxhash64("entry_key"), F.col("_parts"))).withColumn(
        "block", F.concat_ws("/", F.col("leaf").cast("string"), F.col("_part").cast("string"))).drop("_parts", "_part", "fits")
    widest, sliced = math.sqrt(max(0.0, 2 - 2 * floor)), SLICE_BYTES

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("entry_key")
        units = np.frombuffer(b"".join(part.unit), dtype=np.float32).reshape(len(part), -1)
        ats = np.stack(part["at"].to_numpy()).astype(np.float32)
        i, j, c = best(units, units, k, floor, True)
        reach = np.full(len(part), widest, dtype=np.float32)
        full, first, seen = np.unique(i, return_index=True, return_counts=True)
        for r, at in zip(full[seen >= k], first[seen >= k]):
            reach[r] = min(widest, math.sqrt(max(0.0, 2 - 2 * c[at:at + k].min())))
        asks, keys = part["asks"].to_numpy(dtype=bool), part.entry_key.to_numpy()
        leaf, number = map(int, part.block.iloc[0].split("/"))
        whole = {"provider_ns": part.provider_ns.iloc[0], "block": part.block.iloc[0], "leaf": leaf, "part": number, "lo": list(ats.min(axis=0)), "hi": list(ats.max(axis=0))}
        step, out = max(1, sliced // units[0].nbytes), []
        for x in range(0, len(part), step):
            at, ok = slice(x, x + step), asks[i] & (i >= x) & (i < x + step)
            out.append(whole | {
                "slice": x // step, "n": len(keys[at]), "keys": list(keys[at]), "asks": asks[at].tobytes(), "units": units[at].tobytes(), "ats": ats[at].tobytes(), "reach": reach[at].tobytes(),
                "mine": list((i[ok] - x).astype(np.int32)), "near": list(keys[j[ok]]), "cosines": list(c[ok])})
        return pd.DataFrame(out)

    return salted.drop("leaf").groupBy("provider_ns", "block").applyInPandas(pack, BLOCK)


def _probes(wide: DataFrame, boxes: DataFrame, tightened: DataFrame | None) -> DataFrame:
    """The rows that ask blocks of each further group, and which of them, in projected order: without ``tightened`` the nearest ``FIRST``
    blocks of each row, with it all others that the stopping test leaves, by the radius that the rows found so far give
    (``provider_ns, block, slice, rows, reaches``)."""
    scale, first = math.sqrt(chi_square_bound()), tightened is None
    joined = wide.join(F.broadcast(boxes), "provider_ns")
    joined = joined.withColumns({"rows": F.array().cast("array<int>"), "reaches": F.array().cast("array<float>")}) if first else joined.join(tightened, ["provider_ns", "block", "slice"], "left")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ats = np.frombuffer(r.ats, dtype=np.float32).reshape(r.n, -1)
                asks, reach = np.frombuffer(r.asks, dtype=bool), np.frombuffer(r.reach, dtype=np.float32)
                gaps = np.full((r.n, len(r.boxes)), np.inf, dtype=np.float32)
                own = 0
                for b, box in enumerate(r.boxes):
                    if box["block"] != r.block:
                        gaps[:, b] = np.linalg.norm(np.maximum(np.maximum(np.asarray(box["lo"]) - ats, ats - np.asarray(box["hi"])), 0), axis=1)
                    else:
                        own = b
                go = (gaps <= reach[:, None] * scale) & asks[:, None]
                near = np.argsort(gaps, axis=1, kind="stable")[:, :FIRST]
                early = np.zeros_like(go)
                np.put_along_axis(early, near, True, axis=1)
                if first:
                    go &= early
                else:
                    now = reach.copy()
                    if r.rows is not None and len(r.rows):
                        now[np.asarray(r.rows)] = np.minimum(now[np.asarray(r.rows)], np.asarray(r.reaches, dtype=np.float32))
                    go &= ~early & (gaps <= now[:, None] * scale)
                units = np.frombuffer(r.units, dtype=np.float32).reshape(r.n, -1)
                keys = np.asarray(r.keys)
                for g in range(0, len(r.boxes), GROUPED):
                    wants = go[:, g:g + GROUPED]
                    at = np.flatnonzero(wants.any(axis=1))
                    if len(at):
                        yield pd.DataFrame([{"provider_ns": r.provider_ns, "target": g // GROUPED, "part": own // GROUPED, "block": r.block, "slice": r.slice, "n": len(at),
                                             "rows": at.astype(np.int32), "keys": keys[at], "units": units[at].tobytes(), "wants": wants[at].tobytes()}])

    return joined.select("provider_ns", "block", "slice", "n", "keys", "asks", "units", "ats", "reach", "boxes", "rows", "reaches").mapInPandas(route, PROBES)


def _verified(probes: DataFrame, wide: DataFrame, boxes: DataFrame, k: int, floor: float) -> DataFrame:
    """The k best rows of each target block for each row that asks it, by true cosines.

    What meets in a task is bounded: ``GROUPED`` blocks that are asked, and the asking rows of as many.
    """
    probes, key = materialise(probes), ["provider_ns", "target", "part"]
    groups = boxes.select("provider_ns", F.posexplode("boxes").alias("_i", "_b")).select(
        "provider_ns", F.col("_b.block").alias("block"), F.floor(F.col("_i") / GROUPED).cast("int").alias("target"), (F.col("_i") % GROUPED).alias("spot"))
    asked = probes.select("provider_ns", "target", "part").distinct().join(F.broadcast(groups), ["provider_ns", "target"])
    targets = wide.select("provider_ns", "block", "slice", "n", "keys", "units").join(asked, ["provider_ns", "block"])
    targets = targets.select(*[F.col(x).alias(x) for x in key], "spot", "slice", "n", "keys", "units")

    def verify(asking: pa.Table, target: pa.Table) -> pa.Table:
        kinds = pa.schema([("provider_ns", pa.string()), ("block", pa.string()), ("slice", pa.int32()), ("row", pa.int32()), ("entry_key", pa.string()), ("near", pa.string()), ("cosine", pa.float64())])
        out = [kinds.empty_table()]
        floats = lambda x: np.frombuffer(x.as_buffer(), dtype=np.float32)
        for spot in pc.unique(target["spot"]).to_pylist():
            one = target.filter(pc.equal(target["spot"], spot)).sort_by("slice")
            v = np.concatenate([floats(x) for x in one["units"]]).reshape(pc.sum(one["n"]).as_py(), -1)
            near = pa.chunked_array([pc.list_flatten(x) for x in one["keys"].chunks]).combine_chunks()
            for units, wants, n, rows, keys, ns, block, part in zip(*(asking[x] for x in ("units", "wants", "n", "rows", "keys", "provider_ns", "block", "slice"))):
                at = np.flatnonzero(np.frombuffer(wants.as_buffer(), dtype=bool).reshape(n.as_py(), -1)[:, spot])
                i, j, c = best(floats(units).reshape(n.as_py(), -1)[at], v, k, floor, False)
                if len(i):
                    i = pa.array(at[i])
                    out.append(pa.table([pa.repeat(ns, len(i)), pa.repeat(block, len(i)), pa.repeat(part, len(i)), rows.values.take(i), keys.values.take(i), near.take(pa.array(j)), pa.array(c)], schema=kinds))
        return pa.concat_tables(out)

    return probes.groupBy(*key).cogroup(targets.groupBy(*key)).applyInArrow(verify, FOUND)


def most_similar(rows: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """``provider_ns, entry_key, near, cosine``: the k most similar rows of each asking row, of a cosine of ``floor`` at least.

    ``rows`` comes from :func:`usable`, with a column ``asks``. Ties go to the lesser key. The search is incremental: own block, then
    the nearest blocks in the projection, then, by the radius that those leave, the rest until the stopping test holds. Only
    rows that still ask are sent. ``boxes``, which every task gets, is a row of bounds for each ``BLOCK_BYTES`` of vectors, neighbours side by side.
    """
    blocks = materialise(blocks_of(rows, k, floor))
    boxes = blocks.filter("slice = 0").groupBy("provider_ns").agg(F.array_sort(F.collect_list(F.struct("leaf", "part", "block", "lo", "hi"))).alias("boxes"))
    own = blocks.select("provider_ns", "block", "slice", "keys", F.explode(F.arrays_zip("mine", "near", "cosines")).alias("x")).select(
        "provider_ns", "block", "slice", F.col("x.mine").alias("row"), F.get("keys", F.col("x.mine")).alias("entry_key"), "x.near", F.col("x.cosines").alias("cosine"))
    wide = blocks.drop("mine", "near", "cosines")
    order = Window.partitionBy("provider_ns", "entry_key").orderBy(F.desc("cosine"), "near")
    top = lambda df: df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    first = materialise(top(own.unionByName(_verified(_probes(wide, boxes, None), wide, boxes, k, floor))))
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).cast("float")
    last = first.filter(F.col("_r") == k).groupBy("provider_ns", "block", "slice").agg(F.collect_list(F.struct("row", reach.alias("reach"))).alias("_l"))
    tightened = last.select("provider_ns", "block", "slice", F.col("_l.row").alias("rows"), F.col("_l.reach").alias("reaches"))
    further = _verified(_probes(wide, boxes, tightened), wide, boxes, k, floor)
    return top(first.drop("_r").unionByName(further)).select("provider_ns", "entry_key", "near", "cosine")


def with_copies(rows: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """As :func:`most_similar`, with equal vectors searched once.

    Entries with the same vector are one class. A class's search result holds for its members; among themselves members
    see the least ``k`` keys of their class, at cosine 1. So a vector that a third of all entries share costs one search,
    and no list of all its pairs.
    """
    keyed = materialise(rows.withColumns({"_v": F.xxhash64("unit"), "_w": F.xxhash64(F.lit(1), "unit"), "_salt": _salt("entry_key")}))
    rep = materialise(keyed.groupBy("provider_ns", "_v", "_w").agg(
        F.min("entry_key").alias("_rep"), F.min(F.struct("unit", "at")).alias("u"), F.bool_or("asks").alias("asks"), F.count("*").alias("_n")))
    classes = _salted(rep.select("provider_ns", "_v", "_w", "_rep", "_n"))
    members = materialise(keyed.join(classes, ["provider_ns", "_v", "_w", "_salt"]).select("provider_ns", "entry_key", "asks", "_rep", "_n", "_salt"))
    rep = rep.select("provider_ns", "_rep", "u.*", "asks")
    found = most_similar(rep.select("provider_ns", F.col("_rep").alias("entry_key"), "unit", "at", "asks"), k, floor)
    salt = Window.partitionBy("provider_ns", "_rep", "_salt").orderBy("entry_key")
    whole = Window.partitionBy("provider_ns", "_rep").orderBy("entry_key")
    several = members.filter("_n > 1")
    least = several.withColumn("_r", F.row_number().over(salt)).filter(F.col("_r") <= k + 1).withColumn(
        "_r", F.row_number().over(whole)).filter(F.col("_r") <= k + 1).select("provider_ns", "_rep", F.col("entry_key").alias("near"))
    inside = several.filter("asks").join(_salted(least), ["provider_ns", "_rep", "_salt"]).filter("near <> entry_key").select("provider_ns", "entry_key", "near", F.lit(1.0).alias("cosine"))
    found = found.withColumnsRenamed({"entry_key": "_rep", "near": "_near"})
    shared = found.join(least.withColumnRenamed("_rep", "_near"), ["provider_ns", "_near"], "left").withColumn("near", F.coalesce("near", "_near"))
    outside = members.filter("asks").join(_salted(shared), ["provider_ns", "_rep", "_salt"]).select("provider_ns", "entry_key", "near", "cosine")
    order = Window.partitionBy("provider_ns", "entry_key").orderBy(F.desc(F.round("cosine", 6)), "near")
    return inside.unionByName(outside).distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def _salt(key: str) -> Column:
    """The part of a class that a member belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    """A row for each part of a class, to meet the members that are split by it."""
    return df.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
