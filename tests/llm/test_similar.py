import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.llm import similar

ENTRY = "repo_id string, cache_version int, provider_ns string, entry_key string, vector array<double>, unit string"


def table(spark, vectors, ns="n"):
    rows = [("r", 2, ns, hashlib.sha256(str(i).encode()).hexdigest(), v, "clash") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, ENTRY), {r[3]: r[4] for r in rows}


def brute(vectors, k):
    keys = sorted(vectors)
    m = np.array([vectors[x] for x in keys], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T
    np.fill_diagonal(c, -2)
    order = np.argsort(-c.round(6), axis=1, kind="stable")[:, :k]
    return {keys[i]: {keys[j]: c[i, j] for j in order[i]} for i in range(len(keys))}


@pytest.mark.parametrize("rows_per_block", [30, 50, 8192])
def test_against_brute_force(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(similar, "BLOCK_BYTES", rows_per_block * 24 * 4)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24))
    vectors = np.concatenate([base, base[:60] + 0.2 * rng.standard_normal((60, 24)), base[:20] * 7.5])
    df, by_key = table(spark, vectors.tolist())
    dims = spark.createDataFrame([("n", 24)], "provider_ns string, dims int")
    rows = similar.usable(df, dims).withColumn("asks", F.lit(True))
    want = brute(by_key, 5)
    near = {}
    for r in similar.with_copies(rows, 5, 0.85).collect():
        near.setdefault(r.entry_key, {})[r.near] = r.cosine
    assert {(a, b) for a, x in near.items() for b in x} == {(a, b) for a, x in want.items() for b, c in x.items() if c >= 0.85}
    full = {}
    for r in similar.with_copies(rows, 5).collect():
        full.setdefault(r.entry_key, set()).add(r.near)
    assert sum(len(full[k] & set(want[k])) for k in want) / (5 * len(want)) >= 0.95


def test_rows_that_are_sent_are_small(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_BYTES", 50 * 24 * 4)
    monkeypatch.setattr(similar, "SLICE_BYTES", 7 * 24 * 4, raising=False)
    monkeypatch.setattr(similar, "GROUPED", 2)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 24))
    df, by_key = table(spark, np.concatenate([base, base[:60] + 0.2 * rng.standard_normal((60, 24))]).tolist())
    rows = similar.usable(df, spark.createDataFrame([("n", 24)], "provider_ns string, dims int")).withColumn("asks", F.lit(True))
    blocks = similar.blocks_of(rows, 5, 0.85)
    assert blocks.agg(F.max(F.octet_length("units"))).first()[0] <= 7 * 24 * 4 and blocks.agg(F.sum("n")).first()[0] == 360
    want = {(a, b) for a, x in brute(by_key, 5).items() for b, c in x.items() if c >= 0.85}
    assert want and {(r.entry_key, r.near) for r in similar.with_copies(rows, 5, 0.85).collect()} == want


def test_unusable_entries_and_copies(spark):
    v = [1.0, 2.0]
    rows = [("r", 2, "n", k, x, "c") for k, x in (("a", v), ("b", v), ("c", v), ("d", [0.0, 0.0]), ("e", [float("nan"), 1.0]), ("f", [1.0]), ("g", None), ("h", [float("inf"), 1.0]), ("i", [1.0, None]), ("a", v))]
    rows += [("r", 1, "n", "old", v, "c"), ("r", 2, "other", "z", v, "c"), ("r", 2, None, "y", v, "c"), ("r", 2, "n", None, v, "c")]
    dims = spark.createDataFrame([("n", 2), ("other", 2)], "provider_ns string, dims int")
    near = similar.with_copies(similar.usable(spark.createDataFrame(rows, ENTRY), dims).withColumn("asks", F.lit(True)), 2)
    assert sorted((r.entry_key, r.near) for r in near.collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert similar.with_copies(similar.usable(spark.createDataFrame([], ENTRY), dims).withColumn("asks", F.lit(True)), 2).count() == 0


def test_one_vector_held_by_many(spark):
    df, _ = table(spark, [[1.0, 0.0, 0.0]] * 200 + [[0.99, 0.1, 0.0], [0.0, 1.0, 0.0]])
    dims = spark.createDataFrame([("n", 3)], "provider_ns string, dims int")
    got = similar.with_copies(similar.usable(df, dims).withColumn("asks", F.lit(True)), 5).groupBy("entry_key").count().collect()
    assert len(got) == 202 and all(r["count"] == 5 for r in got)


def test_chi_square_bound():
    draws = (np.random.default_rng(0).standard_normal((200_000, similar.PROJECTED)) ** 2).sum(axis=1)
    assert 0.998 < (draws <= similar.chi_square_bound()).mean() < 0.9997
