import random

import numpy as np
import pytest

from ctxspark.llm import mixing, packing, sizes


@pytest.mark.parametrize("capacity", [1, 10, 64, 512, 2048])
def test_plan_holds_every_item_once(capacity):
    rng = random.Random(capacity)
    for shape in range(4):
        hist = {}
        for _ in range([0, 1, 50, 3000][shape]):
            n = min(capacity, max(1, int(rng.expovariate(3 / capacity))))
            hist[n] = hist.get(n, 0) + rng.choice([1, 1, 40])
        plan = packing.plan(hist, capacity)
        got = {}
        for lengths, often in plan:
            assert lengths and sum(lengths) <= capacity and often > 0
            for n in lengths:
                got[n] = got.get(n, 0) + often
        assert got == hist
        if shape == 3 and capacity >= 64:
            used = sum(n * c for n, c in hist.items())
            assert sum(o for _, o in plan) <= 1.03 * used / capacity + 1


@pytest.mark.parametrize("capacity", [64, 512, 2048])
def test_least_squares_fill_as_well_as_the_greedy_packing(capacity):
    rng, hist = random.Random(capacity), {}
    for _ in range(4000):
        n = min(capacity, max(1, int(rng.lognormvariate(4.5, 1))))
        hist[n] = hist.get(n, 0) + 1
    count = lambda plan: sum(n for _, n in plan)
    assert count(packing.plan(hist, capacity)) <= count(packing.greedy_plan(hist, [], capacity))
    opened = packing.opened_by_squares(hist, capacity, packing.DEPTHS[0])
    assert opened and all(capacity - capacity // packing.WINDOW <= sum(x) <= capacity for x, _ in opened)


def test_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 8)), np.array([0, 2, 0, 1, 5, 0, 0, 3.0])
    assert np.allclose(packing.non_negative_least_squares(a, a @ x), x, atol=1e-6)


def test_the_driver_plans_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, 1 + i % 40) for i in range(200)], "doc_id long, tokens long")
    limits = spark.createDataFrame([(1, 50), (2, 64)], "limit_id int, capacity_tokens int")
    monkeypatch.setattr(packing, "plan", None)
    rows = packing.packed(items, limits).collect()
    assert len(rows) == 400 and {(r.doc_id, r.tokens) for r in rows} == {(r.doc_id, r.tokens) for r in items.collect()}


def test_slots_are_not_broadcast(spark):
    items = spark.createDataFrame([(i, 3) for i in range(50)], "doc_id long, tokens long")
    limits = spark.createDataFrame([(1, 10)], "limit_id int, capacity_tokens int")
    plan = packing.packed(items, limits)._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin" in x and "_rank" in x for x in plan.splitlines())


def test_packed(spark):
    items = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 5, 7, 3, 25, 10, 0, 1, 9] + [4] * 50)], "doc_id long, tokens long")
    limits = spark.createDataFrame([(1, 10), (2, 100)], "limit_id int, capacity_tokens int")
    rows = packing.packed(items, limits).collect()
    for limit, cap in ((1, 10), (2, 100)):
        mine = [r for r in rows if r.limit_id == limit]
        fill = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        total = {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        assert total == {r.doc_id: r.tokens for r in items.collect() if r.tokens}
        assert len([r for r in mine if r.doc_id == 5]) == (3 if cap == 10 else 1)
    assert packing.packed(items.limit(0), limits).count() == 0 and packing.packed(items, limits.limit(0)).count() == 0


DOC = "doc_id long, text string, source string, tokens string"


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "a", "clash"), (2, None, "a", "x"), (3, "", "a", "x"), (4, "a\r\nb", "b", "x"), (5, "a\nb", "b", "x"), (1, "hello world", "a", "x")], DOC)
    got = {r.doc_id: (r.tokens, r.text_id) for r in sizes.sized(df).collect()}
    assert set(got) == {1, 4, 5} and got[1][0] == 2 and got[4][1] == got[5][1]


def test_shares_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices("abcz", [60, 30, 9, 1])[0], f"t{i}", rng.randint(1, 200)) for i in range(4000)] + [(9000, "b", "t0", 10), (9001, None, "t9", 10)]
    items = mixing.once_per_text(spark.createDataFrame(rows, "doc_id long, source string, text_id string, tokens long"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 3), ("off", None, 2)], "source string, target_share double, max_repeats int")
    taken = mixing.drawn(items, targets)
    got = taken.collect()
    most = {"a": 1, "b": 2, "c": 4}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.draws <= most[r.source] for r in got) and 9000 not in {r.doc_id for r in got}
    share = {r.source: r.share for r in mixing.shares(taken, targets).collect()}
    assert abs(share["a"] - 0.5) < 0.004 and abs(share["b"] - 0.3) < 0.004 and abs(share["c"] - 0.2) < 0.004 and share["gone"] == 0
    assert mixing.drawn(items.limit(0), targets).count() == 0 and mixing.drawn(items, targets.limit(0)).count() == 0


def test_copies_outside_the_targets_hide_no_text(spark):
    items = spark.createDataFrame([(1, None, "t", 5), (2, "z", "t", 5), (3, "a", "t", 5), (4, "a", "u", 5)], "doc_id long, source string, text_id string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")
    assert sorted(r.doc_id for r in mixing.once_per_text(items, targets).collect()) == [3, 4]
