"""Problem 6: items into containers of fixed capacity, with little space left over.

Only the histogram of lengths, which has no more entries than the capacity, is planned on: non-negative least squares gives how often
each shallow combination of length classes that fills a container should be repeated; what rounding and exact lengths leave is packed
greedily, longest first, into the least space that takes it. The plan says which lengths go together and how often; documents
are then matched to its slots by their rank among the documents of their length, in parallel.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxspark.session import materialise

#: Length classes of the least-squares step, and the depths of the combinations it enumerates, in the order they are tried.
CLASSES, DEPTHS = 32, (3, 2)
#: Containers of the least-squares step leave at most this part of the capacity.
WINDOW = 1000
#: Rows of one length in one task, about; and slots in one run of equal containers, as they are spread.
SALT_ROWS, RUN = 50_000, 4096

Plan = list[tuple[tuple[int, ...], int]]


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[idx] = s
                break
            low = s <= 0
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-12))
            x[idx] += step * (s - x[idx])
            active[idx[x[idx] <= 1e-12]] = False
            x[~active] = 0
    return x


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` classes (by their upper ends) that fill the last class-wide window of a container."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for c in range(1, min(left, head[-1] if head else classes) + 1):
                extend((*head, c), left - c)

    extend((), classes)
    return out


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """``(lengths of a container, how often)`` for all items of the histogram; every length is 1 to ``capacity``.

    Least squares and then the greedy packing of what they leave, by the first of ``DEPTHS`` with which no more containers are
    needed than by the greedy packing alone: deep combinations may use up short items that the rest needs.
    """
    alone = greedy_plan(histogram, [], capacity)
    for depth in DEPTHS:
        solved = solved_plan(histogram, capacity, depth)
        if sum(n for _, n in solved) <= sum(n for _, n in alone):
            return solved
    return alone


def solved_plan(histogram: dict[int, int], capacity: int, depth: int) -> Plan:
    """The plan with the least-squares step over combinations of up to ``depth`` lengths."""
    left = dict(histogram)
    opened = opened_by_squares(histogram, capacity, depth)
    for lengths, often in opened:
        for n in lengths:
            left[n] -= often
    return greedy_plan(left, opened, capacity)


def opened_by_squares(histogram: dict[int, int], capacity: int, depth: int) -> Plan:
    """The containers that least squares fill.

    The repeat counts of combinations of length classes are solved against the histogram and rounded down. A combination's
    containers take the lengths of its classes but for the last, which is the longest one at hand that fits; it has to fill
    the window below the capacity.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    opened: Plan = []
    if capacity >= CLASSES:
        demand = np.zeros(CLASSES)
        lengths: dict[int, list[int]] = defaultdict(list)
        for n in sorted(left, reverse=True):
            k = min(CLASSES, -(-n * CLASSES // capacity))
            demand[k - 1] += left[n]
            lengths[k].append(n)
        every = sorted(left)
        mixes = [m for m in combinations(CLASSES, depth) if min(m) > 1 or len(m) == 1]
        a = np.zeros((CLASSES, len(mixes)))
        for j, m in enumerate(mixes):
            for k in m:
                a[k - 1, j] += 1
        weight = np.arange(1, CLASSES + 1) / CLASSES
        counts = np.floor(non_negative_least_squares(a * weight[:, None], demand * weight) + 1e-9).astype(int).tolist()
        for m, times in sorted(zip(mixes, counts), reverse=True):
            while times > 0:
                taken: dict[int, int] = defaultdict(int)
                for k in m[:-1]:
                    n = next((n for n in lengths[k] if left.get(n, 0) > taken[n]), 0)
                    if not n:
                        break
                    taken[n] += 1
                room = capacity - sum(n * t for n, t in taken.items())
                fits = (every[i] for i in range(bisect_right(every, room) - 1, -1, -1))
                last = next((n for n in fits if n < room - capacity // WINDOW or left[n] > taken.get(n, 0)), 0)
                if sum(taken.values()) < len(m) - 1 or last < max(1, room - capacity // WINDOW):
                    break
                taken[last] += 1
                taken = {n: t for n, t in taken.items() if t}
                often = min([times, *(left[n] // t for n, t in taken.items())])
                for n, t in taken.items():
                    left[n] -= often * t
                opened.append((tuple(n for n, t in sorted(taken.items(), reverse=True) for _ in range(t)), int(often)))
                times -= often
    return opened


def greedy_plan(left: dict[int, int], opened: Plan, capacity: int) -> Plan:
    """``opened`` containers and new ones with the items of ``left``, longest first, each into the least space that takes it."""
    space: dict[int, Plan] = defaultdict(list)
    done: Plan = []
    for lengths_, often in opened:
        space[capacity - sum(lengths_)].append((lengths_, often))
    done += space.pop(0, [])
    spaces = sorted(space)
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count > 0:
            i = int(np.searchsorted(spaces, n)) if spaces else 0
            if i < len(spaces):
                at = spaces[i]
                head, often = space[at].pop()
                if not space[at]:
                    del space[at]
                    spaces.pop(i)
            else:
                # as many of one length as a container takes, so that a long run of equal lengths makes one pattern
                each = min(capacity // n, count)
                head, often, at = (n,) * (each - 1), count // each, capacity - n * (each - 1)
                count -= often * (each - 1)
            use = min(count, often)
            parts = [((*head, n), use, at - n)] + ([(head, often - use, at)] if often > use else [])
            count -= use
            for what, times, rest in parts:
                if rest == 0:
                    done.append((what, times))
                    continue
                if rest not in space:
                    spaces.insert(int(np.searchsorted(spaces, rest)), rest)
                space[rest].append((what, times))
    return done + [x for at in spaces for x in space[at]]


SLOTS = "limit_id int, size int, first long, often long, times int, base long"


def _slots(histogram: pd.DataFrame) -> pd.DataFrame:
    """The patterns of one limit (``limit_id, _cap, size, n``), a row for each length in each.

    A pattern holds the length ``times`` in each of its ``often`` containers, the first of which is ``base``, and takes the items of that
    length from rank ``first`` on.
    """
    limit_id, base, taken, slots = int(histogram.limit_id.iloc[0]), 0, defaultdict(int), []
    histogram = histogram.sort_values("size")  # the plan doesn't depend on the order in which rows arrive
    for lengths, often in plan(dict(zip(histogram["size"].tolist(), histogram.n.tolist())), int(histogram["_cap"].iloc[0])):
        for n, times in Counter(lengths).items():
            slots.append((limit_id, n, taken[n], often, times, base))
            taken[n] += often * times
        base += often
    return pd.DataFrame(slots, columns=[x.split()[0] for x in SLOTS.split(", ")])


def packed(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_id, doc_id, piece, tokens, container``: every item, in a container of every limit.

    ``items`` has ``doc_id, tokens``; an item above the capacity is cut into full pieces, each a container of its own, and
    a rest that is packed like an item. ``limits`` (``limit_id, capacity_tokens``) is a fixed small table. Repeated doc_ids,
    and items of no tokens, come in once and not at all. A limit's histogram, of at most ``capacity`` rows, meets in one task, which plans
    patterns with their counts, whose number depends on the lengths only. The driver gets the largest count and nothing else.
    """
    bounds = limits.filter("capacity_tokens > 0").select("limit_id", F.col("capacity_tokens").alias("_cap")).distinct()
    last = F.floor((F.col("tokens") - 1) / F.col("_cap")).cast("int")
    parts = items.filter("tokens > 0").select("doc_id", "tokens").join(F.broadcast(bounds)).select(
        "limit_id", "doc_id", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "tokens", "_cap").select(
        "limit_id", "_cap", "doc_id", "piece", F.least(F.col("_cap"), F.col("tokens") - F.col("piece").cast("long") * F.col("_cap")).cast("int").alias("size"))
    counts = materialise(parts.groupBy("limit_id", "_cap", "size").agg(F.count("*").alias("n")))  # the histograms
    salts = 1 + (counts.agg(F.max("n")).first()[0] or 0) // SALT_ROWS
    patterns = materialise(counts.groupBy("limit_id", "_cap").applyInPandas(_slots, SLOTS))
    # a pattern's containers fall into runs, and those into single slots, on the cluster
    runs = patterns.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("often") * F.col("times") - 1).cast("long"), F.lit(RUN).cast("long"))).alias("_run")).repartition("limit_id", "size", "_run")
    upto = F.least(F.col("_run") + RUN, F.col("often") * F.col("times")) - 1
    each = runs.select("limit_id", "size", "first", "times", "base", F.explode(F.sequence(F.col("_run"), upto)).alias("_i")).select(
        "limit_id", "size", (F.col("first") + F.col("_i")).alias("_rank"), (F.col("base") + F.floor(F.col("_i") / F.col("times"))).alias("container"))
    salted = parts.drop("_cap").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("limit_id", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("limit_id", "size", "_salt").agg(F.count("*").alias("n")).withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("limit_id", "size", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_rank", rank).join(offsets, ["limit_id", "size", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    # the runs are few and the slots as many as the items, so Spark's size check would broadcast them through the driver
    return ranked.join(each.hint("merge"), ["limit_id", "size", "_rank"]).select("limit_id", "doc_id", "piece", F.col("size").alias("tokens"), "container")


def planned_fill(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_id, by_squares, greedy_containers``: the items that least squares place, and the containers that the greedy packing
    alone would need. A limit's histogram, of at most ``capacity_tokens`` rows, meets in one task."""
    rows = items.filter("tokens > 0").join(F.broadcast(limits.filter("capacity_tokens > 0").distinct()))
    over = F.floor((F.col("tokens") - 1) / F.col("capacity_tokens"))
    rest = rows.groupBy("limit_id", (F.pmod(F.col("tokens") - 1, F.col("capacity_tokens")) + 1).cast("int").alias("size")).agg(F.count("*").alias("n"), F.sum(over).alias("full"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        cap, histogram = int(part.capacity_tokens.iloc[0]), dict(zip(part["size"].tolist(), part.n.tolist()))
        need = lambda x: sum(n for _, n in x)
        alone = need(greedy_plan(histogram, [], cap))
        depth = next((x for x in DEPTHS if need(solved_plan(histogram, cap, x)) <= alone), None)
        placed = sum(len(x) * n for x, n in opened_by_squares(histogram, cap, depth)) if depth else 0
        return pd.DataFrame([(int(part.limit_id.iloc[0]), placed, int(part.full.sum()) + alone)])

    return rest.join(F.broadcast(limits), "limit_id").groupBy("limit_id").applyInPandas(compare, "limit_id int, by_squares long, greedy_containers long")
