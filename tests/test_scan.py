"""Scans and chains over keys that fill several partitions, against loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from findweave.operators import intervals, scan


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows(seed: int, n: int, hot: float):
    rnd = random.Random(seed)
    return [(i, None if rnd.random() < hot else rnd.choice(["a", "b", "", "c"]), rnd.randint(0, 80), rnd.choice([None, None, None, rnd.randint(0, 9)])) for i in range(n)]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("hot", [0.0, 0.9, 1.0])
def test_last_value_is_carried_over_partitions(many_parts, hot, inclusive):
    rows = _rows(3, 400, hot)
    df = many_parts.createDataFrame(rows, "id int, k string, at int, v int")
    sorted_ = scan.numbered(df, ["k"], [F.col("at"), F.col("id")])
    got = {r["id"]: r["w"] for r in scan.last_before(sorted_, F.col("v"), "w", inclusive).collect()}
    want, last = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        if inclusive and v is not None:
            last[k] = v
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want
    assert hot == 0 or sorted_.where("k IS NULL").select(scan.PART).distinct().count() > 4  # one key, several tasks


def test_sparse_values_cross_whole_partitions(many_parts):
    df = many_parts.range(500).select(F.lit("one").alias("k"), F.col("id"), F.when(F.col("id") == 3, F.lit(7)).alias("v"))
    got = scan.last_before(scan.numbered(df, ["k"], [F.col("id")]), F.col("v"), "w")
    assert got.where("w = 7").count() == 496 and got.where("w IS NULL").count() == 4


def test_chains(many_parts):
    rnd = random.Random(1)
    follow = {i: (i + rnd.randint(1, 3) if i < 990 else None) for i in range(1000)}
    df = many_parts.createDataFrame([(i, j, i in (0, 500)) for i, j in follow.items()], "n long, f long, first boolean")
    want = set()
    for i in (0, 500):
        while i is not None:
            want.add(i)
            i = follow[i]
    got = [r["n"] for r in scan.reached(df, "n", "f", "first").collect()]
    assert sorted(got) == sorted(want)
    assert scan.reached(df.where("false"), "n", "f", "first").count() == 0


@pytest.mark.parametrize(("hot", "long_key"), [(0.2, 0), (0.2, 200), (0.8, 10_000), (1.0, 0)])
def test_greedy_clusters_and_siblings_of_a_hot_key(many_parts, hot, long_key):
    rnd = random.Random(9)
    rows = [(i, None if rnd.random() < hot else "b", s := rnd.randint(0, 900), s + rnd.randint(0, 12)) for i in range(500)]
    df = many_parts.createDataFrame(rows, "id int, k string, s int, e int")
    kept, last, clusters = set(), {}, {}
    for i, k, s, e in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or s > last[k]:
            kept.add(i)
            last[k] = e
        mine = clusters.setdefault(k, [])
        if mine and s - mine[-1][0] <= 25:
            mine[-1] = (mine[-1][0], s, mine[-1][2] + 1)
        else:
            mine.append((s, s, 1))
    assert {r["id"] for r in intervals.greedy_disjoint(df, ["k"], [F.col("s"), F.col("id")], "s", "e", ["id"], long_key).collect()} == kept
    got = intervals.anchored_clusters(df, ["k"], "s", 25, long_key).collect()
    assert sorted((str(r["k"]), r["first"], r["last"], r["n"]) for r in got) == sorted((str(k), *c) for k, cs in clusters.items() for c in cs)
    if hot == 0.2 and long_key:
        return
    near = {r["id"]: (r["previous_id"], r["next_id"]) for r in intervals.nearest_siblings(df, ["k"], "id", "s", "e").collect()}
    for i, k, s, e in rows:
        before = max(((e2, j) for j, k2, _, e2 in rows if k2 == k and e2 < s), default=(None, None))[1]
        after = min(((s2, j) for j, k2, s2, _ in rows if k2 == k and s2 > e), default=(None, None))[1]
        assert near[i] == (before, after)
