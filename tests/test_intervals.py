from __future__ import annotations

import random
from collections import Counter

import pytest

from quern.operators import intervals


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.choice([rng.randint(-300, 300), 0, 10**12])
        out.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([None, s, s, s, s]), s + rng.choice([0, 1, 1, 2, 7, 64, 65, 1000, 10**7, -5]), rng.randint(0, 3)))
    return out + out[:5]


def overlap(left, right):
    return Counter((a, b) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])


@pytest.mark.parametrize("cell_rows", [20_000, 3])
def test_overlaps_equal_all_pairs(spark, cell_rows):
    a, b = rows(120, 1), rows(90, 2)
    schema = "k string, s long, e long, tag int"
    left, right = spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(2)
    met = intervals.overlapping(left, right, ["k"], ("s", "e"), ("s", "e"), cell_rows)
    assert Counter((tuple(r["left"]), tuple(r["right"])) for r in met.collect()) == overlap(a, b)


def test_overlaps_of_nothing_and_plan(spark):
    df = spark.createDataFrame(rows(20, 3), "k string, s long, e long, tag int")
    assert intervals.overlapping(df, df.where("false"), ["k"], ("s", "e"), ("s", "e")).count() == 0
    plan = intervals.overlapping(df, df, ["k"], ("s", "e"), ("s", "e"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    without_keys = intervals.overlapping(df, df, [], ("s", "e"), ("s", "e")).count()
    ok = [r for r in rows(20, 3) if r[1] is not None and r[1] < r[2]]
    assert without_keys == sum(a[1] < b[2] and b[1] < a[2] for a in ok for b in ok)
