"""Mirrored changes and one-to-one pairing: three cases by hand, and greedy matching on random data."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pairing as P


def test_separate_reprices_stay_and_twins_are_one(spark):
    rows = []
    for second in range(0, 42, 2):
        a = 0.5 if second < 10 else 0.7 if second < 28 else 0.4
        rows += [(1000 + second, "m", "A", a), (1000 + second, "m", "B", 1 - a)]
    rows += [(1000 + s, "n", "A", 0.2 if s < 20 else 0.9) for s in range(0, 42, 2)]
    got = P.price_jumps(spark.createDataFrame(rows, "t long, market string, outcome string, mid double"), ["market"], "outcome", "t", "mid", 0.08)
    assert sorted((r["market"], r["t"], r["outcomes"], round(r["delta"], 6), r["positive_outcome"]) for r in got.collect()) == [("m", 1010, 2, 0.2, "A"), ("m", 1028, 2, 0.3, "B"), ("n", 1020, 1, 0.7, "A")]


def test_changes_that_do_not_mirror_are_rows(spark):
    rows = [(t, "m", o, (0.1 if t else 0.5) if o != "C" else 0.9 * t) for t in (0, 1) for o in "ABC"]
    got = P.price_jumps(spark.createDataFrame(rows, "t long, market string, outcome string, mid double"), ["market"], "outcome", "t", "mid", 0.08)
    assert sorted(((r["outcomes"], round(r["delta"], 6), r["positive_outcome"]) for r in got.collect()), key=str) == [(1, -0.4, None), (1, -0.4, None), (1, 0.9, "C")]


def _pairs(spark, left, right, width):
    schema = "key long, t long, n long"
    got = P.pair_one_to_one(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["key"], "t", "n", width)
    return sorted((r["key"], r["left_n"], r["right_n"]) for r in got.collect())


def test_pairing_is_one_to_one(spark):
    assert _pairs(spark, [(1, 100, 1), (1, 110, 2)], [(1, 101, 1), (1, 111, 2), (1, 112, 3)], 5) == [(1, 1, 1), (1, 2, 2)]


def test_pairing_needs_the_same_side(spark):
    """The side is a part of the key."""
    assert _pairs(spark, [(7, 100, 1)], [(8, 101, 1), (7, 102, 2)], 5) == [(7, 1, 2)]
    assert _pairs(spark, [], [(7, 102, 2)], 5) == [] == _pairs(spark, [(7, 102, 2)], [], 5)


def greedy(left, right, width):
    """All candidate pairs by distance."""
    at = lambda rows: {n: (k, t) for k, t, n in rows}
    every = sorted((abs(t - u), t, n, u, m, k) for k, t, n in left for j, u, m in right if j == k and abs(t - u) <= width)
    used_l, used_r, out = set(), set(), []
    for _, _, n, _, m, k in every:
        if n not in used_l and m not in used_r:
            used_l.add(n)
            used_r.add(m)
            out.append((k, n, m))
    assert at(left) and at(right)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_equals_greedy_matching(spark, seed):
    """Ties, rows of one instant and dense keys among them."""
    r = random.Random(seed)
    side = lambda n: [(r.randrange(3), r.randrange(120 if seed == 1 else 2000), i) for i in range(n)]
    left, right = side(90), side(120)
    assert _pairs(spark, left, right, 15) == greedy(left, right, 15)


def test_every_fold_has_a_row(spark, tmp_path):
    """Folds go on as long as the days do (50 of them here)."""
    from tidemark.plans import registry

    days = spark.range(0, 720 + 50 * 180, 3)
    days.select((F.col("id") + 1).alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("o_orderdate"), F.lit("x").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["M01_fixed_step_folds"](spark, str(tmp_path)).collect()
    assert max(r["fold"] for r in got) == 49 and all(r["test"] == 60 for r in got) and len(got) > 40
