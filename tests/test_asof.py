"""As-of joins and windows against brute force on small frames with ties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.operators.asof import asof, asof_bucketed


def _rows(n, seed):
    r = random.Random(seed)
    return [(r.randrange(3), r.randrange(20), i, r.randrange(100)) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "key long, us long, seq long, v long")


@pytest.mark.parametrize(("direction", "strict"), list(itertools.product(("backward", "forward"), (False, True))))
def test_asof_equals_brute_force(spark, direction, strict):
    facts, probes = _rows(40, 1), _rows(30, 2)
    got = {r["seq"]: (r["f_seq"], r["f_v"]) for r in asof(_frame(spark, probes), _frame(spark, facts), ["key"], "us", ["v"], direction=direction, strict=strict).collect()}
    for key, us, seq, _ in probes:
        ok = [f for f in facts if f[0] == key and (f[1] < us or f[1] == us and not strict if direction == "backward" else f[1] > us or f[1] == us and not strict)]
        best = (max if direction == "backward" else min)(ok, key=lambda f: (f[1], f[2]), default=None)
        assert got[seq] == ((best[2], best[3]) if best else (None, None))


def test_asof_tolerance_and_hot_key_form(spark):
    facts, probes = _frame(spark, _rows(60, 3)), _frame(spark, _rows(40, 4))
    plain = asof(probes, facts, ["key"], "us", ["v"]).select("seq", "f_seq", "f_v")
    assert plain.exceptAll(asof_bucketed(probes, facts, ["key"], "us", ["v"], 4).select("seq", "f_seq", "f_v")).isEmpty()
    near = asof(probes, facts, ["key"], "us", ["v"], tolerance=0)
    assert near.where("f_us IS NOT NULL AND f_us <> us").isEmpty()


def test_future_rows_change_nothing_before_them(spark):
    rows = _rows(50, 5)
    past = [r for r in rows if r[1] < 12]
    full = W.trailing_sum(_frame(spark, rows), ["key"], "us", "seq", "v", 5, "s").where("us < 12").select("seq", "s")
    cut = W.trailing_sum(_frame(spark, past), ["key"], "us", "seq", "v", 5, "s").select("seq", "s")
    assert full.exceptAll(cut).isEmpty() and cut.exceptAll(full).isEmpty()


def test_rows_of_one_instant_do_not_see_each_other(spark):
    df = _frame(spark, [(1, 5, 0, 10), (1, 5, 1, 20), (1, 6, 2, 30)])
    got = {r["seq"]: r["p"] for r in df.select("seq", F.avg("v").over(W.earlier(["key"], "us")).alias("p")).collect()}
    assert got == {0: None, 1: None, 2: 15.0}


def test_cooldown_is_greedy(spark):
    df = _frame(spark, [(1, t, t, 0) for t in (0, 4, 6, 9, 11, 15)])
    assert sorted(r["us"] for r in W.cooldown(df, ["key"], "us", "seq", 5).collect()) == [0, 6, 11]


def test_rejected_rows_do_not_move_the_bar(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 5), (1, 1, 1, 9, 1), (1, 2, 2, 6, 6)], "key long, us long, seq long, a long, b long")
    got = {r["seq"]: r["accepted"] for r in W.monotone(df, ["key"], "us", "seq", ["a", "b"]).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_interval_pairs_equal_brute_force(spark):
    a, b = _rows(30, 6), _rows(30, 7)
    got = {(r["seq"], r["r_seq"]) for r in J.interval_pairs(_frame(spark, a), _frame(spark, b), ["key"], "us", -3, 2).collect()}
    assert got == {(x[2], y[2]) for x in a for y in b if x[0] == y[0] and -3 <= y[1] - x[1] <= 2}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "a long, b long")
    assert {r["id"]: r["comp"] for r in J.min_labels(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def test_passes_carry_their_state_over_batches(spark):
    """A key of many Arrow batches, null times and null keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(7)
        rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), i) for i in range(200)]
        got = sorted(r["seq"] for r in W.cooldown(spark.createDataFrame(rows, "key long, us long, seq long"), ["key"], "us", "seq", 7).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for key, us, seq in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or us - last[key] >= 7:
            want.append(seq)
            last[key] = us
    assert got == sorted(want)


def test_cooldown_by_chains_equals_the_pass(spark):
    """One key has nearly all rows; ties, repeated rows and nulls among them."""
    r = random.Random(9)
    rows = [(1 if r.random() < 0.9 else 2, r.randrange(4000), i % 700) for i in range(900)]
    rows += rows[:20] + [(3, 5, 1), (3, None, 2), (4, 7, 1), (4, 7, 0)]
    df = spark.createDataFrame(rows, "key long, us long, seq long").withColumn("t", F.lit("t"))
    for width in (1, 13, 500, 10_000):
        want = W.cooldown(df, ["key"], "us", "seq", width)
        got = chains.cooldown_spread(df, ["key"], "us", "seq", width, bucket=100)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert chains.cooldown_spread(df.limit(0), ["key"], "us", "seq", 5).count() == 0
