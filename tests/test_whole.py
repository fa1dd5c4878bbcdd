"""Queries over all rows: small tables with a known or brute-force answer."""

import math
import random
from datetime import datetime
from itertools import combinations, groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import setjoin as SJ
from tidemark.plans import registry
from tidemark.sources.tables import facts
from tidemark.sources.shards import run_shards


def test_areas_of_every_label(spark, tmp_path):
    rng, rows = random.Random(3), []
    for label in range(7):
        for i in range(8 if label == 2 else 30):
            rows.append((len(rows), [10.0 * (i % 3) + rng.random() + label, 10.0 * (i % 3 == 1) + rng.random()], label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["area"] for r in registry.QUERIES["M11_areas"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for label, own in groupby(rows, key=lambda r: r[2]):
        at = [got[r[0]] for r in own]
        if label == 2:
            assert set(at) == {-1}
        else:
            assert all(len(set(at[i::3])) == 1 for i in range(3)) and set(at) == {0, 1, 2}


def lineitem(spark, path, sets):
    """sets: (group, members, which are both its parts and suppliers)."""
    rows = [(g, m, m, i, 1.0, 1.0, 0.0, 0.0, "R", "O", datetime(1996, 1, 1)) for g, ms in sets for i, m in enumerate(ms)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")


def pairs_by_hand(sets, percent):
    for (a, x), (b, y) in combinations(sorted(sets), 2):
        same, union = len(x & y), len(x | y)
        if same >= 3 and 100 * same >= percent * union:
            yield a, b, same, union


def test_components_and_overlaps_of_all_groups(spark, tmp_path):
    rng = random.Random(4)
    sets = [(g, {rng.randrange(14) for _ in range(rng.randrange(1, 9))}) for g in range(1, 150)]
    sets += [(g, {x + 20 for x in range(g % 7, g % 7 + 4)}) for g in range(200, 207)] + [(300, {40, 41, 42}), (301, {40, 41, 42})]
    lineitem(spark, tmp_path, [(g, [*s, min(s)]) for g, s in sets])
    got = registry.QUERIES["J18_set_overlap"](spark, str(tmp_path))
    assert sorted((r["a"], r["b"], r["common"], r["in_all"]) for r in got.collect()) == sorted(pairs_by_hand(sets, 60))
    comp = {}
    edges = list(pairs_by_hand(sets, 0))
    for a, b, *_ in edges:
        comp[a], comp[b] = a, b
    while any(comp[a] != comp[b] for a, b, *_ in edges):
        for a, b, *_ in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["id"]: r["comp"] for r in registry.QUERIES["A25_components"](spark, str(tmp_path)).collect()} == comp


def test_sets_of_few_frequent_members_meet_few_others_in_vain(spark, monkeypatch):
    """Members that a sixth of all sets have: what meets in the index is a small part of all pairs."""
    met, write = [], SJ.materialize

    def seen(df, name, *rest):
        table = write(df, name, *rest)
        if name == "set-loads":
            met.append(table.agg(F.sum(F.col("load") * F.col("load"))).first()[0] or 0)
        return table

    monkeypatch.setattr(SJ, "materialize", seen)
    rng = random.Random(8)
    sets = [(g, set(rng.sample(range(30), rng.randrange(4, 7)))) for g in range(1200)]
    df = spark.createDataFrame([(g, m) for g, s in sets for m in s], "g long, m long")
    got = SJ.overlap_pairs(df, "g", "m", 3, 60)
    assert sorted((r["a"], r["b"], r["common"], r["in_all"]) for r in got.collect()) == sorted(pairs_by_hand(sets, 60))
    assert met and sum(met) < len(sets) ** 2 / 10


@pytest.mark.parametrize("combinations_", [1, 20, 200])
@pytest.mark.parametrize("percent", [0, 60])
def test_pairs_through_units_blocks_and_both_indexes(spark, monkeypatch, combinations_, percent):
    """Units of two keys, blocks of three units, lists in batches of four keys, and sets on both sides of the bound."""
    for name, value in (("UNIT", 2), ("UNITS", 3), ("KEYS", 4), ("COMBINATIONS", combinations_)):
        monkeypatch.setattr(SJ, name, value)
    rng = random.Random(9)
    sets = [(g, set(rng.sample(range(16), rng.randrange(1, 15)))) for g in range(60)]
    sets += [(100 + g, sets[g % 6][1]) for g in range(40)]
    df = spark.createDataFrame([(g, m) for g, s in sets for m in s], "g long, m long")
    got = SJ.overlap_pairs(df, "g", "m", 3, percent)
    assert sorted((r["a"], r["b"], r["common"], r["in_all"]) for r in got.collect()) == sorted(pairs_by_hand(sets, percent))


@pytest.mark.parametrize("block", [7, 1000])
def test_large_sets_and_hot_members(spark, monkeypatch, block):
    """Sets of 300 members: an index row for each prefix member; a member that all sets have; equal sets."""
    monkeypatch.setattr(SJ, "BLOCK", block)
    rng = random.Random(6)
    base = [rng.sample(range(2000), 300) for _ in range(6)]
    sets = [(g, {*base[g % 6][: rng.randrange(200, 300)], *rng.sample(range(3000, 9000), rng.randrange(60)), -1}) for g in range(40)]
    sets += [(100 + g, {-1, 9000 + g, *range(9100, 9100 + g % 5)}) for g in range(30)] + [(200 + g, sets[3][1]) for g in range(4)] + [(300, {-1, 5}), (301, {-1, 5})]
    df = spark.createDataFrame([(g, m) for g, s in sets for m in [*s, min(s)]] + [(None, 1), (300, None)], "g long, m long")
    got = SJ.overlap_pairs(df, "g", "m", 3, 60)
    assert sorted((r["a"], r["b"], r["common"], r["in_all"]) for r in got.collect()) == sorted(pairs_by_hand(sets, 60))
    comp = {}
    edges = [(a, b) for a, b, *_ in pairs_by_hand(sets, 0)]
    for a, b in edges:
        comp[a], comp[b] = a, b
    while any(comp[a] != comp[b] for a, b in edges):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["id"]: r["comp"] for r in J.min_labels(SJ.overlap_links(df, "g", "m", 3)).collect()} == comp
    if block == 1000:
        assert SJ.ordered_sets(df, "g", "m", 3).select(F.sum("n")).first()[0] <= sum(len(s) for _, s in sets)


@pytest.mark.parametrize("block", [7, 1000])
def test_equal_sets_are_compared_once(spark, monkeypatch, block):
    """Fifty copies of a few sets: blocks are dealt for classes, not copies, and all pairs of copies come out."""
    monkeypatch.setattr(SJ, "BLOCK", block)
    seen = []
    linked = SJ.linked
    monkeypatch.setattr(SJ, "linked", lambda sets, *more, **named: seen.append(sets.count()) or linked(sets, *more, **named))
    kinds = [{1, 2, 3}, {1, 2, 3, 4}, {2, 3, 4, 5}, {7, 8, 9}, {1, 2}]
    sets = [(g, kinds[g % 5]) for g in range(250)]
    df = spark.createDataFrame([(g, m) for g, s in sets for m in s], "g long, m long")
    got = sorted((r["a"], r["b"], r["common"], r["in_all"]) for r in SJ.overlap_pairs(df, "g", "m", 3, 60).collect())
    assert got == sorted(pairs_by_hand(sets, 60)) and seen == [4]


@pytest.mark.parametrize(("members", "size"), [(2000, 5), (12, 5), (300, 1), (3, 0)])
def test_shared_members_of_small_sets_need_no_matrix(monkeypatch, members, size):
    """Sets of few members out of many, as lines of orders are: what they share is counted without a 0-1 matrix."""
    rng = np.random.default_rng(members)
    sets = [np.array(sorted({7, *rng.integers(0, members, size).tolist()} if i % 9 else ()), np.int32) for i in range(1, 121)]
    want = [[len({*a.tolist()} & {*b.tolist()}) for b in sets[50:]] for a in sets[:50]]
    if members == 2000:
        monkeypatch.setattr(SJ, "CELLS", None)  # the matrix's width would be taken from it
    assert SJ._shared(sets, 50).tolist() == want


def test_components_of_long_chains(spark):
    """A smaller label has to cross a basin that has settled on another one."""
    path = [2, *range(10, 110), 1]
    shuffled = [*range(1000, 1400)]
    random.Random(5).shuffle(shuffled)
    edges = [*zip(path, path[1:]), *zip(shuffled, shuffled[1:])]
    got = {r["id"]: r["comp"] for r in J.min_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(path, 1) | dict.fromkeys(shuffled, 1000)


def test_components_not_settled(spark):
    with pytest.raises(RuntimeError):
        J.min_labels(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), 1)


def test_elo_of_each_pool_by_hand(spark):
    """Ratings of M20 by one loop over days and pools, whole pools at once."""
    sf = "/root/testdata/sf0.001"
    pool = {r["c_custkey"]: r["c_nationkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    rows = sorted((r["day"], r["fact"], r["entity"], r["won"]) for r in facts(spark, sf).collect())
    rating, want = {}, {}
    for _, day in groupby(rows, key=lambda r: r[0]):
        moves = []
        for _, fact, a, won in day:
            b = a - a % 25 + (a + 7) % 25
            ra, rb = (rating.get((pool[a], e), 1500.0) for e in (a, b))
            want[fact] = 1 / (1 + 10 ** ((rb - ra) / 400))
            moves += [((pool[a], a), 24 * (won - want[fact])), ((pool[a], b), -24 * (won - want[fact]))]
        for e, m in moves:
            rating[e] = rating.get(e, 1500.0) + m
    got = {r["fact"]: r["p"] for r in registry.QUERIES["M20_elo_by_pool"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_deviation_ratings_by_hand(spark):
    """M20_idle_deviation against the published formulas, written out for whole days and pools."""
    sf, q, c2 = "/root/testdata/sf0.001", math.log(10) / 400, 400.0
    pool = {r["c_custkey"]: r["c_nationkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    rows = sorted((r["day"], r["fact"], r["entity"], r["won"]) for r in facts(spark, sf).collect())
    r, rd, seen, want = {}, {}, {}, {}
    for day, contests in groupby(rows, key=lambda x: x[0]):
        met = {}
        for _, fact, a, won in contests:
            a, b = (pool[a], a), (pool[a], a - a % 25 + (a + 7) % 25)
            for e in (a, b):
                if seen.get(e) != day:
                    rd[e] = min(350.0, math.sqrt(rd.get(e, 350.0) ** 2 + c2 * (day - seen.get(e, day))))
                    seen[e] = day
            met.setdefault(a, []).append((b, float(won), fact))
            met.setdefault(b, []).append((a, 1.0 - won, None))
        new = {}
        for e, games in met.items():
            d, s = 0.0, 0.0
            for o, score, fact in games:
                g = 1 / math.sqrt(1 + 3 * q**2 * rd[o] ** 2 / math.pi**2)
                p = 1 / (1 + 10 ** (-g * (r.get(e, 1500.0) - r.get(o, 1500.0)) / 400))
                d, s = d + q**2 * g**2 * p * (1 - p), s + g * (score - p)
                if fact is not None:
                    want[fact] = (p, rd[e])
            v = 1 / (1 / rd[e] ** 2 + d)
            new[e] = (r.get(e, 1500.0) + q * v * s, math.sqrt(v))
        for e, (x, y) in new.items():
            r[e], rd[e] = x, y
    got = {x["fact"]: (x["p"], x["deviation"]) for x in registry.QUERIES["M20_idle_deviation"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-3 for k in want for a, b in zip(got[k], want[k], strict=True))
    assert len({round(y) for _, y in got.values()}) > 20


def test_shards_that_lost_rows_are_done_anew(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).alias("part"), F.when(F.col("id") % 3 == 0, "purchase").otherwise("view").alias("kind"))
    folders = [f"{tmp_path}/in/part={i}" for i in range(2)]
    for i, f in enumerate(folders):
        rows.where(f"part = {i}").drop("part").coalesce(1).write.parquet(f)
    first = run_shards(spark, folders, f"{tmp_path}/1", None)
    audit = lambda a: sorted((r["part"], r["n"], r["status"], r["reason"]) for r in a.collect())
    assert audit(first) == [("0", 20, "ok", "new"), ("1", 20, "ok", "new")]
    spark.read.parquet(f"{tmp_path}/1/rows/part=0").limit(3).write.parquet(f"{tmp_path}/kept")
    spark.read.parquet(f"{tmp_path}/kept").write.mode("overwrite").parquet(f"{tmp_path}/1/rows/part=0")
    second = run_shards(spark, folders, f"{tmp_path}/2", first)
    assert audit(second) == [("0", 20, "ok", "changed"), ("1", 20, "skipped", "verified")]
    assert audit(run_shards(spark, folders, f"{tmp_path}/3", second)) == [("0", 20, "skipped", "verified"), ("1", 20, "skipped", "verified")]


@pytest.mark.parametrize("name, sorts, without", [("W03_signed_streak", 1, "island"), ("F09_contiguity", 1, "l_partkey"), ("A22_hierarchical_weights", 4, "l_shipdate"), ("A33_stat_lines", 3, "distinct part")])
def test_steps_are_sorted_once(spark, tmp_path, name, sorts, without):
    """Lines that come again with other days and wins, gaps in lines, facts that come twice: as SQL, and with no sort of
    steps besides the one by group and those of joins and distinct parts."""
    import duckdb

    rng = random.Random(8)
    rows = [(g, rng.randrange(9), rng.randrange(9), rng.choice([i, i, i + 1, 1]), float(rng.randrange(1, 9)), 1.0, 0.0, 0.0, rng.choice("RN"), rng.choice("OF"), datetime(1996, 1, rng.randrange(1, 6))) for g in range(1, 90) for i in range(1, rng.randrange(2, 9))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(g, c, "F", 1.0, datetime(1996, 1, 1), "1-URGENT") for g in range(1, 100) if g % 11 for c in ([g % 7] if g % 5 else [g % 7, g % 7, 8])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= sorts and without not in plan
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
