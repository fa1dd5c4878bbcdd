"""Joins of sets by what they share: at least so many members, and so much of their union.

Members are put in one order, rare ones first.  Two sets that share enough share a member among the first
n - o + 1 of each (n: the set's size, o: what it must share at least), so an index of those prefixes meets
every pair; it has a row for each set and prefix member, whatever the sets' sizes.  A row carries its
set, so that a pair is made where its first common member is, once.

Where components are wanted (overlap_links), equal sets are one class.  A member's sets are dealt in blocks, so a member
that a third of all sets have is work for many tasks; a task compares two blocks by a product of 0-1 matrices, or by the
pairs that meet in each column where those are few, and returns a spanning forest of the pairs that share enough.

Where pairs are wanted (overlap_pairs), sets that share o members or more share the first d <= o of them among the
first n - o + d of each.  Small sets are indexed by all combinations of d = `least` of those, COMBINATIONS rows a set at
most, and so meet few sets in vain where members are few and frequent; sets with more combinations, and those that may
pair with them, by single members.  A row holds its set and some keys that have it, so a task knows the pairs of keys,
which come as lists and pass through no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Sets of a block; members' rows of a task that has several members; cells of a matrix.
BLOCK, TASK_ROWS, CELLS = 1000, 20_000, 4_000_000
#: Rows of a set in the index of combinations; keys of a unit; units of a block; keys in a batch of lists.
COMBINATIONS, UNIT, UNITS, KEYS = 200, 128, 4000, 1_000_000
#: Pairs of units that are compared at a time.
PAIRS = 1_000_000


def ordered_sets(sets: DataFrame, key: str, member: str, least: int) -> DataFrame:
    """k, s (members, rare ones first), n (how many), of sets of `least` members or more; null members are none."""
    pairs = sets.select(F.col(key).alias("k"), F.col(member).alias("m")).where("k IS NOT NULL AND m IS NOT NULL").distinct()
    pairs = materialize(pairs, "set-pairs")
    often = pairs.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    whole = pairs.join(often, "m").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("s")).where(F.size("s") >= least)
    return materialize(whole.select("k", F.transform("s", lambda x: x["m"]).alias("s"), F.size("s").alias("n")), "sets")


def _shared(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """How many members each of sets[:cut] shares with each of sets[cut:]."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1
    owner, (_, column) = owner[often], np.unique(column[often], return_inverse=True)
    columns = int(column.max()) + 1 if len(column) else 0
    here = owner < cut
    left, right = np.bincount(column[here], minlength=columns), np.bincount(column[~here], minlength=columns)
    met = left @ right
    if met <= 4 * cut * (len(sets) - cut):  # few meet in most columns: their pairs are counted one by one
        order = np.argsort(column[~here], kind="stable")
        theirs, starts = owner[~here][order] - cut, np.cumsum(right) - right
        times = right[column[here]]
        nth = np.arange(met) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(owner[here], times) * (len(sets) - cut) + theirs[np.repeat(starts[column[here]], times) + nth]
        return np.bincount(pairs, minlength=cut * (len(sets) - cut)).reshape(cut, -1).astype(np.float32)
    out, wide = np.zeros((cut, len(sets) - cut), np.float32), min(columns, max(64, CELLS // len(sets)))  # counts below 2^24 are exact
    for low in range(0, columns, max(1, wide)):
        here = (column >= low) & (column < low + wide)
        cells = np.zeros((len(sets), wide), np.float32)
        cells[owner[here], column[here] - low] = 1
        out += cells[:cut] @ cells[cut:].T
    return out


def _counts(left: list[np.ndarray], right: list[np.ndarray]):
    """A function of a and b: how many members each of left[a:b] shares with each of right."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    if len(names) * len(sets) > CELLS:  # too wide for one matrix
        return lambda a, b: _shared([*left[a:b], *right], b - a)
    cells = np.zeros((len(sets), len(names)), np.float32)
    cells[owner, column] = 1
    return lambda a, b: cells[a : min(b, len(left))] @ cells[len(left) :].T


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Every vertex of edges (i, j) with its component's first one."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    child = [x for x in range(n) if find(x) != x]
    return child, [find(x) for x in child]


def linked(sets: DataFrame, least: int) -> DataFrame:
    """a, b: pairs of ordered sets with the components of all pairs that share `least` members or more."""
    heads = sets.select("k", F.posexplode(F.slice("s", F.lit(1), F.col("n") - least + 1)).alias("at", "m"), "s")
    loads = heads.groupBy("m").agg(F.count(F.lit(1)).alias("load")).where("load > 1")
    loads = materialize(loads.withColumn("nb", F.ceil(F.col("load") / BLOCK).cast("int")), "set-loads")
    small = loads.where("nb = 1").agg(F.sum("load")).first()[0] or 0
    bins = 1 + small // TASK_ROWS
    met = heads.join(loads.select("m", "nb"), "m").withColumn("x", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    span = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(F.least("x", i).alias("lo"), F.greatest("x", i).alias("hi")))
    dealt = met.withColumn("t", F.explode(span)).withColumn("bin", F.when(F.col("nb") == 1, F.pmod(F.xxhash64("m"), F.lit(bins))).otherwise(F.xxhash64("m")))
    dealt = dealt.select("bin", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), "m", "x", "k", "at", "s")
    kind = sets.schema["k"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x, at = (table.column(k).to_numpy() for k in ("x", "at"))
        m = table.column("m").combine_chunks().dictionary_encode().indices.to_numpy()
        flat = table.column("s").combine_chunks()
        ends = np.cumsum(flat.value_lengths().to_numpy())
        codes = flat.flatten().dictionary_encode().indices.to_numpy()
        whole = np.split(codes, ends[:-1])
        none = np.empty(0, np.int64)
        found = [(none, none)]
        order = np.lexsort((x, m))
        for rows in np.split(order, np.flatnonzero(np.diff(m[order])) + 1):
            left, right = rows[x[rows] == lo], rows[x[rows] == hi]
            if not len(left) or not len(right) or len(rows) < 2:
                continue
            both = _shared([whole[k][at[k] :] for k in (*left, *right)], len(left))
            fits = both >= least
            i, j = np.nonzero(np.triu(fits, 1) if lo == hi else fits)
            if len(i):
                local, k = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
                child, top = _forest(k[: len(i)], k[len(i) :], len(local))
                found.append((local[child], local[top]))
        one, two = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        key = table.column("k").combine_chunks()
        a, b = key.take(pa.array(one)), key.take(pa.array(two))
        return pa.table([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], names=["a", "b"])

    return dealt.groupBy("bin", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}")


def overlap_links(sets: DataFrame, key: str, member: str, least: int) -> DataFrame:
    """Edges (a, b) with the components of all pairs of keys that share `least` members or more."""
    whole = ordered_sets(sets, key, member, least)
    classes = materialize(whole.groupBy("s").agg(F.min("k").alias("k"), F.first("n").alias("n")), "set-classes")
    equal = whole.join(classes.select("s", F.col("k").alias("c")), "s").where("k <> c").select(F.col("k").alias("a"), F.col("c").alias("b"))
    return linked(classes, least).unionByName(equal).distinct()


def _places(n: int, least: int, percent: int, d: int) -> int:
    """Among how many of its first members a set of n has the first d that it shares with any other."""
    return n - max(least, -(-n * percent // 100)) + d


def matched(units: DataFrame, least: int, percent: int, d: int, above: int, most: int) -> DataFrame:
    """ka, kb, common, in_all: lists of keys, each of ka a pair with each of kb, for all pairs of units (u, s, n, ks) of
    which one has more than `above` members.  Units are indexed by combinations of d members; where d > 1, none has more
    than `most` places of them."""
    o = F.greatest(F.lit(least), F.ceil(F.col("n") * percent / 100).cast("int"))
    size = F.col("n") - o + d
    if d == 1:
        places = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.array(i))
    else:  # a list for each number of places
        array = lambda x: f"array({','.join(map(array, x))})" if isinstance(x, (list, tuple)) else str(x)
        places = F.element_at(F.expr(array([list(combinations(range(p), d)) for p in range(d, most + 1)])), size - d + 1)
    heads = units.withColumn("at", F.explode(places)).withColumn("m", F.xxhash64(F.transform("at", lambda i: F.col("s")[i])))
    loads = heads.groupBy("m").agg(F.count(F.lit(1)).alias("load")).where("load > 1")
    loads = materialize(loads.withColumn("nb", F.ceil(F.col("load") / UNITS).cast("int")), "set-loads")
    bins = 1 + (loads.where("nb = 1").agg(F.sum("load")).first()[0] or 0) // TASK_ROWS
    met = heads.join(loads.select("m", "nb"), "m").withColumn("x", F.pmod(F.xxhash64("u"), F.col("nb")).cast("int"))
    span = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(F.least("x", i).alias("lo"), F.greatest("x", i).alias("hi")))
    dealt = met.withColumn("t", F.explode(span)).withColumn("bin", F.when(F.col("nb") == 1, F.pmod(F.xxhash64("m"), F.lit(bins))).otherwise(F.xxhash64("m")))
    dealt = dealt.select("bin", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), "m", "x", "n", "at", "s", "ks")
    kind = units.schema["ks"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x, n, m = (table.column(k).to_numpy() for k in ("x", "n", "m"))
        flat, keys = (table.column(k).combine_chunks() for k in ("s", "ks"))
        codes = flat.flatten().dictionary_encode().indices.to_numpy()
        ends = np.cumsum(flat.value_lengths().to_numpy())
        whole = np.split(codes, ends[:-1])
        at = table.column("at").combine_chunks().flatten().to_numpy().reshape(-1, d)
        members = codes[(ends - flat.value_lengths().to_numpy())[:, None] + at]
        key, many = keys.flatten(), keys.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(many) - many
        exact = np.float32 if int(n.max()) < 1 << 14 else np.float64
        weight, scale = (percent * n.astype(np.int64)).astype(exact), exact(100 + percent)

        def lists(left, right, i, j, common):
            """Pairs, ordered by i, as lists of keys: a row for each i, number of common members and size."""
            by, wide = i * (int(common.max()) + 1) + common, len(left) * (int(common.max()) + 1)
            by = np.argsort(by.astype(np.uint16 if wide < 1 << 16 else np.int64), kind="stable")
            i, j, common = i[by], right[j[by]], common[by]
            in_all = n[left[i]] + n[j] - common
            begin = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(common) != 0) | (np.diff(in_all) != 0)])
            upto = np.r_[0, np.cumsum(many[j])]
            cuts = np.flatnonzero(np.diff(upto[begin] // KEYS)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(begin)].tolist(), strict=True):
                rows, end = begin[a:b], int(begin[b]) if b < len(begin) else len(j)
                theirs = j[begin[a] : end]
                times = many[theirs]
                values = key.take(pa.array(np.repeat(start[theirs] - (np.cumsum(times) - times), times) + np.arange(times.sum())))
                bounds = np.r_[upto[rows], upto[end]] - upto[rows[0]]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(left[i[rows]])), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values), pa.array(common[rows]), pa.array(in_all[rows])], ["ka", "kb", "common", "in_all"])

        order = np.lexsort((n, x, *members.T, m))  # m stands for members but for chance; sizes ascend
        new = np.any(members[order][1:] != members[order][:-1], axis=1)
        for rows in np.split(order, np.flatnonzero(new) + 1):
            left, right = rows[x[rows] == lo], rows[x[rows] == hi]
            if not len(left) or not len(right) or len(rows) < 2:
                continue
            counted = _counts([whole[k] for k in left], [whole[k] for k in right])
            heads = _counts([whole[k][: at[k, -1] + 1] for k in left], [whole[k][: at[k, -1] + 1] for k in right])
            step = max(1, PAIRS // len(right))
            for low in range(0, len(left), step):
                part = left[low : low + step]
                both = counted(low, low + len(part))
                fits = heads(low, low + len(part)) == d  # only where these are the first common members
                fits &= scale * both >= weight[part, None] + weight[right]
                if least > d:
                    fits &= both >= least
                if above:
                    fits &= (n[part, None] > above) | (n[right] > above)
                if lo == hi:
                    fits &= np.arange(low, low + len(part))[:, None] < np.arange(len(right))
                i, j = np.nonzero(fits)
                if len(i):
                    yield from lists(part, right, i, j, both[i, j].astype(np.int64))

    return dealt.groupBy("bin", "lo", "hi").applyInArrow(compare, f"ka {kind}, kb {kind}, common long, in_all long")


def overlap_pairs(sets: DataFrame, key: str, member: str, least: int, percent: int = 0) -> DataFrame:
    """a, b, common, in_all: pairs a < b of keys that share at least `least` members and percent % of their union.

    Keys of equal sets go together as units, UNIT keys each."""
    whole = ordered_sets(sets, key, member, least)
    classes = whole.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("nb"))
    units = whole.join(classes, "s").groupBy("s", "n", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int").alias("u"))
    units = units.agg(F.array_sort(F.collect_list("k")).alias("ks")).select(F.xxhash64("s", "u").alias("u"), "s", "n", "ks")
    units = materialize(units, "set-units")
    d, limit, found = min(least, 3), 0, []
    while d > 1 and limit < 1000 and math.comb(max(0, _places(limit + 1, least, percent, d)), d) <= COMBINATIONS:
        limit += 1
    if limit >= least:
        found.append(matched(units.where(F.col("n") <= limit), least, percent, d, 0, _places(limit, least, percent, d)))
    else:
        limit = 0
    if not limit or not units.where(F.col("n") > limit).isEmpty():
        found.append(matched(units.where(F.col("n") >= -(-(limit + 1) * percent // 100)), least, percent, 1, limit, 1))
    pair = lambda df, b: df.withColumn("x", F.explode("ka")).select("x", F.explode(b).alias("y"), "common", "in_all")
    n = F.col("n").cast("long")
    pairs = pair(units.where(F.size("ks") > 1).select(F.col("ks").alias("ka"), F.col("ks").alias("kb"), n.alias("common"), n.alias("in_all")), "kb").where("x < y")
    for lists in found:
        pairs = pairs.unionByName(pair(lists, "kb"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "in_all")
