"""Greedy selection over hot keys: successors found once, then chains followed by doubling pointers.

Which row the cooldown takes next depends only on the row it took last: the first one at least `width` later.
So every row has one successor, found by an as-of join whose streams are dealt to tasks by time, and what is
taken is the chain from a key's first row.  In round k a row's pointer leads 2^k successors on; rows
reached so far send on those that their pointers lead to.  Rounds are as many as the longest chain has binary
digits, each a join on the row's own place, so a key that has all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .asof import asof_bucketed


def cooldown_spread(df: DataFrame, by: list[str], on: str, order: str, width: int, bucket: int | None = None) -> DataFrame:
    """The rows that windows.cooldown takes, for integer times.  bucket: the time that a task of a hot key has.

    Rows are told apart by (by, on, order); of rows equal in these one is taken.  Rows without a time or a null in by or
    order are never taken."""
    if width <= 0:
        raise ValueError("width must be positive")
    rows = df.dropna(subset=[*by, on, order])
    place = rows.select(*by, F.col(on).alias("t"), F.col(order).alias("n")).distinct()
    # The first row at or after t + width is the last at or before it where time runs backward.
    turned = place.select(*by, (-F.col("t")).alias("u"), (-F.col("n")).alias("v"))
    probes = place.select(*by, "t", "n", (-(F.col("t") + width)).alias("u"))
    found = asof_bucketed(probes, turned, by, "u", ["v"], bucket or 64 * width, order="v", prefix="s_")
    hops = materialize(found.where("s_u IS NOT NULL").select(*by, "t", "n", (-F.col("s_u")).alias("t2"), (-F.col("s_v")).alias("n2")), "hops0")
    first = place.groupBy(*by).agg(F.min(F.struct("t", "n")).alias("x")).select(*by, "x.t", "x.n")
    taken, k, same = materialize(first, "taken0"), 0, [*by, "t", "n"]
    while True:
        reached = taken.join(hops, same).select(*by, F.col("t2").alias("t"), F.col("n2").alias("n"))
        more = materialize(taken.unionByName(reached).distinct(), f"taken{k + 1}")
        far = hops.select(*by, F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("t2").alias("t3"), F.col("n2").alias("n3"))
        hops = materialize(hops.join(far, [*by, "t2", "n2"]).select(*by, "t", "n", F.col("t3").alias("t2"), F.col("n3").alias("n2")), f"hops{k + 1}")
        taken, k = more, k + 1
        if hops.isEmpty():
            break
    one = rows.dropDuplicates([*by, on, order])
    return one.join(taken.select(*by, F.col("t").alias(on), F.col("n").alias(order)), [*by, on, order], "left_semi")
