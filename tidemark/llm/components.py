"""Connected components by alternating stars.

Edges are pulled towards each component's smallest member: the large star links a
vertex's larger neighbours to its smallest one, the small star its smaller ones.  When
all edges are stars, every vertex hangs on its component's smallest member.  The number of
rounds grows with the logarithm of the longest chain.

Scale: each star is one map-side combined minimum for each vertex and a join back on
the same key, so a vertex with very many neighbours is no hot group; each round is
written to the shared folder, which bounds the lineage.  Only whether stars are all
there is reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, sized

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges (a, b), both ways for the large star, from larger to smaller for the small one."""
    low = sized(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), rows)
    met = sized(edges.join(low, "a"), rows)
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame, rows: int) -> bool:
    """Whether all edges are stars: no vertex has two parents, or is parent and child."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("child")), F.struct(F.col("b").alias("v"), F.lit(0).alias("child")))).alias("x")).select("x.*")
    return sized(roles.groupBy("v").agg(F.sum("child").alias("up"), F.min("child").alias("low")), rows).where("up > 1 OR (up = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame, label: str = "components", rows: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """edges: columns a, b of one orderable type.  Returns vertex, component (its smallest
    member) for every vertex that has an edge; empty edges give no rows.  edges are read twice
    unless their number is given as rows.  The result reads a table in scratch, if given."""
    write = scratch.write if scratch else materialize
    rows = 2 * (edges.count() if rows is None else rows)
    current = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = write(current, f"{label}0", rows)
    for n in range(1, MAX_ROUNDS):
        if _settled(current, rows):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pulled = _star(both, True, rows).where("a <> b")
        current = write(_star(pulled, False, rows).where("a <> b").distinct(), f"{label}{n}", rows)
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
