"""K-means of many groups at once, as grouped means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import checkpoints

K = 3


def _gap(i: int):
    return (F.col("a") - F.col(f"a{i}")) * (F.col("a") - F.col(f"a{i}")) + (F.col("b") - F.col(f"b{i}")) * (F.col("b") - F.col(f"b{i}"))


def _nearest():
    return F.array_min(F.array(*[F.struct(_gap(i).alias("gap"), F.lit(i).alias("area")) for i in range(K)]))["area"]


def areas(points: DataFrame, least: int, rounds: int) -> DataFrame:
    """points (label, a, b, ...) with area: 0 to 2, the nearest of the label's three centres,
    or -1 where a label has under `least` points.  Centres start at the smallest point and the
    ones farthest from those before, and are moved in `rounds` rounds of all labels together;
    what is kept of a label is one row, so a label of many points is no hot group."""
    checkpoints(points.sparkSession)
    x = points.checkpoint()
    dot = F.struct("a", "b")
    centres = x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(dot).alias("c")).where(F.col("n") >= least).select("label", F.col("c.a").alias("a0"), F.col("c.b").alias("b0")).checkpoint()
    for i in range(1, K):
        far = F.least(*[_gap(j) for j in range(i)]) if i > 1 else _gap(0)
        kept = [c for j in range(i) for c in (f"a{j}", f"b{j}")]
        centres = x.join(centres, "label").groupBy("label").agg(*[F.max(c).alias(c) for c in kept], F.max(F.struct(far.alias("gap"), "a", "b")).alias("c")).select("label", *kept, F.col("c.a").alias(f"a{i}"), F.col("c.b").alias(f"b{i}")).checkpoint()
    for _ in range(rounds):
        near = x.join(centres, "label").withColumn("area", _nearest())
        mean = lambda c, i: F.coalesce(F.avg(F.when(F.col("area") == i, F.col(c))), F.max(f"{c}{i}")).alias(f"{c}{i}")
        centres = near.groupBy("label").agg(*[mean(c, i) for i in range(K) for c in ("a", "b")]).checkpoint()
    return x.join(centres, "label", "left").select(*points.columns, F.when(F.col("a0").isNull(), -1).otherwise(_nearest()).alias("area"))
