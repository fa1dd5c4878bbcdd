"""Joins on intervals, bands and sets, always through an equality that deals the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir


def interval_pairs(left: DataFrame, right: DataFrame, by: list[str], on: str, low: int, high: int, prefix: str = "r_") -> DataFrame:
    """Pairs of equal keys with low <= right.on - left.on <= high.

    Times are cut into buckets as wide as the interval, left rows look at the buckets that
    their interval touches (two at most), so the join is on (key, bucket)."""
    width = max(1, high - low + 1)
    mine = left.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col(on) + low) / width), F.floor((F.col(on) + high) / width)))))
    theirs = right.select(*[F.col(c).alias(prefix + c) for c in right.columns], F.floor(F.col(on) / width).alias("_rb"))
    same = F.col("_b") == F.col("_rb")
    for c in by:
        same = same & (F.col(c) == F.col(prefix + c))
    gap = F.col(prefix + on) - F.col(on)
    return mine.join(theirs, same & (gap >= low) & (gap <= high)).drop("_b", "_rb")


def interval_semi(left: DataFrame, right: DataFrame, by: list[str], on: str, low: int, high: int, more: Column | None = None) -> DataFrame:
    """Rows of left with some right row in the interval; `more` is a condition over left's
    columns and right's, the latter with prefix r_."""
    width = max(1, high - low + 1)
    theirs = right.select(*[F.col(c).alias("r_" + c) for c in right.columns]).withColumn("_rb", F.explode(F.array_distinct(F.array(F.floor((F.col("r_" + on) - high) / width), F.floor((F.col("r_" + on) - low) / width)))))
    same = F.floor(F.col(on) / width) == F.col("_rb")
    for c in by:
        same = same & (F.col(c) == F.col("r_" + c))
    gap = F.col("r_" + on) - F.col(on)
    cond = same & (gap >= low) & (gap <= high)
    return left.join(theirs, cond & more if more is not None else cond, "left_semi")


def checkpoints(spark: SparkSession) -> None:
    """Set the folder that checkpoints go to, unless there is one."""
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)


def min_labels(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """Connected components of edges (a, b): id, comp (the smallest id reached).  Each round an
    id takes the smallest label among its neighbours and gives it to its own label as well, and
    labels are halved along pointers, so whole trees are hung together; every round is written,
    so plans stay short.  Raises if labels still move after `rounds` rounds."""
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct()
    for _ in range(rounds):
        far = labels.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp").checkpoint()
        near = both.join(far.select(F.col("id").alias("b"), F.col("far").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        pulled = far.join(near, "id", "left").select("id", "comp", F.least("far", "near").alias("low")).checkpoint()
        given = pulled.groupBy(F.col("comp").alias("id")).agg(F.min("low").alias("given"))
        nxt = pulled.join(given, "id", "left").select("id", F.least("low", "given").alias("new"), "comp").checkpoint()
        labels = nxt.select("id", F.col("new").alias("comp"))
        if nxt.where("new <> comp").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
