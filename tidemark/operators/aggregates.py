"""Aggregates: leave-one-group-out, shrinkage, decay, calibration, bootstrap, rank metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leave_one_out(df: DataFrame, entity: str, group: str, value: str, least: int = 1) -> DataFrame:
    """For each entity and group: mean of the entity's other groups (total less own), null
    below `least` rows.  Two map-side combined sums; rows themselves are not shuffled twice."""
    own = df.groupBy(entity, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = own.groupBy(entity).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = F.col("tn") - F.col("n")
    mean = F.when(rest >= least, (F.col("ts") - F.coalesce("s", F.lit(0))) / rest)
    return own.join(total, entity).select(entity, group, rest.alias("n_other"), mean.alias("mean_other"))


def shrunken(wins: Column, n: Column, prior: float, weight: float) -> Column:
    return (wins + weight * prior) / (n + weight)


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, z2 = wins / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties counted half, from counts at each score.

    Distinct scores, not rows, are ordered: n_neg below, plus half of those at the same score."""
    at = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    return auc_of_counts(at, by, score, "_p", "_q")


def auc_of_counts(at: DataFrame, by: list[str], score: str, wins: str, losses: str) -> DataFrame:
    """auc from a row for each score with its numbers of wins and losses."""
    at = at.select(*by, score, F.col(wins).cast("double").alias("_p"), F.col(losses).cast("double").alias("_q"))
    below = F.coalesce(F.sum("_q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    g = at.withColumn("_u", F.col("_p") * (below + F.col("_q") / 2)).groupBy(*by).agg(F.sum("_u").alias("u"), F.sum("_p").alias("n1"), F.sum("_q").alias("n0"))
    return g.select(*by, F.try_divide(F.col("u"), F.col("n1") * F.col("n0")).alias("auc"))


def metrics(p: str, y: str, weight: str | None = None) -> list[Column]:
    """Brier score, log-loss (p clipped), accuracy; weighted where a weight is named."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    one = F.col(y) == 1
    w = F.col(weight) if weight else F.lit(1.0)
    mean = lambda c: F.sum(w * c) / F.sum(w)
    return [mean(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), mean(-F.when(one, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"), mean(F.when((F.col(p) >= 0.5) == one, 1.0).otherwise(0.0)).alias("accuracy")]


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, draws: int = 500, least: int = 5, level: float = 0.95) -> DataFrame:
    """Mean with a confidence interval from resampling whole clusters.

    A cluster enters a draw with a Poisson(1) weight from a hash of (cluster, draw), so
    draws are the same whatever the partitioning; multiplicity is kept.  Only sums a
    cluster are multiplied by draws.  Null below `least` clusters."""
    sums = df.groupBy(*by, F.col(cluster).alias("_c")).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("n"))
    u = F.pmod(F.xxhash64(*by, "_c", "draw"), F.lit(2**40)) / float(2**40)
    # Poisson(1) by its distribution function.
    cuts, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    weight = sum((F.when(u > c, 1.0).otherwise(0.0) for c in cuts), F.lit(0.0))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", 1 - (1 - level) / 2).alias("high"))
    point = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("clusters"))
    out = point.join(ends, by) if by else point.join(ends)
    return out.select(*by, "mean", "clusters", *[F.when(F.col("clusters") >= least, F.col(c)).alias(c) for c in ("low", "high")])
