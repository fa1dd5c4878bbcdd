"""As-of joins: one shuffle on the key, one sort, no range join.

Both sides are put into one ordered stream a key; a running "last fact so far" gives the
match.  Where probe and fact have the same time, the order of the two sides decides
between <= and <.  Forward joins run over the reversed order, so the frame always starts
at the beginning and is never recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(probes: DataFrame, facts: DataFrame, by: list[str], on: str, values: list[str], order: str = "seq", direction: str = "backward", strict: bool = False, tolerance: int | None = None, prefix: str = "f_") -> DataFrame:
    """probes with, of each, the nearest fact's `on` and `values` as prefix + name.

    backward: the last fact at or before the probe (strict: before); forward: the first
    at or after (strict: after).  Ties among facts: the last by `order` going backward, the
    first going forward.  A match further away than tolerance, or none, gives nulls."""
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    kept = [*dict.fromkeys([on, order, *values])]
    probe_side, fact_side = (0, 1) if strict else (1, 0)
    row = F.struct(*[F.col(c) for c in probes.columns])
    left = probes.select(*by, F.col(on).alias("_on"), F.lit(probe_side).alias("_side"), F.lit(None).cast(facts.schema[order].dataType).alias("_seq"), row.alias("_probe"), F.lit(None).cast(facts.select(*kept).schema).alias("_fact"))
    right = facts.select(*by, F.col(on).alias("_on"), F.lit(fact_side).alias("_side"), F.col(order).alias("_seq"), F.lit(None).cast(probes.schema).alias("_probe"), F.struct(*kept).alias("_fact"))
    if direction == "backward":
        ordered = Window.partitionBy(*by).orderBy("_on", "_side", "_seq")
    else:
        ordered = Window.partitionBy(*by).orderBy(F.col("_on").desc(), "_side", F.col("_seq").desc())
    last = F.last("_fact", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = left.unionByName(right).withColumn("_fact", last).where("_probe IS NOT NULL")
    if tolerance is not None:
        found = found.withColumn("_fact", F.when(F.abs(F.col("_on") - F.col(f"_fact.{on}")) <= tolerance, F.col("_fact")))
    return found.select("_probe.*", *[F.col(f"_fact.{c}").alias(prefix + c) for c in kept])


def asof_bucketed(probes: DataFrame, facts: DataFrame, by: list[str], on: str, values: list[str], width: int, order: str = "seq", prefix: str = "f_") -> DataFrame:
    """The backward as-of join for hot keys: a key's stream is dealt to tasks by buckets of
    `width`; each bucket's last fact is carried on through a small table of bucket ends."""
    bucket = F.floor(F.col(on) / width)
    kept = [*dict.fromkeys([on, order, *values])]
    inside = asof(probes.withColumn("_bucket", bucket), facts.withColumn("_bucket", bucket), [*by, "_bucket"], on, values, order, prefix="_in_")
    ends = facts.groupBy(*by, bucket.alias("_bucket")).agg(F.max_by(F.struct(*kept), F.struct(on, order)).alias("_end"))
    wanted = inside.select(*by, "_bucket").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    ahead = Window.partitionBy(*by).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(wanted).withColumn("_before", F.last("_end", ignorenulls=True).over(ahead)).where("_end IS NULL").select(*by, "_bucket", "_before")
    found = inside.join(carried, [*by, "_bucket"], "left")
    return found.select(*probes.columns, *[F.coalesce(F.col(f"_in_{c}"), F.col(f"_before.{c}")).alias(prefix + c) for c in kept])


def last_known(column: str, by: list[str], order: list[str]) -> Column:
    """Forward fill: the last non-null value so far."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
