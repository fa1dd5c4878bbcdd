"""Logistic regression with an effect for each entity, however many there are.

A Newton step's equations have a dense block for the few common terms and a diagonal one for the
entities.  Each entity's part is one grouped sum; eliminating the entities leaves equations as small as the
common terms, whose sums are all that reaches the driver; every entity's step then follows from its own
sums.  Coefficients stay a DataFrame, of one row an entity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, materialize

ROUNDS, SETTLED = 25, 1e-8


def entity_effects(rows: DataFrame, entity: str, columns: list[str], y: str, reg: float) -> tuple[DataFrame, dict]:
    """(entity, effect) and the common terms ("intercept" and columns) that make the mean logistic loss of y (0
    or 1) and reg / 2 times the squared standardized coefficients least; the intercept is free.

    Rows with a null in any of these are left out."""
    terms, spark = ["intercept", *columns], rows.sparkSession
    data = rows.select(F.col(entity).alias("e"), F.lit(1.0).alias("intercept"), *[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("double").alias("y")).dropna()
    with Scratch(spark, "effects") as scratch:
        data = scratch.write(data, "rows")
        seen = data.agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(c).alias(c) for c in columns]).first()
        n = seen["n"]
        if not n:
            return spark.createDataFrame([], data.select("e").schema).select(F.col("e").alias(entity), F.lit(0.0).alias("effect")), dict.fromkeys(terms, 0.0)
        penalty = np.array([0.0, *[reg * n * (seen[c] or 0.0) for c in columns]])
        share = F.count(F.lit(1)) / n
        # The variance of an entity's indicator, as of any column.
        effects = scratch.write(data.groupBy("e").agg((F.lit(reg * n * n / max(1, n - 1)) * share * (1 - share)).alias("l")).withColumn("effect", F.lit(0.0)), "effects0")
        beta = np.zeros(len(terms))
        for k in range(ROUNDS):
            p = 1 / (1 + F.exp(-(sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, terms, strict=True)), F.lit(0.0)) + F.col("effect"))))
            each = data.join(effects, "e").withColumn("p", p).withColumn("w", F.col("p") * (1 - F.col("p"))).withColumn("r", F.col("y") - F.col("p"))
            pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
            sums = each.groupBy("e").agg(
                F.first("l").alias("l"), F.first("effect").alias("effect"), F.sum("w").alias("d"), F.sum("r").alias("g"), *[F.sum(F.col("w") * F.col(c)).alias(f"b{i}") for i, c in enumerate(terms)],
                *[F.sum(F.col("r") * F.col(c)).alias(f"g{i}") for i, c in enumerate(terms)], *[F.sum(F.col("w") * F.col(terms[i]) * F.col(terms[j])).alias(f"a{i}_{j}") for i, j in pairs],
            )
            # Of an entity: its diagonal entry and its gradient, the penalty included.
            sums = scratch.write(sums.withColumn("d", F.col("d") + F.col("l")).withColumn("g", F.col("g") - F.col("l") * F.col("effect")), f"sums{k}")
            left = sums.agg(*[F.sum(F.col(f"a{i}_{j}") - F.col(f"b{i}") * F.col(f"b{j}") / F.col("d")).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"g{i}") - F.col(f"b{i}") * F.col("g") / F.col("d")).alias(f"t{i}") for i in range(len(terms))]).first()
            a = np.zeros((len(terms), len(terms)))
            for i, j in pairs:
                a[i, j] = a[j, i] = left[f"s{i}_{j}"]
            step = np.linalg.solve(a + np.diag(penalty), np.array([left[f"t{i}"] for i in range(len(terms))]) - penalty * beta)
            beta = beta + step
            own = (F.col("g") - sum((F.lit(float(s)) * F.col(f"b{i}") for i, s in enumerate(step)), F.lit(0.0))) / F.col("d")
            effects = scratch.write(sums.select("e", "l", (F.col("effect") + own).alias("effect"), F.abs(own).alias("moved")), f"effects{k + 1}")
            if max(float(np.abs(step).max()), effects.agg(F.max("moved")).first()[0]) < SETTLED:
                break
            effects = effects.drop("moved")
        else:
            raise RuntimeError(f"not settled after {ROUNDS} rounds")
        return materialize(effects.select(F.col("e").alias(entity), "effect"), "entity-effects"), dict(zip(terms, beta.tolist(), strict=True))
