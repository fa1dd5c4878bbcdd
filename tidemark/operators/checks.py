"""Data-quality gates: reasons, quarantine, cardinality and schema contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, null if none does; null conditions don't hold."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules])


def quarantine(df: DataFrame, group: list[str], reason: str = "reason") -> DataFrame:
    """Rows of groups without any reason: one bad row takes its group out."""
    bad = df.where(F.col(reason).isNotNull()).select(*group).distinct()
    return df.join(bad, group, "left_anti").drop(reason)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """A join whose right keys must be unique (and left ones too): fails while it runs, naming
    the key, rather than multiplying rows.  Adds _found."""
    unique = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*on))).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate join key: "), F.to_json(F.struct(*on))))).otherwise(F.col("_n")))
    ours = unique(left).where("_n = 1").drop("_n") if one_to_one else left
    theirs = unique(right).where("_n = 1").drop("_n").withColumn("_found", F.lit(True))
    return ours.join(theirs, on, how).withColumn("_found", F.coalesce("_found", F.lit(False)))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_roles(df: DataFrame, roles: dict[str, list[str]], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Columns marked with their role; roles must be disjoint and cover every column."""
    named = [c for cols in roles.values() for c in cols]
    if len(named) != len(set(named)):
        raise ValueError("a column has two roles")
    if set(named) != set(df.columns):
        raise ValueError(f"columns without a role or roles without a column: {sorted(set(named) ^ set(df.columns))}")
    banned = set(roles.get("feature", ())) & set(forbidden)
    if banned:
        raise ValueError(f"not allowed as features: {sorted(banned)}")
    return df.select(*[F.col(c).alias(c, metadata={"role": r}) for r, cols in roles.items() for c in cols])
