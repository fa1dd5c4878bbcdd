"""The input tables under the names the operators use.

tape     ticks of a key: key, ts, us (microseconds since 1970), seq, kind, cents, value, k
facts    dated facts of an entity: fact, entity, day (days since 1970), won, cents, class
steps    ordered steps of a group: grp, step (1..n), win, side, qty, cents, part, supp, day
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: What steps are dealt and ordered by.
STEP_KEYS = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def days(column: str) -> F.Column:
    return F.expr(f"cast(datediff({column}, date'1970-01-01') as bigint)")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), "ts", micros("ts").alias("us"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("fact"), F.col("o_custkey").alias("entity"), days("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("won"),
        F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderpriority").alias("class"),
    )


def step_order() -> WindowSpec:
    """The order of a group's steps, over the input's own columns."""
    return Window.partitionBy("l_orderkey").orderBy(*STEP_KEYS[1:])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("grp"), F.row_number().over(step_order()).cast("bigint").alias("step"), (F.col("l_returnflag") == "R").alias("win"), F.col("l_linestatus").alias("side"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("bigint").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), days("l_shipdate").alias("day"), F.col("l_linenumber").cast("bigint").alias("line"),
    )
