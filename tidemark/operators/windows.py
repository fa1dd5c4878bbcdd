"""Ordered-group helpers: islands, running values before a row, trailing windows, cooldowns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .asof import asof

ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
SPARK = {"boolean": BooleanType(), "long": LongType(), "double": DoubleType(), "string": StringType()}


def before(by: list[str], order: list) -> Window:
    """All earlier rows of the group, this one left out."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(by: list[str], order: str) -> Window:
    """Rows with a strictly smaller order value: rows at the same instant don't see each other."""
    return Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)


def islands(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Number of the run a row is in; a row with `breaks` true starts a new run."""
    return df.withColumn(name, F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(upto(by, order)))


def trailing_sum(df: DataFrame, by: list[str], on: str, order: str, value: str, width: int, name: str) -> DataFrame:
    """Sum of value over (t - width, t], causal among rows of the same time: the running
    sum at a row less the running sum at the last row at or before t - width."""
    run = df.withColumn("_run", F.sum(value).over(upto(by, [on, order])))
    probes = run.withColumn("_t", F.col(on)).withColumn(on, F.col(on) - width)
    found = asof(probes, run.select(*by, on, order, "_run"), by, on, ["_run"], order, prefix="_p")
    return found.withColumn(on, F.col("_t")).withColumn(name, F.coalesce(F.col("_run"), F.lit(0)) - F.coalesce(F.col("_p_run"), F.lit(0))).drop("_t", "_run", *[c for c in found.columns if c.startswith("_p")])


def ordered_pass(df: DataFrame, by: list[str], order: list[str], values: list[str], adds: dict[str, str], step: Callable) -> DataFrame:
    """Each key's rows in order through one sequential pass; adds the columns `adds` (name to type).

    step(state, *values of the row) gives (new state, values of the added columns); the state
    is None at a key's first row.  Rows are sorted inside their partitions and come in Arrow
    batches, with the state carried from batch to batch: a key of any size needs the memory
    of one batch and of its state.  Null keys are one key; nulls in `order` come first."""
    names = df.columns
    key_at, value_at = [names.index(c) for c in by], [names.index(c) for c in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in key_at], strict=True)
            rows = zip(*[batch.column(i).to_pylist() for i in value_at], strict=True)
            out = []
            for k, row in zip(keys, rows, strict=True):
                if k != key:
                    key, state = k, None
                state, new = step(state, *row)
                out.append(new)
            added = [pa.array([new[i] for new in out], ARROW[kind]) for i, kind in enumerate(adds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *adds])

    schema = StructType([*df.schema.fields, *[StructField(name, SPARK[kind]) for name, kind in adds.items()]])
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def cooldown(df: DataFrame, by: list[str], on: str, order: str, width: int) -> DataFrame:
    """Greedy selection: a row is taken if `width` has passed since the last taken one.

    What is taken depends on what was, so no window expresses it.  A row without a time is
    never taken."""

    def take(last, t):
        ok = t is not None and (last is None or t - last >= width)
        return (t if ok else last), (ok,)

    return ordered_pass(df, by, [on, order], [on], {"_taken": "boolean"}, take).where("_taken").drop("_taken")


def monotone(df: DataFrame, by: list[str], on: str, order: str, values: list[str]) -> DataFrame:
    """Quarantine against the last accepted row: a row is accepted if none of its values is
    below the last accepted row's.  With several values no running maximum gives this, as
    a rejected row must not move the bar.  Rows with a null value are not accepted.  Adds accepted."""

    def mark(bar, *row):
        good = None not in row and (bar is None or all(a >= b for a, b in zip(row, bar, strict=True)))
        return (row if good else bar), (good,)

    return ordered_pass(df, by, [on, order], values, {"accepted": "boolean"}, mark)
