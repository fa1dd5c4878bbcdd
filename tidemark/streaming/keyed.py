"""Keyed processors on Spark's stateful processor API: rows in order of time, state that expires.

A key's rows wait in list state until the watermark has passed them; a timer then hands them on in order,
so that rows that come late, within the watermark's delay, take their place instead of the place of their
arrival.  What a key has learnt so far is value state.  It goes once the key has been silent for `idle`; as that
is measured between rows as well, it does not depend on how rows fall into batches, and `in_order_batch`
gives the same rows from a table.  State lives in the RocksDB store, so it may be larger than memory,
and a lost executor resumes from the checkpoint.

Each call of a state variable is a message from Python to the executor and back, which costs more than the work on a
hundred rows.  Keys are therefore dealt to GROUPS by a hash, and a group is what Spark's state belongs to: its keys'
rows wait as Arrow tables, an element for each frame of a batch, what its keys have learnt is one value, and it has one timer.
Messages grow with the groups that a batch touches and with frames of rows, not with keys.  An element is bytes to the store, which
would turn lists into objects value by value, on both sides and both ways.  A task holds a group's waiting rows, as Arrow
columns; CHUNK of them at a time are Python values.
Rows reach Python in frames, numbers as text, as a frame would turn longs beside a null into doubles.

A stream that ends (tests, a backfill) leaves its last rows waiting: `with_marks` adds an empty source
to which `close` writes one row of a far future, the mark that all rows have come, when `drain` goes on
from the same checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DecimalType, FractionalType, IntegralType, StructType

from ..operators.windows import ordered_pass

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt to, fixed for a stream's life; rows of an element of rows put back to wait, of those handed on and of what comes out at a time.
GROUPS, CHUNK = 1024, 10_000
#: Event time of the mark that closes a stream.
END = "9000-01-01 00:00:00"

#: step(state or None, row by column) gives the new state (a tuple) and the row's outputs (a tuple), or None for no row out.
Step = Callable[[tuple | None, dict], tuple[tuple | None, tuple | None]]


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start here keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(stored))).read_all()


def _listed(column: pa.Array) -> list:
    whole = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if whole else column.to_pylist()  # the same values, made at once


class InOrder(StatefulProcessor):
    """See the module; columns: those of the rows that wait (key, us, seq first), numbers: what their texts are read as, known: schema of what keys have learnt, out: columns that come out."""

    #: Schema of a key's state where it is the processor's own.
    KEPT = ""

    def __init__(self, columns: list[str], numbers: list[type | None], known: str, out: list[str], step: Step, idle: int):
        self.columns, self.numbers, self.known_as, self.out, self.step, self.idle = columns, numbers, known, out, step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.known = handle.getValueState("known", self.known_as)  # keys, times of their last rows handed on, states
        self.alarm = handle.getValueState("alarm", "at long")  # of the timer

    @staticmethod
    def _stored(state) -> tuple:
        return state

    @staticmethod
    def _restored(stored):
        return tuple(stored)

    def _set_alarm(self, at: int, old: int | None) -> None:
        if old is not None and old != at:
            self.handle.deleteTimer(old)
        if old != at:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for frame in rows:
            some = pa.table([pa.array([None if v is None or v != v else as_(v) if as_ else v for v in frame[f"c{i}"].tolist()]) for i, as_ in enumerate(self.numbers)], self.columns)
            self.waiting.appendValue((_packed(some),))
            firsts.append(pc.min(some["us"]).as_py())
        alarm, old = -(-min(firsts) // 1000), self.alarm.get()
        # An alarm for expiry, or for later rows, makes way for an earlier one.
        self._set_alarm(alarm if old is None else min(alarm, old[0]), None if old is None else old[0])
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for (stored,) in self.waiting.get():
            some = _unpacked(stored)
            passed = pc.less_equal(some["us"], mark * 1000)
            ready.append(some.filter(passed))
            rest.append(some.filter(pc.invert(passed)))
        rest = [some for some in rest if some.num_rows]
        found = self.known.get()
        known = {k: (last, None if state is None else self._restored(state)) for k, last, state in zip(*found, strict=True)} if found else {}
        if any(some.num_rows for some in ready):
            # An element's columns of nulls alone have no type yet, and decimals the digits they need.
            rows = pa.concat_tables(ready, promote_options="permissive").combine_chunks().sort_by([("us", "ascending"), ("seq", "ascending")])
            made, names, keyed = [], self.columns[1:], self.out[0] == self.columns[0]
            for some in rows.to_batches(CHUNK):
                for k, *r in zip(*map(_listed, some.columns), strict=True):
                    last, state = known.get(k, (None, None))
                    if last is not None and r[0] - last > self.idle:
                        state = None
                    state, out = self.step(state, dict(zip(names, r, strict=True)))
                    known[k] = (r[0], state)
                    if out is not None:
                        made.append((k, *out) if keyed else out)
                    if len(made) >= CHUNK:
                        yield self._out(made)
                        made = []
            if made:
                yield self._out(made)
            if rest:
                self.waiting.put([(_packed(pa.Table.from_batches([some])),) for some in pa.concat_tables(rest, promote_options="permissive").combine_chunks().to_batches(CHUNK)])
            else:
                self.waiting.clear()
        gone = {k: -(-(last + self.idle) // 1000) + 1 for k, (last, _) in known.items()}
        stay = [k for k in known if gone[k] > mark]
        if stay:
            self.known.update((stay, [known[k][0] for k in stay], [None if known[k][1] is None else self._stored(known[k][1]) for k in stay]))
        else:
            self.known.clear()
        due = [*(gone[k] for k in stay), *(-(-pc.min(some["us"]).as_py() // 1000) for some in rest)]
        if due:
            self._set_alarm(min(due), None)
        else:
            self.alarm.clear()

    def _out(self, made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(values, dtype=object) for c, values in zip(self.out, zip(*made, strict=True), strict=True)})

    def close(self) -> None:
        pass


class Book(InOrder):
    """A key's state is a map of prices, which step changes in place."""

    KEPT = "prices array<long>, sizes array<long>"

    @staticmethod
    def _stored(book: dict) -> tuple:
        return [*book], [*book.values()]

    @staticmethod
    def _restored(stored) -> dict:
        return dict(zip(*stored, strict=True))


def in_order(stream: DataFrame, key: str, columns: list[str], kept: str, out: str, step: Step, idle: int, processor: type[InOrder] = InOrder) -> DataFrame:
    """step over each key's rows in order of (us, seq).  stream: key, us, seq, columns and a watermark
    on ts; kept: the state's schema; out: the rows that come out, with the key first if they have it;
    idle: microseconds of silence after which a key begins anew.  Rows later than the watermark are dropped
    by Spark and counted in its progress."""
    columns = [key, "us", "seq", *[c for c in columns if c not in ("us", "seq")]]
    known = f"keys array<{stream.schema[key].dataType.simpleString()}>, last array<long>, state array<{StructType.fromDDL(processor.KEPT or kept).simpleString()}>"
    kinds = [stream.schema[c].dataType for c in columns]
    numbers = [int if isinstance(t, IntegralType) else float if isinstance(t, FractionalType) and not isinstance(t, DecimalType) else None for t in kinds]
    made = processor(columns, numbers, known, StructType.fromDDL(out).names, step, idle)
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("of"), "ts", *[(F.col(c).cast("string") if n else F.col(c)).alias(f"c{i}") for i, (c, n) in enumerate(zip(columns, numbers, strict=True))])
    return rows.groupBy("of").transformWithStateInPandas(made, out, "append", "EventTime")


def in_order_batch(rows: DataFrame, key: str, columns: list[str], out: str, step: Step, idle: int) -> DataFrame:
    """The rows that `in_order` gives, from a table."""
    columns = ["us", "seq", *[c for c in columns if c not in ("us", "seq")]]
    fields = StructType.fromDDL(out)
    extra = {f.name: f.dataType.typeName() for f in fields if f.name not in (key, *columns)}
    also = [f.name for f in fields if f.name not in extra]

    def go(state, *values):
        last, inner = state or (None, None)
        row = dict(zip(columns, values, strict=True))
        if last is not None and row["us"] - last > idle:
            inner = None
        inner, made = step(inner, row)
        named = dict(zip([n for n in fields.names if n != key], made, strict=True)) if made is not None else {}
        return (row["us"], inner), (made is not None, *[named.get(c) for c in extra])

    passed = ordered_pass(rows.select(key, *columns), [key], ["us", "seq"], columns, {"_out": "boolean"} | extra, go)
    return passed.where("_out").select(*[c for c in fields.names if c in also or c in extra])


def with_marks(stream: DataFrame, marks: str, delay: str) -> DataFrame:
    """stream (with a column ts) and its closing marks under one watermark; marks: a folder of this stream's own."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(marks)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks)).withWatermark("ts", delay)
    return both.where(F.col("ts") < F.lit(END).cast("timestamp"))  # on ts: a filter that stays above the watermark


def close(spark: SparkSession, schema: StructType, marks: str) -> None:
    """Write the mark that closes a stream."""
    row = spark.range(1).select(*[(F.lit(END).cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    row.write.mode("append").parquet(marks)


# Steps.


def changes(column: str) -> Step:
    """Rows whose value is not the one before."""

    def step(state, row):
        return (row[column],), (row["seq"],) if state is None or state[0] != row[column] else None

    return step


def eligible(gap: int, settle: int) -> Step:
    """Whether more than `settle` has passed since the key's last start, which is its first row or
    one after a silence of more than `gap`."""

    def step(state, row):
        start, last = state or (None, None)
        start = row["us"] if last is None or row["us"] - last > gap else start
        return (start, row["us"]), (row["seq"], row["us"] - start > settle)

    return step


def cooldown(width: int) -> Step:
    """Rows that are taken: `width` has passed since the last one taken."""

    def step(state, row):
        if state is not None and row["us"] - state[0] < width:
            return state, None
        return (row["us"],), (row["us"], row["seq"])

    return step


def monotone(column: str) -> Step:
    """Whether the value isn't below the last accepted one."""

    def step(state, row):
        good = state is None or row[column] >= state[0]
        return (row[column],) if good else state, (row["seq"], good)

    return step


def totals(column: str) -> Step:
    """Rows so far and the sum of a column, null while all its values are."""

    def step(state, row):
        n, total = state or (0, None)
        value = row[column]
        total = total if value is None else value + (total or 0)
        return (n + 1, total), (row["seq"], n + 1, total)

    return step
