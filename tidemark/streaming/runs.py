"""Running a stream over the files there are, and stateful operators.

Streams read files as they land; `drain` processes what has landed and stops, which is how
tests and the registered queries hold a stream against its batch twin.  State is kept for
each key by Spark's state store, so a lost executor resumes from the checkpoint.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.windows import ordered_pass
from ..scratch import scratch_path as scratch
from ..sources.tables import micros
from .keyed import close


def tape_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The tape as a stream from Parquet files (a folder or a glob)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A lone file is not a folder: a glob that matches it alone is.
    e = reader.parquet(path[:-1] + f"[{path[-1]}]")
    return e.select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("us"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def drain(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, marks: str | None = None) -> DataFrame:
    """Process all there is, once, into Parquet, and read it back.

    Append: Spark's file sink, exactly-once.  Complete: each batch replaces the result.  Update: each batch
    is a folder of its number, which a batch that runs again replaces, and the last row for
    each of `keys` is the result.  marks: the folder of a stream's closing marks (keyed.with_marks); a mark is
    written when all is processed, and the query goes on from its checkpoint to its end."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode != "append":  # a stream without rows has an empty result
        into_batches(out)(spark.createDataFrame([], stream.schema), -1) if mode == "update" else spark.createDataFrame([], stream.schema).write.parquet(out)
    for ending in (False, True) if marks else (False,):
        if ending:
            close(spark, spark.read.parquet(marks).schema, marks)
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").start(out)
        elif mode == "complete":
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
        else:
            query = writer.foreachBatch(into_batches(out)).start()
        query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    every = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*[c if c in keys else f"_last.{c}" for c in stream.columns])


def into_batches(out: str) -> Callable[[DataFrame, int], None]:
    """A sink of foreachBatch that may see a batch twice: each batch has a folder of its number, which is replaced."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def per_key(stream: DataFrame, by: str, schema: str, state_schema: str, step: Callable[[tuple, pd.DataFrame, object], tuple[pd.DataFrame, tuple]], idle: int | None = None) -> DataFrame:
    """A stateful operator: step(key, rows in order of a batch, state or None) gives rows out
    and the new state.

    idle: a key's state goes when the watermark is so many milliseconds beyond its last row.
    The stream then needs a watermark on ts and the column ms, ts in milliseconds; rows at
    or before 1970 count as late then.  A key with rows in the batch keeps its state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["us", "seq"], kind="stable")
        out, new = step(key, rows, state.get if state.exists else None)
        state.update(new)
        if idle is not None:
            state.setTimeoutTimestamp(int(max(rows["ms"].max() + idle, state.getCurrentWatermarkMs() + 1)))
        yield out

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(by).applyInPandasWithState(run, schema, state_schema, "append", timeout)


def trailing_step(width: int):
    """Number and sum of flow over the last `width` up to each row; the state is the rows of
    that time, so that it is bounded by the key's rate.  Of rows of one instant the later
    ones see the earlier ones."""

    def step(key, rows, state):
        old_us, old_flow = state or ([], [])
        us = np.concatenate([np.asarray(old_us, "int64"), rows["us"].to_numpy("int64")])
        flow = np.concatenate([np.asarray(old_flow, "int64"), rows["flow"].to_numpy("int64")])
        run = np.concatenate([[0], np.cumsum(flow)])
        at = np.arange(len(old_us), len(us))
        # Rows that come late stand after newer ones: times never fall in what is searched.
        out_of = np.searchsorted(np.maximum.accumulate(us), us[at] - width, side="right")
        out = rows[["seq"]].assign(n12=at + 1 - out_of, flow12=run[at + 1] - run[out_of])
        keep = np.maximum.accumulate(us) > us.max() - width
        return out, (us[keep].tolist(), flow[keep].tolist())

    return step


def match_near(probes: list[tuple], quotes: list[tuple], width: int) -> list[tuple]:
    """(probe's seq, last quote at or before it, first one at or after it, time from which the
    answer is final) for probes and quotes (us, seq); quotes further off than width don't
    count and are null."""
    quotes = sorted(quotes)
    us = np.array([q[0] for q in quotes], "int64")
    out = []
    for t, seq in probes:
        i, j = int(us.searchsorted(t, "right")) - 1, int(us.searchsorted(t, "left"))
        left = quotes[i] if i >= 0 and t - quotes[i][0] <= width else None
        right = quotes[j] if j < len(quotes) and quotes[j][0] - t <= width else None
        out.append((seq, left and left[1], right and right[1], right[0] if right else t + width))
    return out


def paired(stream: DataFrame, by: str, probe: F.Column, width: int) -> DataFrame:
    """Streaming pairing: rows with `probe` true and their nearest other rows (quotes) of the
    same key before and after, at most `width` away: seq, before_seq, after_seq.

    The stream has us, seq and a watermark on ts.  A probe waits until the watermark has
    passed its next quote, or `width` where none comes, so that quotes within the watermark's
    delay may come in any order; a timer then sends it on.  Probes without a quote give no
    row.  State holds waiting probes and the quotes that they or later probes can meet."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p_us, p_seq, q_us, q_seq = state.get if state.exists else ([], [], [], [])
        probes, quotes = list(zip(p_us, p_seq, strict=True)), list(zip(q_us, q_seq, strict=True))
        for rows in [] if state.hasTimedOut else frames:
            for us, seq, is_probe in zip(rows["us"].tolist(), rows["seq"].tolist(), rows["probe"].tolist(), strict=True):
                (probes if is_probe else quotes).append((us, seq))
        mark = state.getCurrentWatermarkMs()
        closed = mark * 1000
        found = match_near(probes, quotes, width)
        final = [x[3] <= closed for x in found]
        done = [x[:3] for x, f in zip(found, final, strict=True) if f and (x[1] is not None or x[2] is not None)]
        waiting = [p for p, f in zip(probes, final, strict=True) if not f]
        since = min([closed, *[t for t, _ in waiting]]) - width
        quotes = [q for q in quotes if q[0] >= since]
        if waiting or quotes:
            due = min([x[3] for x, f in zip(found, final, strict=True) if not f] or [max(q[0] for q in quotes) + width + 1000])
            state.update(([t for t, _ in waiting], [n for _, n in waiting], [t for t, _ in quotes], [n for _, n in quotes]))
            state.setTimeoutTimestamp(max(mark + 1, -(-due // 1000) - 1))  # fires once the watermark is beyond it
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["seq", "before_seq", "after_seq"]).astype("Int64")

    rows = stream.select(by, "ts", "us", "seq", F.coalesce(probe, F.lit(False)).alias("probe"))
    arrays = "p_us array<long>, p_seq array<long>, q_us array<long>, q_seq array<long>"
    return rows.groupBy(by).applyInPandasWithState(run, "seq long, before_seq long, after_seq long", arrays, "append", GroupStateTimeout.EventTimeTimeout)


def book_message(book: dict[int, int], kind: str, cents: int, k: int) -> tuple:
    """Best levels after a message, which changes the book: signup replaces it by one level,
    a size (k) of 0 to 9 deletes its price, any other sets it.  Prices are in whole units."""
    price = int(cents) // 100
    if kind == "signup":
        book.clear()
        book[price] = int(k)
    elif k < 10:
        book.pop(price, None)
    else:
        book[price] = int(k)
    top = heapq.nlargest(5, book)
    return (top[0] if top else None, sum(book[p] for p in top), len(book))


BOOK = "key long, seq long, best long, depth5 long, levels long"


def book_step(book, row):
    """book_message as a step of keyed.Book, which changes the book in place."""
    book = {} if book is None else book
    return book, (row["seq"], *book_message(book, row["kind"], row["cents"], row["k"]))


def book_batch(tape: DataFrame) -> DataFrame:
    """The batch twin of the stateful book: one ordered pass, the book is its state.  Messages
    without a price or size are no messages."""

    def step(book, *message):
        book = {} if book is None else book
        return book, book_message(book, *message)

    rows = tape.select("key", "us", "seq", "kind", "cents", "k").dropna()
    return ordered_pass(rows, ["key"], ["us", "seq"], ["kind", "cents", "k"], {"best": "long", "depth5": "long", "levels": "long"}, step).select("key", "seq", "best", "depth5", "levels")
