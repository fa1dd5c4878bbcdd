"""Token ids in ORC files, ordered by document id.

Documents are dealt to tasks by ranges of their id and sorted there, so each file,
stripe and row group covers a narrow range of ids: its statistics and the Bloom
filters on doc_id let a reader skip stripes and row groups without decoding ids.
Integer columns use ORC's run-length encoding.  Readers take stripes in parallel.

Scale: the text crosses the network once (a range shuffle); ids are made after it
and go straight to the files.  Offsets over all documents come from sums a file, not
from one long sort.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import encoder

END_ID = 2
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write doc_id, ids (with the end id), n_tokens in ascending doc_id order.

    Null text counts as empty (the end id alone); null ids come first; repeated rows
    are written as often as they come, in the order of their texts."""

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids = [np.array([*enc(t.as_py() or ""), end_id], np.int32) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(np.diff(ends), pa.int64())], ["doc_id", "ids", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long").write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; doc_ids is pushed down to stripe statistics and Bloom filters."""
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long").orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else rows


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    One row for each row written: repeated ids have places of their own, side by side in
    some order; null ids come first; files without rows give none."""

    def sums(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    rows = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"))
    each = rows.mapInArrow(sums, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")
    # Files are numbered in id order, and rows inside a file are in id order.
    total = read_tokens(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    before = total.select("file", F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("start", F.coalesce(inside, F.lit(0))).join(before, "file").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
