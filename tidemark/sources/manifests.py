"""Manifests of files by content: digests of chunks of rows, of files, and what has changed.

A file's rows are numbered by Spark's readers, so that a file of any size is digested in chunks
by many tasks, through any file system that Spark reads.  A row's digest takes in its number and all
its values; a chunk's is the sum of its rows' (four 64-bit numbers and the count), so rows
are summed where they are read and need no order; a file's is the digest of its chunks' in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def content_sum(*columns: str, number: Column | None = None) -> Column:
    """Aggregate: a digest of a group's rows, in any order (in the order of number, if given)."""
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(sorted(columns))]
    row = F.to_json(F.struct(*fields, *([number.alias("at")] if number is not None else [])), {"ignoreNullFields": "false"})
    word = lambda i: F.sum(F.conv(F.substring(F.sha2(row, 256), 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), *[F.coalesce(word(i), F.lit("0")) for i in range(4)]), 256)


def chunk_digests(spark: SparkSession, paths: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """file (its path), chunk, rows, digest of Parquet files; a file without rows has no chunk."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    columns = rows.columns
    numbered = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return numbered.groupBy(F.col("_file").alias("file"), F.expr(f"_at div {chunk_rows}").alias("chunk")).agg(F.count(F.lit(1)).alias("rows"), content_sum(*columns, number=F.col("_at")).alias("digest"))


def file_digests(chunks: DataFrame, name: Column | str = "file") -> DataFrame:
    """file, rows, digest, from its chunks; name may take files together (a folder's, say)."""
    name = F.col(name) if isinstance(name, str) else name
    each = F.sort_array(F.collect_list(F.struct("file", "chunk", "digest")))
    digests = F.sha2(F.concat_ws(" ", F.transform(each, lambda x: x["digest"])), 256)
    return chunks.groupBy(name.alias("file")).agg(F.sum("rows").alias("rows"), digests.alias("digest"))


def compare(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status (same, changed, missing, new) of every entry of two manifests."""
    both = expected.select(*keys, F.col("digest").alias("_a")).join(found.select(*keys, F.col("digest").alias("_b")), keys, "full")
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return both.select(*keys, status.alias("status"))
