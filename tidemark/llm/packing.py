"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

A document becomes token ids and an end id, cut into pieces of max_len and a rest.
The histogram of piece lengths (max_len entries, whatever the corpus) goes to the
driver, where lengths are placed longest first, each onto the packs that are
shortest so far.  Packs with the same filling are one counted pattern, a run of
consecutive sequence numbers, so the plan has a few thousand entries for any corpus.
Pieces then find their place by rank among the pieces of their length.

Scale: one pass over the text, which writes one narrow row a piece; ranks are counted
inside (length, bucket) groups of bounded size and offset by a running sum over the
buckets' counts, so a length that a third of all pieces have is no hot group.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import encoder
from .common import materialize

MAX_LEN = 1024
#: Pieces in one (length, bucket) group, on average.
GROUP_ROWS = 20_000
#: Entries of a placement plan that may be broadcast (some 40 bytes each).
MAX_PLAN = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids: doc_id, start, length, ids_crc32, doc_tokens and,
    with_ids, ids.  Null text counts as empty: one piece that holds the end id."""

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*enc(text.as_py() or ""), end_id], np.uint32)
                for s in range(0, len(ids), max_len):
                    part = ids[s : s + max_len]
                    rows.append((key, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            out = {n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), cols, strict=False)}
            if with_ids:
                out["ids"] = pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): pieces of that length with
    these ranks go one each to consecutive sequences, at that offset."""
    plan, fresh, heap = [], 0, []  # heap: (filling, first sequence, sequences)
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= max_len:
            raise ValueError(f"length {length} doesn't fit into {max_len}")
        rank, left = 0, histogram[length]
        while left:
            if heap and heap[0][0] + length <= max_len:
                used, first, n = heapq.heappop(heap)
                k = min(n, left)
                if k < n:
                    heapq.heappush(heap, (used, first + k, n - k))
            else:
                used, first, k = 0, fresh, left
                fresh += k
            plan.append((length, rank, k, first, used))
            if used + length < max_len:
                heapq.heappush(heap, (used + length, first, k))
            rank, left = rank + k, left - k
    return plan


def place_pieces(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """pieces (doc_id, start, length, ...; read more than once) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    plan = shortest_pack_first(histogram, max_len)
    buckets = max(1, math.ceil(max(histogram.values(), default=0) / GROUP_ROWS))
    at = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    inside = at.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = inside.join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    steps = spark.createDataFrame(plan, "_length long, _from long, _n long, _seq long, offset long")
    steps = F.broadcast(steps) if len(plan) <= MAX_PLAN else steps
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n"))
    placed = ranked.join(steps, fits)
    return placed.withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_from")).drop("_bucket", "_rank", "_base", "_length", "_from", "_n", "_seq")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, offset, sequence_id and,
    with_ids, ids.  Repeated rows are packed as often as they come, rows with a null id as well; a
    text of any length is as many pieces as it needs; an empty table
    gives no rows; other columns of docs are not looked at."""
    pieces = materialize(token_pieces(docs, tokenizer, max_len, end_id, with_ids, id_col, text_col), "pieces")
    return place_pieces(pieces, max_len)


def assemble(packed: DataFrame) -> DataFrame:
    """Sequences from pieces that carry ids: sequence_id, ids, doc_ids, used."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.aggregate("p", F.lit(0), lambda a, x: a + F.size(x["ids"])).alias("used"))
