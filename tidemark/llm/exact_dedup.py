"""Exact dedup by deterministic block naming (built-in functions only).

A text, with ASCII white space deleted, is cut into blocks of a fixed number of
code points.  Every distinct block gets an integer name: blocks are dealt to
buckets by a 64-bit value, the distinct blocks that share a bucket are sorted,
and the name is bucket and place in that order.  Equal blocks so have equal names
and different blocks never share one, whatever the 64-bit values do.  Adjacent
names are then named as pairs in the same way, level by level, until one name
stands for the whole text.  (number of blocks, last name) is its identity.

Scale: one shuffle moves block text, map-side combined, so thousands of copies of
a block travel once per task; the levels above move integers only.  Buckets with
more than one distinct block are rare (none below some 10^9 blocks), so the join
that hands out places inside a bucket runs only when such a bucket exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, unused

BLOCK_CHARS = 1024
#: A name: bucket * 65536 + place, beyond the range of a long.
NAME = "decimal(26,0)"


def normalized(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _bucket(key: list[Column], bits: int) -> Column:
    h = F.xxhash64(*key)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def _contested(keys: DataFrame, bits: int, label: str) -> DataFrame | None:
    """Buckets with several distinct keys: (bucket, key, place) in sorted order, or
    None where every bucket has one key.  keys: column key."""
    per_bucket = keys.groupBy(_bucket([F.col("key")], bits).alias("bucket")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = materialize(per_bucket.where("low <> high").select("bucket"), f"{label}-shared")
    if shared.isEmpty():
        return None
    rivals = keys.withColumn("bucket", _bucket([F.col("key")], bits)).join(shared, "bucket", "left_semi").distinct()
    order = F.sort_array(F.collect_list("key"))
    return materialize(rivals.groupBy("bucket").agg(order.alias("keys")).select("bucket", F.posexplode("keys").alias("place", "key")), f"{label}-places")


def _name_level(texts: DataFrame, bits: int, label: str) -> DataFrame:
    """texts: rid, keys (array of blocks or pairs).  Returns rid, names (array of NAME)."""
    rivals = _contested(texts.select(F.explode("keys").alias("key")), bits, label)
    if rivals is None:
        return texts.select("rid", F.transform("keys", lambda k: (_bucket([k], bits).cast(NAME) * 65536).cast(NAME)).alias("names"))
    each = texts.select("rid", F.posexplode_outer("keys").alias("at", "key")).withColumn("bucket", _bucket([F.col("key")], bits))
    placed = each.join(rivals, ["bucket", "key"], "left").withColumn("name", (F.col("bucket").cast(NAME) * 65536 + F.coalesce("place", F.lit(0))).cast(NAME))
    in_order = F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "name"))))
    return placed.groupBy("rid").agg(F.transform(in_order, lambda x: x["name"]).alias("names"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, bucket_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_points (code points of the text as it is),
    text_sha256, n_blocks, name.  Equal (n_blocks, name) means equal text.

    Every row is a document, repeated rows too; a null id is an id like any other.  An
    empty or null text has no block and the name 0.
    bucket_bits below 64 is for tests: it forces blocks to share buckets."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"), normalized(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("row"))
    blocks = base.withColumn("keys", F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    rows = blocks.select(F.struct("row", "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.size("keys").alias("n_blocks")).alias("rid"), "keys")
    level = materialize(_name_level(rows, bucket_bits, "blocks"), "names")
    done = level.where(F.size("names") <= 1)
    todo = level.where(F.size("names") > 1)
    longest, depth = todo.agg(F.max(F.size("names"))).first()[0] or 1, 0
    while longest > 1:
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1).cast(NAME)).alias("b"))
        pairs = todo.select("rid", F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), pair).alias("keys"))
        todo = materialize(_name_level(pairs, bucket_bits, f"pairs{depth}"), f"level{depth}")
        longest, depth = (longest + 1) // 2, depth + 1
    every = done.unionByName(todo) if depth else done
    return every.select("rid.*", F.coalesce(F.get("names", F.lit(0)), F.lit(0).cast(NAME)).alias("name")).drop("row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per document, dropped ones too.

    Of equal texts the document with the most code points in its original text
    stays, then the smallest id (a null id comes last); rows that repeat that id with an
    equal text are marked kept as well.  A text of any length is cut into blocks and named level by level.  Empty
    tables give no rows; other columns of docs are not looked at."""
    each = materialize(identities(docs, id_col, text_col, **named), "identity")
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    # Written first: the join below then has plain shuffles on both sides, which adaptive
    # execution splits where one group of copies is large.
    groups = each.groupBy("n_blocks", "name").agg(best["c"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    return each.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text, one.

    Null and empty texts are equal texts; empty tables give no rows; columns of docs may
    have any names."""
    sha, kept = unused(docs, "sha"), unused(docs, "kept")
    found = materialize(exact_dedup(docs, id_col, text_col), "exact").where("kept").select(F.struct("doc_id", "text_sha256").alias(kept))
    # Ids need not be unique: a row stays if its id and its text do.
    hashed = docs.withColumn(sha, F.sha2(normalized(F.col(text_col)), 256))
    stay = hashed.join(found, F.col(id_col).eqNullSafe(F.col(kept)["doc_id"]) & (F.col(sha) == F.col(kept)["text_sha256"]), "left_semi")
    again = docs.groupBy(F.col(id_col)).count().where("count > 1").limit(1)
    return (stay if again.isEmpty() else stay.dropDuplicates([id_col, sha])).drop(sha)
