"""Incremental runs over folders of files that survive being stopped at any time.

A run writes its manifest (the parts and the digests of their files) first, then works through the parts in waves.
A wave's shards are written, read back and digested, and only then entered in the run's commit
log, one entry a shard, in a file that appears whole or not at all.  A run that is started
again in the same place reads the log: what is entered and still has the digest that was
entered is not worked on again, a shard that was being written is replaced, and a shard that has been tampered
with stops the run.  A finished run has an audit and is never touched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import chunk_digests, content_sum, file_digests

#: Shards of a wave.
WAVE = 64
PART = "part=([^/]+)"
ENTRY = "part string, digest string, n long, p long, content string, status string, reason string, shards string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is there (its success mark is)."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def commit(entries: DataFrame, log: str) -> None:
    """Add entries to the log: one file, which appears by a rename once it is whole."""
    entries.coalesce(1).write.mode("append").parquet(log)


def shard_contents(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """part, shards, found: the digests of the shards that entries name, as they are now."""
    out = None
    for (folder,) in entries.select("shards").distinct().collect():  # one a run
        rows = spark.read.parquet(folder)
        some = rows.groupBy(F.col("part").cast("string").alias("part")).agg(content_sum(*[c for c in rows.columns if c != "part"]).alias("found"))
        out = some.withColumn("shards", F.lit(folder)) if out is None else out.unionByName(some.withColumn("shards", F.lit(folder)))
    return out if out is not None else entries.select("part", F.lit(None).cast("string").alias("found"), "shards").where("false")


def run_shards(spark: SparkSession, folders: list[str], out: str, before: DataFrame | None, wave: int = WAVE) -> DataFrame:
    """One run over folders of Parquet files that are named part=value: works on what isn't verified and
    returns the audit, also written below `out`: part, digest, n, p (purchases), content (digest of the shard), status (ok,
    error, skipped), reason, shards (where its shard lies).

    before: the audit of an earlier run.  A part is verified where it was ok or skipped there, its files'
    digest is the same, and its shard still has the content that was entered; else it is done anew
    ("changed").  Parts without a purchase are errors, and their rows go to a folder of their own.

    A run that was stopped goes on when it is called again in the same way.  ValueError: it is called
    with other parts or files than before, or a shard that it has entered is not what it was.
    FileExistsError: it is finished."""
    if exists(spark, f"{out}/audit"):
        raise FileExistsError(f"{out} holds a finished run")
    name = F.regexp_extract("file", PART, 1)
    manifest = file_digests(chunk_digests(spark, folders), name).select(F.col("file").alias("part"), F.col("digest"))
    if exists(spark, f"{out}/manifest"):
        old = spark.read.schema(manifest.schema).parquet(f"{out}/manifest")
        if not old.exceptAll(manifest).isEmpty() or not manifest.exceptAll(old).isEmpty():
            raise ValueError(f"the files are not those that the run in {out} began with")
    else:
        manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    manifest = spark.read.schema(manifest.schema).parquet(f"{out}/manifest")
    log = f"{out}/commits"
    entered = spark.read.schema(ENTRY).parquet(log) if exists(spark, log) else spark.createDataFrame([], ENTRY)
    now = entered.join(shard_contents(spark, entered), ["part", "shards"], "left").where(~F.col("content").eqNullSafe(F.col("found")))
    if bad := [r["part"] for r in now.select("part").sort("part").limit(10).collect()]:
        raise ValueError(f"shards that were entered have changed: {', '.join(bad)}")
    todo = manifest.join(entered.select("part"), "part", "left_anti").withColumn("reason", F.lit("new"))
    verified = spark.createDataFrame([], ENTRY)
    if before is not None:
        old = before.where("status <> 'error'").select("part", F.col("digest").alias("old"), "n", "p", "content", "shards")
        met = todo.drop("reason").join(old.join(shard_contents(spark, old), ["part", "shards"], "left"), "part", "left")
        same = F.coalesce((F.col("old") == F.col("digest")) & (F.col("content") == F.col("found")), F.lit(False))
        verified = met.where(same).select("part", "digest", "n", "p", "content", F.lit("skipped").alias("status"), F.lit("verified").alias("reason"), "shards")
        todo = met.where(~same).select("part", "digest", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("reason"))
    # Part names and their digests: statistics of the run, whatever the files hold.
    todo = todo.withColumn("wave", F.expr(f"(row_number() OVER (ORDER BY part) - 1) div {wave}"))
    todo.write.mode("overwrite").parquet(f"{out}/todo")
    todo = spark.read.schema(todo.schema).parquet(f"{out}/todo")
    rows = spark.read.option("basePath", folders[0].rsplit("/", 1)[0]).parquet(*folders).withColumn("part", F.col("part").cast("string"))
    for k in range((todo.agg(F.max("wave")).first()[0] or 0) + 1 if not todo.isEmpty() else 0):
        work_wave(rows, todo.where(F.col("wave") == k), out, log)
    entered = spark.read.schema(ENTRY).parquet(log) if exists(spark, log) else entered
    entered.unionByName(verified).write.parquet(f"{out}/audit")
    return spark.read.schema(ENTRY).parquet(f"{out}/audit")


def work_wave(rows: DataFrame, todo: DataFrame, out: str, log: str) -> None:
    """Write the shards of a wave, in place of any that a stopped run has left, read them back and enter them."""
    spark, ours = rows.sparkSession, rows.join(todo.select("part"), "part", "left_semi")
    good = rows.where("kind = 'purchase'").select("part").distinct()
    shards, refused = f"{out}/rows", f"{out}/refused"
    for place, how in ((shards, "left_semi"), (refused, "left_anti")):
        ours.join(good, "part", how).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(place)
    entries = None
    for place, status in ((shards, "ok"), (refused, "error")):
        back = spark.read.schema(rows.schema).parquet(place).withColumn("part", F.col("part").cast("string"))
        back = back.join(todo.select("part"), "part", "left_semi")
        some = back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "purchase").alias("p"), content_sum(*[c for c in rows.columns if c != "part"]).alias("content"))
        some = some.withColumns({"status": F.lit(status), "shards": F.lit(place)})
        entries = some if entries is None else entries.unionByName(some)
    reason = F.when(F.col("status") == "error", "no_purchase").otherwise(F.col("reason"))
    entries = entries.join(todo.select("part", "digest", "reason"), "part").select("part", "digest", "n", "p", "content", "status", reason.alias("reason"), "shards")
    commit(entries, log)
