"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the session names none, a local master (tests) gets a temporary folder of this
    machine, which also becomes the checkpoint folder; a cluster, whose executors would not
    see it, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def sized(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """df in no more tasks than so many rows need, eight at least: small tables would
    otherwise cost a task for every shuffle partition at each step."""
    return df.coalesce(max(8, -(-rows // per_task)))


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet to path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage
    in a way that survives lost executors.  rows: about how many there are, if known."""
    df = df if rows is None else sized(df, rows)
    return written(df, scratch_path(df.sparkSession, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Intermediate tables of one operator, deleted together when its result is written.

    with Scratch(spark, "join") as scratch: table = scratch.write(df, "pairs")"""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_path(spark, name)

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        return written(df if rows is None else sized(df, rows), f"{self.path}/{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        discard(self.spark, self.path)
