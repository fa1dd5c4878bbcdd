"""Reading and writing tapes: JSON lines with bad lines counted or refused, upserts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path, schema: str, bad: str = "skip") -> DataFrame:
    """Rows of JSON-lines files.  bad lines (not an object of this schema): "skip" leaves
    them out, "keep" returns them with column _bad, "fail" stops with file and line text."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return parse_lines(rows, schema, bad)


def parse_lines(rows: DataFrame, schema: str, bad: str = "skip") -> DataFrame:
    """rows: value and, for "fail", _file."""
    parsed = rows.withColumn("_j", F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    wrong = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull() | ~F.trim("value").startswith("{")
    names = [f.name for f in parsed.schema["_j"].dataType.fields if f.name != "_corrupt"]
    if bad == "skip":
        return parsed.where(~wrong).select(*[f"_j.{n}" for n in names])
    if bad == "keep":
        return parsed.select(*[F.when(~wrong, F.col(f"_j.{n}")).alias(n) for n in names], wrong.alias("_bad"))
    stop = F.raise_error(F.concat(F.lit("malformed line in "), F.coalesce("_file", F.lit("?")), F.lit(": "), F.substring("value", 1, 80)))
    return parsed.select(*[F.when(wrong, stop).otherwise(F.col(f"_j.{n}")).alias(n) for n in names])


def string_or_array(column: str) -> F.Column:
    """A JSON array in a string, or a plain string, as an array of strings; null as none."""
    c = F.col(column)
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.when(c.isNotNull() & (F.trim(c) != ""), F.array(c)), F.array().cast("array<string>"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: new values, but an old value is kept where the new one is null; columns
    in `first` keep the least, those in `last` the greatest."""
    both = old.alias("o").join(new.alias("n"), keys, "full")
    pick = lambda c: F.least(f"o.{c}", f"n.{c}") if c in first else F.greatest(f"o.{c}", f"n.{c}") if c in last else F.coalesce(f"n.{c}", f"o.{c}")
    return both.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def null_bad_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as null, so that JSON sinks hold numbers only."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in num})


def write_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Refuses to overwrite."""
    w = df.write.mode("errorifexists").format(fmt)
    (w.partitionBy(partition_by) if partition_by else w).save(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free content sum, for manifests."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without an ok entry in the log."""
    return work.join(done.where("status = 'ok'").select(*keys).distinct(), keys, "left_anti")
