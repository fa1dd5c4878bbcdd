"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, discard, materialize, scratch_path, shared_dir, sized, written

__all__ = ["ASCII_SPACE", "Scratch", "discard", "held_out", "materialize", "read_table", "scratch_path", "shared_dir", "sized", "unused", "written"]

#: ASCII white space, the characters of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
