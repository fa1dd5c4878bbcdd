"""Gates fail closed."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import checks as K
from tidemark.sources import tapes as T


def test_duplicate_join_keys_stop_the_query(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="duplicate join key"):
        K.checked_join(left, right, ["k"]).collect()


def test_roles_must_cover_columns_once(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError, match="without a role"):
        K.with_roles(df, {"feature": ["a"]})
    with pytest.raises(ValueError, match="two roles"):
        K.with_roles(df, {"feature": ["a", "b"], "label": ["b"]})
    with pytest.raises(ValueError, match="not allowed"):
        K.with_roles(df, {"feature": ["a", "b"]}, forbidden=("b",))
    assert K.with_roles(df, {"feature": ["a"], "label": ["b"]}).schema["b"].metadata == {"role": "label"}


def test_bad_lines_are_skipped_counted_or_refused(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{bad",), ("[1]",), ("",)], "value string").withColumn("_file", F.lit("f"))
    assert [r["a"] for r in T.parse_lines(rows, "a INT").collect()] == [1]
    assert T.parse_lines(rows, "a INT", "keep").where("_bad").count() == 3
    with pytest.raises(Exception, match="malformed line in f"):
        T.parse_lines(rows, "a INT", "fail").collect()


def test_upsert_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k long, v string, seen long")
    new = spark.createDataFrame([(1, None, 9), (3, "z", 7)], "k long, v string, seen long")
    got = {r["k"]: (r["v"], r["seen"]) for r in T.upsert(old, new, ["k"], last=("seen",)).collect()}
    assert got == {1: ("x", 9), 2: ("y", 6), 3: ("z", 7)}


def test_set_key_and_walk_book(spark):
    df = spark.createDataFrame([("3, 1,2",), ("1,1,2",), ("1,2,x",), (None,)], "s string")
    assert [r[0] for r in df.select(S.set_key("s", 3)).collect()] == ["1,2,3", None, None, None]
    book = spark.createDataFrame([([(1.0, 10), (2.0, 10)],)], "levels array<struct<price: double, size: bigint>>")
    assert [r[0] for r in book.select(S.walk_book("levels", F.lit(15))).collect()] == [20.0]
    assert [r[0] for r in book.select(S.walk_book("levels", F.lit(21))).collect()] == [None]


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(1, c, float(c % 7 + i)) for c in range(40) for i in range(3)], "g long, c long, v double")
    a = A.cluster_bootstrap(df, ["g"], "c", "v", draws=100).collect()
    b = A.cluster_bootstrap(df.repartition(7), ["g"], "c", "v", draws=100).collect()
    assert a[0]["clusters"] == 40 and a[0]["low"] < a[0]["mean"] < a[0]["high"]
    assert abs(a[0]["low"] - b[0]["low"]) < 1e-9
    few = A.cluster_bootstrap(df.where("c < 3"), ["g"], "c", "v", draws=50).first()
    assert few["low"] is None
