"""Runs that are stopped and go on, shards and files that are tampered with."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import manifests, shards


@pytest.fixture
def landed(spark, tmp_path):
    """Six folders of files; one has no purchase."""
    rows = spark.range(120).select((F.col("id") % 6).alias("part"), "id", F.when((F.col("id") % 3 == 0) & (F.col("id") % 6 != 3), "purchase").otherwise("view").alias("kind"), (F.col("id") * 7).alias("cents"))
    folders = [f"{tmp_path}/in/part={i}" for i in range(6)]
    for i, f in enumerate(folders):
        rows.withColumn("kind", F.when(F.lit(i in (1, 2, 4, 5)) & (F.col("id") < 30), "purchase").otherwise(F.col("kind"))).where(f"part = {i}").drop("part").coalesce(1).write.parquet(f)
    return folders


def _audit(df):
    return sorted((r["part"], r["n"], r["status"], r["reason"]) for r in df.collect())


WANT = [(str(i), 20, "error" if i == 3 else "ok", "no_purchase" if i == 3 else "new") for i in range(6)]


def _stopped(spark, landed, out, monkeypatch, after):
    """A run that dies when it is about to enter a wave."""
    real, calls = shards.commit, []

    def failing(entries, log):
        calls.append(1)
        if len(calls) > after:
            raise RuntimeError("killed")
        real(entries, log)

    with monkeypatch.context() as m:
        m.setattr(shards, "commit", failing)
        with pytest.raises(RuntimeError, match="killed"):
            shards.run_shards(spark, landed, out, None, wave=1)


def test_a_stopped_run_goes_on_where_it_stopped(spark, landed, tmp_path, monkeypatch):
    out = str(tmp_path / "run")
    _stopped(spark, landed, out, monkeypatch, 3)
    assert not shards.exists(spark, f"{out}/audit")
    # The fourth shard had no entry: what it left is replaced, even if it is not whole.
    left = spark.read.parquet(f"{out}/rows")
    assert {r["part"] for r in left.select("part").distinct().collect()} >= {0, 1, 2}
    worked, real = [], shards.work_wave

    def noted(rows, todo, *more):
        worked.extend(r["part"] for r in todo.select("part").collect())
        real(rows, todo, *more)

    monkeypatch.setattr(shards, "work_wave", noted)
    assert _audit(shards.run_shards(spark, landed, out, None, wave=1)) == WANT
    assert worked == ["3", "4", "5"]
    assert spark.read.parquet(f"{out}/rows").count() == 100 and spark.read.parquet(f"{out}/refused").count() == 20
    with pytest.raises(FileExistsError, match="finished"):
        shards.run_shards(spark, landed, out, None)
    assert _audit(shards.run_shards(spark, landed, str(tmp_path / "next"), spark.read.parquet(f"{out}/audit"))) == [(p, n, "skipped", "verified") if s == "ok" else (p, n, s, r) for p, n, s, r in WANT]


def test_a_shard_tampered_with_is_refused(spark, landed, tmp_path, monkeypatch):
    """Its number of rows is as it was."""
    out = str(tmp_path / "run")
    _stopped(spark, landed, out, monkeypatch, 3)
    path = f"{out}/rows/part=1"
    spark.read.parquet(path).withColumn("cents", F.when(F.col("id") == 7, F.lit(0)).otherwise(F.col("cents"))).write.parquet(f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="have changed: 1$"):
        shards.run_shards(spark, landed, out, None, wave=1)
    assert not shards.exists(spark, f"{out}/audit")


def test_a_run_goes_on_with_its_own_files_only(spark, landed, tmp_path, monkeypatch):
    out = str(tmp_path / "run")
    _stopped(spark, landed, out, monkeypatch, 1)
    with pytest.raises(ValueError, match="not those"):
        shards.run_shards(spark, landed[:5], out, None)
    spark.read.parquet(landed[5]).withColumn("cents", F.col("cents") + 1).coalesce(1).write.parquet(f"{tmp_path}/changed")
    spark.read.parquet(f"{tmp_path}/changed").coalesce(1).write.mode("overwrite").parquet(landed[5])
    with pytest.raises(ValueError, match="not those"):
        shards.run_shards(spark, landed, out, None)


def test_changed_values_are_done_anew_by_a_later_run(spark, landed, tmp_path):
    first = shards.run_shards(spark, landed, f"{tmp_path}/1", None)
    path = f"{tmp_path}/1/rows/part=2"
    spark.read.parquet(path).withColumn("cents", -F.col("cents")).write.parquet(f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other").write.mode("overwrite").parquet(path)
    second = dict((r["part"], r["reason"]) for r in shards.run_shards(spark, landed, f"{tmp_path}/2", first).collect())
    assert second == {"0": "verified", "1": "verified", "2": "changed", "3": "no_purchase", "4": "verified", "5": "verified"}


def test_manifests_name_file_and_chunk(spark, tmp_path):
    def land(name, change):
        df = spark.range(95).select("id", (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.lit("t")).alias("t"))
        for i in range(3):
            change(df.withColumn("x", F.col("x") + i), i).coalesce(1).write.parquet(f"{tmp_path}/{name}/f={i}")
        c = manifests.chunk_digests(spark, [f"{tmp_path}/{name}"], 10)
        return c.withColumn("file", F.regexp_extract("file", "f=([0-9])", 1))

    a, again = land("a", lambda df, i: df), land("again", lambda df, i: df)
    status = lambda x, y, keys: {tuple(r[k] for k in keys): r["status"] for r in manifests.compare(x, y, keys).collect()}
    assert set(status(a, again, ["file", "chunk"]).values()) == {"same"}
    b = land("b", lambda df, i: df.withColumn("t", F.when((F.col("id") == 33) & F.lit(i == 1), "T").otherwise(F.col("t"))) if i < 2 else df.where("id < 50"))
    got = status(a, b, ["file", "chunk"])
    assert {k for k, s in got.items() if s == "changed"} == {("1", 3)} and {k for k, s in got.items() if s == "missing"} == {("2", c) for c in range(5, 10)}
    assert status(manifests.file_digests(a), manifests.file_digests(b), ["file"]) == {("0",): "same", ("1",): "changed", ("2",): "changed"}
    # Two rows that change places are another content; the same rows over more tasks are not.
    swapped = land("c", lambda df, i: df.orderBy(F.when(F.col("id") == 3, 4.5).otherwise(F.col("id"))))
    assert {k for k, s in status(a, swapped, ["file", "chunk"]).items() if s == "changed"} == {(str(i), 0) for i in range(3)}
