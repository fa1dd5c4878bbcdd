"""Streams over several batches against their batch twins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.streaming import keyed as K
from tidemark.streaming import runs as R

HOUR = 3_600_000_000


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition has a state store of its own."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Ticks in five files, each later than the one before."""
    path = str(tmp_path_factory.mktemp("landed"))
    rows = [(i % 3, (1000 + i // 3) * HOUR + (i % 7) * 60_000_000 + (40 * HOUR if i > 70 else 0), i, i % 11 - 5) for i in range(120)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "key long, us long, seq long, flow long").withColumn("ts", F.timestamp_micros("us")).withColumn("ms", F.unix_millis("ts"))
    ordered = sorted(df.collect(), key=lambda r: (r["us"], r["seq"]))
    for i in range(5):
        spark.createDataFrame(ordered[i * 24 : i * 24 + 24], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_trailing_sums_over_batches_and_expiry(spark, landed):
    s = R.per_key(_stream(spark, landed).withWatermark("ts", "1 hour"), "key", "seq long, n12 long, flow12 long", "times array<long>, flows array<long>", R.trailing_step(12 * HOUR), idle=12 * 3_600_000)
    t = spark.read.parquet(landed).withColumn("one", F.lit(1))
    want = W.trailing_sum(W.trailing_sum(t, ["key"], "us", "seq", "one", 12 * HOUR, "n12"), ["key"], "us", "seq", "flow", 12 * HOUR, "flow12").select("seq", "n12", "flow12")
    got, want = _rows(R.drain(s, "trailing")), _rows(want)
    assert [(a, b) for a, b in zip(got, want) if a != b] == [] and len(got) == len(want)


def test_state_of_silent_keys_goes(spark, tmp_path):
    """A key's count starts anew after a silence in which the watermark has passed it."""

    def count(key, rows, state):
        n = state[0] if state else 0
        return rows[["seq"]].assign(n=range(n + 1, n + 1 + len(rows))), (n + len(rows),)

    path = str(tmp_path / "ticks")
    for i, (key, hour) in enumerate([(1, 0), (2, 30), (2, 60), (2, 90), (1, 91), (2, 92)]):
        row = spark.createDataFrame([(key, (1000 + hour) * HOUR, i)], "key long, us long, seq long").withColumn("ts", F.timestamp_micros("us")).withColumn("ms", F.unix_millis("ts"))
        row.coalesce(1).write.mode("append").parquet(path)
    s = _stream(spark, path).withWatermark("ts", "1 hour")
    assert _rows(R.drain(R.per_key(s, "key", "seq long, n long", "n long", count), "kept")) == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 2), (5, 4)]
    assert _rows(R.drain(R.per_key(s, "key", "seq long, n long", "n long", count, idle=40 * 3_600_000), "short")) == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 1), (5, 4)]


def _keyed(spark, path, columns, kept, out, step, idle, name, delay="1 hour", processor=K.InOrder):
    marks = R.scratch(spark, "marks")
    with K.state_store(spark):
        return R.drain(K.in_order(K.with_marks(_stream(spark, path), marks, delay), "key", columns, kept, out, step, idle, processor), name, marks=marks)


def test_eligibility_over_batches(spark, landed):
    got = _keyed(spark, landed, [], "start long, last long", "seq long, eligible boolean", K.eligible(12 * HOUR, HOUR), 1000 * HOUR, "eligible")
    want, start, last = [], {}, {}
    for r in sorted(spark.read.parquet(landed).collect(), key=lambda r: (r["us"], r["seq"])):
        k, t = r["key"], r["us"]
        if k not in last or t - last[k] > 12 * HOUR:
            start[k] = t
        last[k] = t
        want.append((r["seq"], t - start[k] > HOUR))
    assert _rows(got) == sorted(want) and {e for _, e in want} == {True, False}


def _land(spark, path, files):
    for some in files:
        spark.createDataFrame(some, "key long, us long, seq long, kind string, cents long, k long").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Messages in files whose neighbours by time have changed places, within a delay of three hours, with a
    silence of 60 hours of one key."""
    path = str(tmp_path_factory.mktemp("late") / "ticks")
    kinds = ["view", "signup", "purchase", "error", "view", "view", "click"]
    rows = [(i % 3, (1000 + i // 2) * HOUR + i % 5 * 700_000_000 + (60 * HOUR if i >= 40 and i % 3 == 1 else 0), i, kinds[i % 7], 100 * (i * 37 % 19) + i % 3, i * 29 % 40) for i in range(70)]
    rows.sort(key=lambda r: (r[1], r[2]))
    files = [rows[i : i + 18] for i in range(0, len(rows), 18)]
    for a, b in zip(files, files[1:]):
        if b[0][1] - a[-1][1] < 2 * HOUR:
            a[-1], b[0] = b[0], a[-1]
    assert any(a[-1][1] > b[0][1] for a, b in zip(files, files[1:]))
    _land(spark, path, files)
    return path


STEPS = {
    "changes": (["kind"], "kind string", "seq long", K.changes("kind")),
    "eligible": ([], "start long, last long", "seq long, eligible boolean", K.eligible(12 * HOUR, HOUR)),
    "cooldown": ([], "last long", "key long, us long, seq long", K.cooldown(5 * HOUR)),
    "monotone": (["k"], "bar long", "key long, seq long, accepted boolean", K.monotone("k")),
    "totals": (["cents"], "n long, total long", "seq long, n long, total long", K.totals("cents")),
    "book": (["kind", "cents", "k"], "", R.BOOK, R.book_step),
}


@pytest.mark.parametrize(("name", "idle"), [*((n, 40 * HOUR) for n in STEPS), ("totals", 1000 * HOUR), ("book", 1000 * HOUR)])
def test_keyed_processors_over_batches_equal_their_batch_twin(spark, late, name, idle):
    """Late rows wait for their place; a key that was silent begins anew, however rows fall into batches."""
    columns, kept, out, step = STEPS[name]
    got = _keyed(spark, late, columns, kept, out, step, idle, name, "3 hours", K.Book if name == "book" else K.InOrder)
    rows = spark.read.parquet(late)
    want = K.in_order_batch(rows, "key", columns, out, step, idle)
    assert _rows(got) == _rows(want) and len(_rows(want)) > 5
    if name == "totals":  # by hand
        silent = [r for r in sorted(rows.collect(), key=lambda r: (r["us"], r["seq"])) if r["key"] == 1]
        new = next(i for i in range(1, len(silent)) if silent[i]["us"] - silent[i - 1]["us"] > 40 * HOUR)
        assert dict((r["seq"], r["n"]) for r in got.collect())[silent[new]["seq"]] == (1 if idle == 40 * HOUR else new + 1)
    if name == "book" and idle > 40 * HOUR:
        assert _rows(got) == _rows(R.book_batch(rows))


@pytest.mark.parametrize("name", STEPS)
def test_keys_that_share_a_group_equal_their_batch_twin(spark, tmp_path, monkeypatch, name):
    """Many keys in three groups, one key null, null values and longs beyond 2^53, a silence, frames smaller than a group's
    rows: what a group keeps is a few elements of state, however many keys it has."""
    monkeypatch.setattr(K, "GROUPS", 3)
    monkeypatch.setattr(K, "CHUNK", 7)
    path, (columns, kept, out, step) = str(tmp_path / "ticks"), STEPS[name]
    whole = name in ("monotone", "book")
    rows = [((i % 40) or None, (1000 + i // 40) * HOUR + i * 1_000_003 % 999_983 + (60 * HOUR if i >= 120 and i % 7 == 3 else 0), 2**60 + i, None if i % 13 == 4 and not whole else ["view", "signup", "click"][i * i % 3], None if i % 5 == 2 and not whole else 2**55 + 37 * i % 19, i * 29 % 40) for i in range(240)]
    rows.sort(key=lambda r: r[1])
    _land(spark, path, [rows[:120], rows[120:]])
    marks = R.scratch(spark, "marks")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        with K.state_store(spark):
            s = K.in_order(K.with_marks(_stream(spark, path), marks, "1 hour"), "key", columns, kept, out, step, 40 * HOUR, K.Book if name == "book" else K.InOrder)
            got, state, held = str(tmp_path / "out"), str(tmp_path / "state"), []
            for ending in (False, True):
                if ending:
                    K.close(spark, spark.read.parquet(marks).schema, marks)
                q = s.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(got)
                q.awaitTermination()
                held.append([sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = K.in_order_batch(spark.read.parquet(path), "key", columns, out, step, 40 * HOUR)
    order = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert order(spark.read.schema(s.schema).parquet(got)) == order(want) and want.count() >= 40
    assert 0 < max(held[0]) <= 3 * 3 and held[1][-1] == 0


def _values(message) -> int:
    return sum(map(_values, message)) if isinstance(message, (list, tuple)) else 1


class _Held:
    """A state variable in memory that counts the values it is given."""

    def __init__(self):
        self.held, self.given = [], 0

    def appendValue(self, value):
        self.held, self.given = [*self.held, value], self.given + _values(value)

    def put(self, values):
        self.held, self.given = list(values), self.given + _values(values)

    def update(self, value):
        self.put([value])

    def get(self):
        return list(self.held) if self.name == "waiting" else self.held[0] if self.held else None

    def clear(self):
        self.held = []


@pytest.mark.parametrize("name", STEPS)
def test_values_sent_to_the_store_do_not_grow_with_rows(spark, tmp_path, monkeypatch, name):
    """Each value of a message is made an object on both sides: waiting rows are one, however many they are, also those put back."""
    monkeypatch.setattr(K, "CHUNK", 1000)
    columns, kept, out, step = STEPS[name]
    path, made = str(tmp_path / "ticks"), []
    _land(spark, path, [[(1, 1000 * HOUR, 0, "view", 1, 20)]])

    class Seen(K.Book if name == "book" else K.InOrder):
        def __init__(self, *given):
            super().__init__(*given)
            made.append(self)

    class Handle:
        def __init__(self):
            self.of = {}

        def getListState(self, name, schema):
            self.of[name] = _Held()
            self.of[name].name = name
            return self.of[name]

        getValueState = getListState
        registerTimer = deleteTimer = lambda self, at: None

    class At:
        def __init__(self, hour):
            self.hour = hour

        def getCurrentWatermarkInMs(self):
            return self.hour * 3_600_000

    K.in_order(_stream(spark, path).withWatermark("ts", "1 hour"), "key", columns, kept, out, step, 10_000 * HOUR, Seen)
    given, kinds, first = [], ["view", "signup", "click"], ["key", "us", "seq"]
    for n in (20, 200):
        handle, rows = Handle(), [(i % 4, (1000 + i // 10) * HOUR + i, 2**60 + i, kinds[i * i % 3], 2**55 + 37 * i % 19, i * 29 % 40) for i in range(n)]
        named = [dict(zip(["key", "us", "seq", "kind", "cents", "k"], r)) for r in rows]
        order = first + [c for c in columns if c not in first]
        frame = pd.DataFrame({f"c{i}": [r[c] if c == "kind" else str(r[c]) for r in named] for i, c in enumerate(order)})
        made[0].init(handle)
        list(made[0].handleInputRows((5,), iter([frame[: n // 2], frame[n // 2 :]]), At(0)))
        got = [f for hour in (1000 + n // 20, 9000) for f in made[0].handleExpiredTimer((5,), At(hour), None)]
        want = K.in_order_batch(spark.createDataFrame(rows, "key long, us long, seq long, kind string, cents long, k long"), "key", columns, out, step, 10_000 * HOUR)
        assert sorted(map(repr, (t for f in got for t in f.itertuples(index=False, name=None)))) == sorted(map(repr, map(tuple, want.collect())))
        given.append(handle.of["waiting"].given)
    assert given[0] == given[1]


def test_rows_beyond_the_watermark_are_dropped_and_open_rows_wait(spark, tmp_path):
    """What the watermark has not passed stays in state; what comes later than its delay is no row any more."""
    path = str(tmp_path / "ticks")
    _land(spark, path, [[(1, 1000 * HOUR, 0, "a", 1, 1)], [(1, 1010 * HOUR, 1, "a", 1, 1)], [(1, 1020 * HOUR, 2, "a", 1, 1)], [(1, 1001 * HOUR, 3, "a", 1, 1), (1, 1019 * HOUR + 1, 4, "a", 1, 1)]])
    with K.state_store(spark):
        s = K.in_order(_stream(spark, path).withWatermark("ts", "1 hour"), "key", ["cents"], "n long, total long", "seq long, n long, total long", K.totals("cents"), 1000 * HOUR)
        assert _rows(R.drain(s, "open")) == [(0, 1, 1), (1, 2, 2)]
    got = _keyed(spark, path, ["cents"], "n long, total long", "seq long, n long, total long", K.totals("cents"), 1000 * HOUR, "closed")
    assert _rows(got) == [(0, 1, 1), (1, 2, 2), (2, 4, 4), (4, 3, 3)]


def test_state_of_keys_goes_with_the_stream(spark, tmp_path):
    """When the closing mark has passed every key's idle time, the store holds nothing."""
    path = str(tmp_path / "ticks")
    _land(spark, path, [[(k, (1000 + i) * HOUR, 10 * i + k, "view", 100 * i, 20) for k in range(3)] for i in range(3)])
    marks = R.scratch(spark, "marks")
    with K.state_store(spark):
        s = K.in_order(K.with_marks(_stream(spark, path), marks, "1 hour"), "key", ["kind", "cents", "k"], "", R.BOOK, R.book_step, 40 * HOUR, K.Book)
        seen = []
        for ending in (False, True):
            if ending:
                K.close(spark, spark.read.parquet(marks).schema, marks)
            q = s.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: df.count()).start()
            q.awaitTermination()
            seen.append(sum(o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"]))
    assert seen[0] > 0 and seen[1] == 0


def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path):
    write, df = R.into_batches(str(tmp_path)), spark.range(5)
    write(df, 0)
    write(df, 1)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path)).count() == 10


def test_update_mode_gives_each_key_its_last_row(spark, landed):
    s = _stream(spark, landed).withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("flow")).select(F.unix_micros("w.start").alias("start"), "n", "flow")
    want = spark.read.parquet(landed).groupBy((F.floor(F.col("us") / (6 * HOUR)) * 6 * HOUR).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("flow"))
    assert _rows(R.drain(s, "windows", "update", ["start"])) == _rows(want)


@pytest.mark.parametrize("late", [False, True])
def test_pairing_over_batches_equals_brute_force(spark, tmp_path, late):
    """Quotes that come late, within the watermark's delay, and probes that wait for batches."""
    path, width = str(tmp_path / "ticks"), 6 * HOUR
    rows = [(i % 2, (1000 + i) * HOUR + i % 5 * 600_000_000, i, i % 3 == 0) for i in range(60) if i % 17 not in (3, 4, 5, 6, 7, 8, 9)] + [(0, 1200 * HOUR, 100, False)]
    files = [rows[i : i + 7] for i in range(0, len(rows), 7)]
    if late:  # neighbours by time land in each other's files
        for a, b in zip(files, files[1:]):
            a[-1], b[0] = b[0], a[-1]
    for some in files:
        spark.createDataFrame(some, "key long, us long, seq long, probe boolean").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)
    got = _rows(R.drain(R.paired(_stream(spark, path).withWatermark("ts", "5 hours"), "key", F.col("probe"), width), "pairs"))
    want = []
    for key, us, seq, probe in rows:
        quotes = [(u, s) for k, u, s, p in rows if k == key and not p]
        before = max([(u, s) for u, s in quotes if 0 <= us - u <= width], default=(None, None))
        after = min([(u, s) for u, s in quotes if 0 <= u - us <= width], default=(None, None))
        if probe and (before[1] is not None or after[1] is not None):
            want.append((seq, before[1], after[1]))
    assert got == sorted(want) and any(None in w for w in want) and not all(None in w for w in want)
