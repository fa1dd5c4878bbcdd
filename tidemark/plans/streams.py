"""Queries T01 to T15: streams over the tape's files and their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pairing as P
from ..operators.asof import asof
from ..sources.tables import tape
from ..streaming import keyed as K
from ..streaming import runs as R
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _key():
    return Window.partitionBy("key").orderBy("us", "seq")


def _stream(spark, d, **more):
    return R.tape_stream(spark, f"{d}/events.parquet", **more)


#: Silence after which a key's state goes; longer than any within the tape.
IDLE = 40 * DAY


def _kept(rows, name, columns, kept, out, step, processor=K.InOrder):
    """A keyed processor over rows (key, us, seq, columns): they may come an hour late, and wait for that."""
    spark, marks = rows.sparkSession, R.scratch(rows.sparkSession, f"{name}-marks")
    rows = rows.select("key", F.timestamp_micros("us").alias("ts"), "us", "seq", *columns)
    with K.state_store(spark):
        return R.drain(K.in_order(K.with_marks(rows, marks, "1 hour"), "key", columns, kept, out, step, IDLE, processor), name, marks=marks)


@query("T01_receipt_ingest", "SELECT seq, us, us + CAST(k AS BIGINT) * 1000000 AS received, CASE WHEN kind = 'signup' THEN 'session_start' ELSE 'row' END AS record FROM tape")
def t01(spark, d):
    s = _stream(spark, d).select("seq", "us", (F.col("us") + F.col("k").cast("bigint") * 1_000_000).alias("received"), F.when(F.col("kind") == "signup", "session_start").otherwise("row").alias("record"))
    return R.drain(s, "ingest")


@query("T02_dedup", "SELECT DISTINCT key, kind, k FROM tape")
def t02(spark, d):
    """Duplicates by content are dropped; their keys stay in state for the watermark's time
    (a month here, longer than the tape)."""
    s = _stream(spark, d).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["key", "kind", "k"]).select("key", "kind", "k")
    return R.drain(s, "dedup")


@query("T02_change_only", "SELECT seq FROM (SELECT seq, kind, lag(kind) OVER (PARTITION BY key ORDER BY us, seq) AS p FROM tape) WHERE p IS DISTINCT FROM kind")
def t02_change(spark, d):
    return _kept(_stream(spark, d), "changes", ["kind"], "kind string", "seq long", K.changes("kind"))


@query("T03_eligibility", "WITH g AS (SELECT *, us - lag(us) OVER (PARTITION BY key ORDER BY us, seq) AS gap FROM tape), s AS (SELECT *, max(CASE WHEN gap IS NULL OR gap > 43200000000 THEN us END) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS start_us FROM g) SELECT seq, us - start_us > 3600000000 AS eligible FROM s")
def t03(spark, d):
    """Rows of the first hour after a start or a gap of 12 hours are a snapshot, not news."""
    return _kept(_stream(spark, d), "eligible", [], "start long, last long", "seq long, eligible boolean", K.eligible(12 * HOUR, HOUR))


@query("T04_late_rows", "SELECT CASE WHEN k IS NULL THEN 'missing' WHEN k - 20 < -2 THEN 'early' WHEN k - 20 > 50 THEN 'late' ELSE 'kept' END AS outcome, count(*) AS n FROM tape GROUP BY 1")
def t04(spark, d):
    lag = F.col("k") - 20
    outcome = F.when(F.col("k").isNull(), "missing").when(lag < -2, "early").when(lag > 50, "late").otherwise("kept")
    s = _stream(spark, d).withWatermark("ts", "5 seconds").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return R.drain(s, "late", "complete")


BOOK = """
WITH m AS (SELECT key, seq, kind, cents // 100 AS price, k, row_number() OVER w AS n, count(*) FILTER (WHERE kind = 'signup') OVER w AS epoch FROM tape WHERE cents IS NOT NULL AND k IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY us, seq)),
l AS (SELECT a.key, a.seq, b.price, arg_max(b.k, b.n) AS size, arg_max(b.kind = 'signup', b.n) AS fresh FROM m a JOIN m b ON a.key = b.key AND a.epoch = b.epoch AND b.n <= a.n GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY price DESC) AS r FROM l WHERE fresh OR size >= 10)
SELECT m.key, m.seq, max(s.price) AS best, CAST(coalesce(sum(s.size) FILTER (WHERE r <= 5), 0) AS BIGINT) AS depth5, count(s.price) AS levels FROM m LEFT JOIN s ON m.key = s.key AND m.seq = s.seq GROUP BY m.key, m.seq"""


@query("T05_book_stream", BOOK)
def t05(spark, d):
    """The stateful book over the stream; tests hold it against T05_book_batch."""
    rows = _stream(spark, d).select("key", "us", "seq", "kind", "cents", "k").dropna()
    return _kept(rows, "book", ["kind", "cents", "k"], "", R.BOOK, R.book_step, K.Book)


@query("T05_book_batch", BOOK)
def t05_batch(spark, d):
    return R.book_batch(tape(spark, d))


@query("T06_rolling_features", "SELECT a.seq, CAST((SELECT count(*) FROM tape b WHERE b.key = a.key AND b.us > a.us - 43200000000 AND (b.us, b.seq) <= (a.us, a.seq)) AS BIGINT) AS n12, CAST((SELECT coalesce(sum(CASE b.kind WHEN 'purchase' THEN b.cents WHEN 'error' THEN -b.cents ELSE 0 END), 0) FROM tape b WHERE b.key = a.key AND b.us > a.us - 43200000000 AND (b.us, b.seq) <= (a.us, a.seq)) AS BIGINT) AS flow12 FROM tape a")
def t06(spark, d):
    """Trailing counts and flows from state; a key silent for the window's length loses it."""
    flow = F.when(F.col("kind") == "purchase", F.col("cents")).when(F.col("kind") == "error", -F.col("cents")).otherwise(0)
    s = _stream(spark, d).withWatermark("ts", "1 hour").select("key", "ts", F.unix_millis("ts").alias("ms"), "us", "seq", F.coalesce(flow, F.lit(0)).alias("flow"))
    return R.drain(R.per_key(s, "key", "seq long, n12 long, flow12 long", "times array<long>, flows array<long>", R.trailing_step(12 * HOUR), idle=12 * HOUR // 1000), "rolling")


@query("T07_cooldown_stream", "WITH RECURSIVE c AS (SELECT key, us, seq FROM tape WHERE cents >= 10000), r AS (SELECT key, min(us) AS us FROM c GROUP BY key UNION ALL SELECT r.key, (SELECT min(c.us) FROM c WHERE c.key = r.key AND c.us >= r.us + 172800000000) FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.key = r.key AND c.us >= r.us + 172800000000)) SELECT c.key, c.us, c.seq FROM c JOIN r ON c.key = r.key AND c.us = r.us")
def t07(spark, d):
    return _kept(_stream(spark, d).where("cents >= 10000"), "cooldown", [], "last long", "key long, us long, seq long", K.cooldown(2 * DAY))


@query("T08_triggers", "SELECT seq, CASE WHEN kind = 'signup' THEN 'start' WHEN kind = 'purchase' AND cents > 10000 THEN 'big_trade' WHEN kind = 'error' AND k > 90 THEN 'alarm' END AS trig FROM tape WHERE kind = 'signup' OR (kind = 'purchase' AND cents > 10000) OR (kind = 'error' AND k > 90)")
def t08(spark, d):
    trigger = F.when(F.col("kind") == "signup", "start").when((F.col("kind") == "purchase") & (F.col("cents") > 10000), "big_trade").when((F.col("kind") == "error") & (F.col("k") > 90), "alarm")
    return R.drain(_stream(spark, d).select("seq", trigger.alias("trig")).where("trig IS NOT NULL"), "triggers")


@query("T09_pairing", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase'), q AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view'), a AS (SELECT p.*, CASE WHEN p.us - q.us <= 21600000000 THEN q.seq END AS before_seq FROM p ASOF LEFT JOIN q ON p.key = q.key AND p.us >= q.us),
b AS (SELECT a.*, CASE WHEN q.us - a.us <= 21600000000 THEN q.seq END AS after_seq FROM a ASOF LEFT JOIN q ON a.key = q.key AND a.us <= q.us) SELECT seq, before_seq, after_seq FROM b WHERE before_seq IS NOT NULL OR after_seq IS NOT NULL""")
def t09(spark, d):
    """State rows with the quote before them (at most 6 h old) and after (at most 6 h late)."""
    t = tape(spark, d)
    q = t.where("kind = 'view'").select("key", "us", "seq", "cents")
    a = asof(t.where("kind = 'purchase'").select("key", "us", "seq"), q, ["key"], "us", ["cents"], tolerance=6 * HOUR, prefix="b_")
    b = asof(a, q, ["key"], "us", ["cents"], direction="forward", tolerance=6 * HOUR, prefix="a_")
    return b.select("seq", F.col("b_seq").alias("before_seq"), F.col("a_seq").alias("after_seq")).where("before_seq IS NOT NULL OR after_seq IS NOT NULL")


@query("T09_pairing_stream", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase'), q AS (SELECT key, us, seq FROM tape WHERE kind = 'view'),
a AS (SELECT p.*, CASE WHEN p.us - q.us <= 21600000000 THEN q.seq END AS before_seq FROM p ASOF LEFT JOIN q ON p.key = q.key AND p.us >= q.us),
b AS (SELECT a.*, CASE WHEN q.us - a.us <= 21600000000 THEN q.seq END AS after_seq, CASE WHEN q.us - a.us <= 21600000000 THEN q.us ELSE a.us + 21600000000 END AS final FROM a ASOF LEFT JOIN q ON a.key = q.key AND a.us <= q.us),
mark AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS closed FROM tape WHERE kind IN ('purchase', 'view'))
SELECT seq, before_seq, after_seq FROM b, mark WHERE coalesce(final, us + 21600000000) <= closed AND (before_seq IS NOT NULL OR after_seq IS NOT NULL)""")
def t09_stream(spark, d):
    """As T09_pairing, on the stream: pairs that the watermark has made final."""
    s = _stream(spark, d).where("kind IN ('purchase', 'view')").withWatermark("ts", "1 hour")
    return R.drain(R.paired(s, "key", F.col("kind") == "purchase", 6 * HOUR), "paired")


@query("T10_monotone_stream", """
WITH RECURSIVE o AS (SELECT key, seq, k, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS n FROM tape WHERE k IS NOT NULL),
r AS (SELECT key, seq, n, k AS bar, true AS accepted FROM o WHERE n = 1 UNION ALL SELECT o.key, o.seq, o.n, greatest(r.bar, o.k), o.k >= r.bar FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
SELECT key, seq, accepted FROM r""")
def t10(spark, d):
    rows = _stream(spark, d).select("key", "us", "seq", F.col("k").cast("long").alias("k")).dropna()
    return _kept(rows, "monotone", ["k"], "bar long", "key long, seq long, accepted boolean", K.monotone("k"))


@query("T11_session_windows", "WITH b AS (SELECT *, CASE WHEN us - lag(us) OVER w < 18000000000 THEN 0 ELSE 1 END AS brk FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq)), s AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT key, count(*) AS n, sum(cents) AS cents, min(us) AS first_us FROM s GROUP BY key, s")
def t11(spark, d):
    t = tape(spark, d)
    return t.groupBy("key", F.session_window("ts", "5 hours")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.min("us").alias("first_us")).drop("session_window")


@query("T11_session_stream", """
WITH b AS (SELECT *, CASE WHEN us - lag(us) OVER w < 18000000000 THEN 0 ELSE 1 END AS brk FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq)), s AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS s FROM b),
g AS (SELECT key, count(*) AS n, sum(cents) AS cents, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY key, s), mark AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS closed FROM tape)
SELECT key, n, cents, first_us FROM g, mark WHERE last_us + 18000000000 <= closed""")
def t11_stream(spark, d):
    """Sessions that the watermark has closed, while the stream goes on."""
    s = _stream(spark, d).withWatermark("ts", "1 hour").groupBy("key", F.session_window("ts", "5 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.min("us").alias("first_us")).drop("w")
    return R.drain(s, "sessions")


@query("T12_tumbling_metrics", "SELECT us // 86400000000 AS day, kind, count(*) AS n, min(cents) AS low, max(cents) AS high, sum(cents) AS cents FROM tape GROUP BY ALL")
def t12(spark, d):
    """Windows are days since 1970 of the instant itself, so the session's time zone plays no part.  A
    day's state goes when the watermark has passed its end."""
    rows = _stream(spark, d).withColumn("at", F.timestamp_micros("us")).withWatermark("at", "10 minutes")
    s = rows.groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.sum("cents").alias("cents"))
    s = s.select(F.floor(F.unix_micros("w.start") / DAY).alias("day"), "kind", "n", "low", "high", "cents")
    return R.drain(s, "tumbling", "update", ["day", "kind"])


@query("T13_budgeted_stream", "SELECT key % 4 AS file, count(*) AS n, sum(cents) AS cents FROM tape GROUP BY 1")
def t13(spark, d):
    """Four files, one a trigger: a bounded batch however much has landed."""
    path = R.scratch(spark, "landed")
    e = spark.read.parquet(f"{d}/events.parquet")
    for i in range(4):
        e.where(f"user_id % 4 = {i}").coalesce(1).write.mode("append").parquet(path)
    s = R.tape_stream(spark, path, files_per_trigger=1).groupBy((F.col("key") % 4).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return R.drain(s, "budget", "complete")


@query("T14_continuous_scoring")
def t14(spark, d):
    """A frozen pipeline scores every batch of the stream; rows it can't score are counted out.
    A batch that runs twice replaces what it wrote."""
    from .models import fit_tick_model

    model, out = fit_tick_model(spark, d), R.scratch(spark, "scored")
    write = R.into_batches(out)

    def score(df, batch):
        from pyspark.ml.functions import vector_to_array

        rows = df.withColumns({"x1": F.col("cents") / 100, "x2": F.col("k").cast("double")}).where("x1 IS NOT NULL AND x2 IS NOT NULL")
        write(model.transform(rows).select("seq", F.round(vector_to_array("probability")[1], 6).alias("p")), batch)

    q = _stream(spark, d).writeStream.option("checkpointLocation", R.scratch(spark, "scored-state")).trigger(availableNow=True).foreachBatch(score).start()
    q.awaitTermination()
    return spark.read.schema("seq long, p double").option("recursiveFileLookup", "true").parquet(out)


@query("T15_median_bins", "SELECT key, us // 7200000000 AS bin, round(quantile_cont(cents, 0.5), 4) AS mid, count(*) AS n FROM tape WHERE kind IN ('view', 'click') GROUP BY ALL")
def t15(spark, d):
    """A bin's values are state until the watermark has passed its end; then its median is a row, once."""
    rows, marks = _stream(spark, d).where("kind IN ('view', 'click')"), R.scratch(spark, "medians-marks")
    rows = K.with_marks(rows.select("key", F.timestamp_micros("us").alias("ts"), "cents"), marks, "1 hour")
    s = rows.groupBy("key", F.window("ts", "2 hours").alias("w")).agg(F.round(F.percentile("cents", 0.5), 4).alias("mid"), F.count(F.lit(1)).alias("n"))
    return R.drain(s.select("key", F.floor(F.unix_micros("w.start") / (2 * HOUR)).alias("bin"), "mid", "n"), "medians", marks=marks)


@query("T15_mirrored_changes", """
WITH m AS (SELECT key, kind, us // 86400000000 AS bin, round(quantile_cont(cents, 0.5), 4) AS mid FROM tape WHERE kind IN ('view', 'click') GROUP BY ALL),
j AS (SELECT *, mid - lag(mid) OVER (PARTITION BY key, kind ORDER BY bin) AS d FROM m QUALIFY abs(d) >= 800),
c AS (SELECT *, count(*) FILTER (WHERE d > 0) OVER w = 1 AND count(*) FILTER (WHERE d < 0) OVER w = 1 AS twin FROM j WINDOW w AS (PARTITION BY key, bin))
SELECT key, bin, CASE WHEN twin THEN 2 ELSE 1 END::BIGINT AS outcomes, round(d, 4) AS delta, CASE WHEN d > 0 THEN kind END AS positive_outcome FROM c WHERE NOT twin OR d > 0""")
def t15_mirrored(spark, d):
    """Changes of daily medians of two outcomes (kinds) of a key; mirrored ones are one."""
    t = tape(spark, d).where("kind IN ('view', 'click')")
    mids = t.groupBy("key", "kind", F.floor(F.col("us") / DAY).alias("bin")).agg(F.round(F.percentile("cents", 0.5), 4).alias("mid"))
    return P.price_jumps(mids, ["key"], "kind", "bin", "mid", 800).withColumn("delta", F.round("delta", 4))


@query("T15_one_to_one")
def t15_pairs(spark, d):
    """Purchases and views of a key on the same side, at most 6 hours apart, each in one pair at most, the closest first."""
    t = tape(spark, d).withColumn("side", F.col("k") % 2).where("side IS NOT NULL")
    return P.pair_one_to_one(t.where("kind = 'purchase'"), t.where("kind = 'view'"), ["key", "side"], "us", "seq", 6 * HOUR).select("key", "side", F.col("left_n").alias("purchase"), F.col("right_n").alias("view"), (F.col("right_t") - F.col("left_t")).alias("lag"))


@query("U06_keyed_state", "SELECT seq, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS n, sum(cents) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS total FROM tape")
def u06(spark, d):
    """A caller's own state: number and total so far of each key, in order of time, across batches."""
    return _kept(_stream(spark, d), "state", ["cents"], "n long, total long", "seq long, n long, total long", K.totals("cents"))
