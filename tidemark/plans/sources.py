"""Queries S01 to S19: scans, parsing, sinks and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import scratch_path as _scratch
from ..sources import manifests as MF
from ..sources import shards as SH
from ..sources import tapes as T
from ..sources.tables import facts, steps, table, tape
from .registry import query


def _lines(spark, d):
    """The tape as JSON lines, every seventh broken, every eleventh not an object."""
    t = tape(spark, d).select("seq", "key", "kind", "cents", "k")
    line = F.to_json(F.struct("seq", "key", "kind", "cents", F.when(F.col("k") % 2 == 0, F.col("k")).alias("k")))
    return t.select(F.when(F.col("seq") % 7 == 0, F.concat(F.lit("{broken "), "seq")).when(F.col("seq") % 11 == 0, F.concat(F.lit("["), "seq", F.lit("]"))).otherwise(line).alias("value"))


LINE = "seq BIGINT, key BIGINT, kind STRING, cents BIGINT, k INT"


@query("S01_json_tape", "WITH m AS (SELECT key, min(k) AS mk FROM tape GROUP BY key) SELECT t.seq, t.cents, coalesce(CASE WHEN t.k % 2 = 0 THEN t.k END, m.mk) AS k FROM tape t LEFT JOIN m ON t.key = m.key WHERE t.seq % 7 <> 0 AND t.seq % 11 <> 0")
def s01(spark, d):
    path = _scratch(spark, "lines")
    _lines(spark, d).write.text(path)
    meta = tape(spark, d).groupBy("key").agg(F.min("k").alias("mk"))
    return T.json_lines(spark, path, LINE).join(meta, "key", "left").select("seq", "cents", F.coalesce("k", "mk").alias("k"))


@query("S02_strict_json")
def s02(spark, d):
    """Strict reading: good lines pass; one bad line would stop the query with file and text."""
    path = _scratch(spark, "strict")
    _lines(spark, d).where("value LIKE '{\"seq%'").write.text(path)
    return T.json_lines(spark, path, LINE, "fail").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("S03_counting_json", "SELECT count(*) AS n, count(*) FILTER (WHERE seq % 7 = 0 OR seq % 11 = 0) AS malformed FROM tape")
def s03(spark, d):
    return T.parse_lines(_lines(spark, d), LINE, "keep").agg(F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("malformed"))


@query("S04_column_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def s04(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_quantity")


@query("S05_multi_file", "SELECT CAST(fact % 3 AS BIGINT) AS session, count(*) AS n, count(CASE WHEN fact % 3 = 1 THEN class END) AS classes FROM facts GROUP BY 1")
def s05(spark, d):
    """Sessions in files of their own, one with a column the others lack."""
    path, f = _scratch(spark, "sessions"), facts(spark, d)
    for s in range(3):
        part = f.where(f"fact % 3 = {s}").select("fact", *(["class"] if s == 1 else []))
        part.withColumn("session", F.lit(s).cast("bigint")).write.parquet(f"{path}/s{s}")
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/s{s}" for s in range(3)]).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count("class").alias("classes"))


@query("S06_csv_settle", "SELECT fact, CASE WHEN fact % 10 = 3 THEN 'settled' ELSE 'open' END AS state, cents FROM facts")
def s06(spark, d):
    """A CSV ledger of which some rows are settled: their old rows go, the new ones come."""
    path, f = _scratch(spark, "ledger"), facts(spark, d)
    f.select("fact", F.lit("open").alias("state"), "cents").write.option("header", True).csv(path)
    ledger = spark.read.schema("fact BIGINT, state STRING, cents BIGINT").option("header", True).csv(path)
    settled = f.where("fact % 10 = 3").select("fact", F.lit("settled").alias("state"), "cents")
    return ledger.join(settled, "fact", "left_anti").unionByName(settled)


@query("S07_sql_scan", "SELECT o.o_orderkey AS fact, c.c_mktsegment AS segment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus IN ('F', 'P') AND o.o_totalprice > 300000")
def s07(spark, d):
    return spark.sql("SELECT o.o_orderkey AS fact, c.c_mktsegment AS segment FROM {o} o JOIN {c} c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus IN ('F', 'P') AND o.o_totalprice > 300000", o=table(spark, d, "orders"), c=table(spark, d, "customer"))


@query("S08_upsert", """
WITH o AS (SELECT key, max(k) FILTER (WHERE kind = 'view') AS k, min(us) AS first_us, max(us) AS last_us FROM tape WHERE kind IN ('view', 'click') AND key % 3 <> 0 GROUP BY key), n AS (SELECT key, max(k) FILTER (WHERE kind = 'signup' AND key % 2 = 0) AS k, min(us) AS first_us, max(us) AS last_us FROM tape WHERE kind IN ('signup', 'error') AND key % 5 <> 0 GROUP BY key)
SELECT coalesce(o.key, n.key) AS key, coalesce(n.k, o.k) AS k, least(o.first_us, n.first_us) AS first_us, greatest(o.last_us, n.last_us) AS last_us FROM o FULL OUTER JOIN n ON o.key = n.key""")
def s08(spark, d):
    t = tape(spark, d)
    part = lambda rows, cond: rows.groupBy("key").agg(F.max(F.when(F.expr(cond), F.col("k"))).alias("k"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    old = part(t.where("kind IN ('view', 'click') AND key % 3 <> 0"), "kind = 'view'")
    new = part(t.where("kind IN ('signup', 'error') AND key % 5 <> 0"), "kind = 'signup' AND key % 2 = 0")
    return T.upsert(old, new, ["key"], ("first_us",), ("last_us",))


@query("S09_write_once", "SELECT side, count(*) AS n, true AS second_refused FROM steps GROUP BY side")
def s09(spark, d):
    path = _scratch(spark, "once")
    s = steps(spark, d).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    T.write_once(s, path, partition_by="side")
    try:
        T.write_once(s, path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).select(F.col("side").cast("string").alias("side"), "n", F.lit(refused).alias("second_refused"))


@query("S10_json_sink", "SELECT grp, CASE WHEN step > 1 THEN round(qty / (step - 1.0), 4) END AS ratio FROM steps WHERE step <= 2")
def s10(spark, d):
    path = _scratch(spark, "json")
    ratio = F.when(F.col("step") > 1, F.round(F.col("qty") / (F.col("step") - 1.0), 4)).otherwise(F.lit(float("nan")))
    T.null_bad_numbers(steps(spark, d).where("step <= 2").select("grp", ratio.alias("ratio"))).write.option("ignoreNullFields", "false").json(path)
    return spark.read.schema("grp BIGINT, ratio DOUBLE").json(path)


@query("S11_fingerprints")
def s11(spark, d):
    names = ("events", "orders", "lineitem")
    each = [T.fingerprint(table(spark, d, n)).withColumn("name", F.lit(n)) for n in names]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("S11_manifest", """
WITH n AS (SELECT key % 4 AS part, seq, cents, (row_number() OVER (PARTITION BY key % 4 ORDER BY seq) - 1) // 500 AS chunk FROM tape),
c AS (SELECT part, chunk, count(*) AS n, bool_or(part = 2 AND seq % 997 = 0 AND cents IS NOT NULL) AS hit FROM n GROUP BY ALL)
SELECT part, chunk, CASE WHEN hit THEN 'changed' WHEN part = 3 THEN 'missing' ELSE 'same' END AS status FROM c
UNION ALL SELECT 4, chunk, 'new' FROM c WHERE part = 0""")
def s11_manifest(spark, d):
    """Two landings of the tape's files, the second with values changed in one, one lost and one more: which
    chunk of which file is not what the first one's manifest says."""
    t = tape(spark, d).select((F.col("key") % 4).alias("part"), "key", "us", "seq", "kind", "cents")

    def chunks(name, rows):
        path = _scratch(spark, name)
        rows.repartition("part").sortWithinPartitions("part", "seq").write.partitionBy("part").parquet(path)
        found = MF.chunk_digests(spark, [path], 500)
        return found.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "chunk", "digest")

    touched = F.when((F.col("part") == 2) & (F.col("seq") % 997 == 0), F.col("cents") + 1).otherwise(F.col("cents"))
    second = t.where("part <> 3").withColumn("cents", touched).unionByName(t.where("part = 0").withColumn("part", F.lit(4).cast("long")))
    return MF.compare(chunks("landed-a", t), chunks("landed-b", second), ["part", "chunk"])


@query("S12_incremental_shards", "SELECT status, reason, count(*) AS shards, sum(n) AS n FROM (SELECT key, count(*) AS n, CASE WHEN key % 4 = 0 THEN 'skipped' WHEN count(*) FILTER (WHERE kind = 'purchase') = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN key % 4 = 0 THEN 'verified' WHEN count(*) FILTER (WHERE kind = 'purchase') = 0 THEN 'no_purchase' ELSE '' END AS reason FROM tape GROUP BY key) GROUP BY ALL")
def s12(spark, d):
    """Shards (keys) verified before are skipped; the rest is worked on and audited."""
    t = tape(spark, d)
    done = t.select("key").distinct().where("key % 4 = 0").withColumn("status", F.lit("ok"))
    todo = T.remaining(t, done, ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "purchase").alias("p"))
    audit = todo.select("key", "n", F.when(F.col("p") == 0, "error").otherwise("ok").alias("status"), F.when(F.col("p") == 0, "no_purchase").otherwise("").alias("reason"))
    old = t.join(done.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumns({"status": F.lit("skipped"), "reason": F.lit("verified")})
    return audit.unionByName(old).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"))


@query("S12_shard_files", """
WITH s AS (SELECT key % 8 AS shard, count(*) AS n, count(*) FILTER (WHERE kind = 'purchase') AS p FROM tape GROUP BY 1),
r AS (SELECT n, CASE WHEN p = 0 THEN 'error' WHEN shard IN (0, 1, 2) THEN 'skipped' ELSE 'ok' END AS status,
CASE WHEN p = 0 THEN 'no_purchase' WHEN shard IN (0, 1, 2) THEN 'verified' WHEN shard = 3 THEN 'changed' ELSE 'new' END AS reason FROM s)
SELECT status, reason, count(*) AS shards, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def s12_files(spark, d):
    """A run over files, broken off after four of eight, and its continuation: a file is skipped
    where its digest is the manifest's and its shard, read back, has the content that was
    entered; one that changed in between is done anew."""
    source, shards = _scratch(spark, "shard-in"), _scratch(spark, "shard-out")
    t = tape(spark, d).select((F.col("key") % 8).alias("shard"), "key", "us", "seq", "kind", "cents")

    def land(rows, i):
        rows.where(f"shard = {i}").coalesce(1).write.mode("overwrite").parquet(f"{source}/part={i}")

    for i in range(8):
        # Shard 3 lands incomplete first.
        land(t.where("kind <> 'error'") if i == 3 else t, i)
    first = SH.run_shards(spark, [f"{source}/part={i}" for i in range(4)], f"{shards}/1", None)
    land(t, 3)
    second = SH.run_shards(spark, [f"{source}/part={i}" for i in range(8)], f"{shards}/2", first)
    return second.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"))


@query("S13_page_blocks", "WITH b AS (SELECT page_id, unnest((string_split(html, '<li>')[2:])) AS block, generate_subscripts((string_split(html, '<li>')[2:]), 1) AS pos FROM pages WHERE html IS NOT NULL) SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(block, 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(block, '>([^<]*)<', 1) AS label FROM b")
def s13(spark, d):
    p = table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.posexplode(F.split("html", "<li>")).alias("pos", "block")).where("pos > 0")
    return p.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("block", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("block", ">([^<]*)<", 1).alias("label"))


@query("S14_nested_payload", "SELECT grp, side, count(*) AS players, CASE WHEN count(*) FILTER (WHERE disc = 0) = 0 THEN sum(disc) END AS money, sum(qty) AS hp FROM steps GROUP BY grp, side")
def s14(spark, d):
    """Payload text of a group: teams with players; a sum is known only if all parts are."""
    player = F.struct(F.col("step").cast("string").alias("id"), F.nullif("disc", F.lit(0)).cast("string").alias("money"), F.col("qty").cast("string").alias("hp"))
    teams = steps(spark, d).groupBy("grp", "side").agg(F.collect_list(player).alias("players"))
    text = teams.groupBy("grp").agg(F.to_json(F.struct(F.collect_list(F.struct("side", "players")).alias("teams"))).alias("payload"))
    j = text.select("grp", F.from_json("payload", "teams ARRAY<STRUCT<side: STRING, players: ARRAY<STRUCT<id: STRING, money: STRING, hp: STRING>>>>").alias("j"))
    t = j.select("grp", F.inline("j.teams"))
    total = lambda f: F.aggregate(F.transform("players", lambda p: p[f].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("grp", "side", F.size("players").cast("bigint").alias("players"), total("money").alias("money"), total("hp").alias("hp"))


@query("S15_string_or_array", "SELECT seq, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END AS n, CASE WHEN k % 3 = 0 THEN kind || '|' || k WHEN k % 3 = 1 THEN kind ELSE '' END AS joined FROM tape")
def s15(spark, d):
    raw = F.when(F.col("k") % 3 == 0, F.to_json(F.array("kind", F.col("k").cast("string")))).when(F.col("k") % 3 == 1, F.col("kind"))
    t = tape(spark, d).withColumn("raw", raw).withColumn("items", T.string_or_array("raw"))
    return t.select("seq", F.size("items").alias("n"), F.array_join("items", "|").alias("joined"))


@query("S16_message_demux", "SELECT CASE kind WHEN 'view' THEN 'book' WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'best' ELSE 'other' END AS route, count(*) AS n, sum(cents) AS cents FROM tape GROUP BY 1")
def s16(spark, d):
    """Messages, alone or several in an array, are routed by their shape and counted."""
    body = {"view": "bids", "click": "changes", "purchase": "trade_price", "signup": "best_bid"}
    message = F.lit(None).cast("string")
    for kind, field in body.items():
        message = F.when(F.col("kind") == kind, F.to_json(F.struct("seq", F.col("cents").alias(field)))).otherwise(message)
    message = F.coalesce(message, F.to_json(F.struct("seq", F.col("cents").alias("noise"))))
    packs = tape(spark, d).withColumn("m", message).groupBy(F.floor(F.col("seq") / 3).alias("pack")).agg(F.collect_list("m").alias("ms"))
    raw = packs.select(F.when(F.size("ms") == 1, F.col("ms")[0]).otherwise(F.concat(F.lit("["), F.array_join("ms", ","), F.lit("]"))).alias("raw"))
    shape = "STRUCT<seq: BIGINT, bids: BIGINT, changes: BIGINT, trade_price: BIGINT, best_bid: BIGINT, noise: BIGINT>"
    one = F.when(F.col("raw").startswith("["), F.from_json("raw", f"ARRAY<{shape}>")).otherwise(F.array(F.from_json("raw", shape)))
    m = raw.select(F.inline(one))
    route = F.when(F.col("bids").isNotNull(), "book").when(F.col("changes").isNotNull(), "change").when(F.col("trade_price").isNotNull(), "trade").when(F.col("best_bid").isNotNull(), "best").otherwise("other")
    return m.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bids", "changes", "trade_price", "best_bid", "noise")).alias("cents"))


@query("S17_binding_dimension", "WITH b AS (SELECT grp, side, min(part) AS token FROM steps GROUP BY grp, side) SELECT grp, max(token) FILTER (WHERE side = 'O') AS o_token, max(token) FILTER (WHERE side = 'F') AS f_token FROM b GROUP BY grp HAVING count(*) = 2 AND count(DISTINCT token) = 2")
def s17(spark, d):
    b = steps(spark, d).groupBy("grp", "side").agg(F.min("part").alias("token")).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("side", "token"))).alias("m"))
    tokens = F.map_values("m")
    binary = b.where((F.size("m") == 2) & (F.size(F.array_distinct(tokens)) == 2))
    return binary.select("grp", F.col("m")["O"].alias("o_token"), F.col("m")["F"].alias("f_token"))


@query("S18_day_worklist", "WITH days AS (SELECT CAST(unnest(range(9496, 9526)) AS BIGINT) AS day), log AS (SELECT day, CASE WHEN count(*) >= 8 THEN 'ok' ELSE 'error' END AS status FROM facts GROUP BY day) SELECT d.day, coalesce(l.status, 'new') AS status FROM days d LEFT JOIN log l ON d.day = l.day WHERE l.status IS DISTINCT FROM 'ok'")
def s18(spark, d):
    log = facts(spark, d).groupBy("day").agg(F.when(F.count(F.lit(1)) >= 8, "ok").otherwise("error").alias("status"))
    days = spark.range(9496, 9526).withColumnRenamed("id", "day")
    return T.remaining(days, log, ["day"]).join(log, "day", "left").select("day", F.coalesce("status", F.lit("new")).alias("status"))


@query("S19_paged_merge", "SELECT k AS id, min(seq // 100) AS page, min(seq) AS first_seq, count(*) AS seen FROM tape WHERE kind = 'view' GROUP BY k")
def s19(spark, d):
    p = tape(spark, d).where("kind = 'view'").select(F.col("k").alias("id"), F.floor(F.col("seq") / 100).alias("page"), "seq")
    return p.groupBy("id").agg(F.min("page").alias("page"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("seen"))
