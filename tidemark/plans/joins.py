"""Queries J01 to J27: joins in time, on intervals, sets and composite keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains as CH
from ..operators import joins as J
from ..operators import setjoin as SJ
from ..operators import windows as W
from ..operators.asof import asof, asof_bucketed
from ..sources.tables import facts, steps, table, tape
from .registry import query

MIN, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def _probes(t):
    return t.where("kind = 'purchase'").select("key", "us", "seq", "cents")


def _quotes(t):
    return t.where("kind = 'view'").select("key", "us", "seq", "cents")


@query("J01_asof_backward", """
WITH p AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view')
SELECT p.key, p.us, p.seq, f.seq AS f_seq, f.cents AS f_cents FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us >= f.us""")
def j01(spark, d):
    t = tape(spark, d)
    return asof(_probes(t), _quotes(t), ["key"], "us", ["cents"]).select("key", "us", "seq", "f_seq", "f_cents")


@query("J01_asof_hot_keys", """
WITH p AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view')
SELECT p.key, p.us, p.seq, f.seq AS f_seq, f.cents AS f_cents FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us >= f.us""")
def j01_hot(spark, d):
    t = tape(spark, d)
    return asof_bucketed(_probes(t), _quotes(t), ["key"], "us", ["cents"], 6 * HOUR).select("key", "us", "seq", "f_seq", "f_cents")


@query("J02_asof_strict", """
WITH s AS (SELECT fact, entity, day, cents FROM facts)
SELECT a.fact, (SELECT max_by(b.fact, (b.day, b.fact)) FROM s b WHERE b.entity = a.entity AND b.day < a.day) AS f_fact,
       (SELECT max_by(b.cents, (b.day, b.fact)) FROM s b WHERE b.entity = a.entity AND b.day < a.day) AS f_cents FROM s a""")
def j02(spark, d):
    f = facts(spark, d).select("fact", "entity", "day", "cents")
    return asof(f, f, ["entity"], "day", ["fact", "cents"], order="fact", strict=True).select("fact", "f_fact", "f_cents")


@query("J03_asof_max_age", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view')
SELECT p.seq, CASE WHEN p.us - f.us <= 21600000000 THEN f.cents END AS f_cents, CASE WHEN p.us - f.us <= 21600000000 THEN p.us - f.us END AS age FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us >= f.us""")
def j03(spark, d):
    t = tape(spark, d)
    return asof(_probes(t), _quotes(t), ["key"], "us", ["cents"], tolerance=6 * HOUR).select("seq", "f_cents", (F.col("us") - F.col("f_us")).alias("age"))


@query("J04_asof_forward", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view')
SELECT p.seq, CASE WHEN f.us - p.us <= 43200000000 THEN f.cents END AS f_cents, CASE WHEN f.us - p.us <= 43200000000 THEN f.us - p.us END AS wait FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us <= f.us""")
def j04(spark, d):
    t = tape(spark, d)
    return asof(_probes(t), _quotes(t), ["key"], "us", ["cents"], direction="forward", tolerance=12 * HOUR).select("seq", "f_cents", (F.col("f_us") - F.col("us")).alias("wait"))


@query("J05_interval_bracket", """
WITH p AS (SELECT key, us, us + 86400000000 AS us_end, seq FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view'),
b AS (SELECT p.*, f.cents AS start_cents FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us >= f.us),
e AS (SELECT b.*, f.cents AS fwd FROM b ASOF LEFT JOIN f ON b.key = f.key AND b.us_end <= f.us),
l AS (SELECT key, max_by(cents, us) AS last_cents FROM f GROUP BY key)
SELECT e.seq, e.start_cents, coalesce(e.fwd, l.last_cents) AS end_cents FROM e LEFT JOIN l ON e.key = l.key""")
def j05(spark, d):
    t = tape(spark, d)
    p, f = _probes(t), _quotes(t)
    b = asof(p, f, ["key"], "us", ["cents"]).select("key", "seq", (F.col("us") + DAY).alias("us"), F.col("f_cents").alias("start_cents"))
    e = asof(b, f, ["key"], "us", ["cents"], direction="forward")
    last = f.groupBy("key").agg(F.max_by("cents", F.struct("us", "seq")).alias("last_cents"))
    return e.join(last, "key", "left").select("seq", "start_cents", F.coalesce("f_cents", "last_cents").alias("end_cents"))


@query("J06_nearest_event", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, kind FROM tape WHERE kind <> 'purchase')
SELECT p.seq, min_by(f.kind, (abs(f.us - p.us), f.seq)) AS label, min(abs(f.us - p.us)) AS gap FROM p JOIN f ON p.key = f.key AND abs(f.us - p.us) <= 10800000000 GROUP BY p.seq""")
def j06(spark, d):
    t = tape(spark, d)
    pairs = J.interval_pairs(_probes(t), t.where("kind <> 'purchase'").select("key", "us", "seq", "kind"), ["key"], "us", -3 * HOUR, 3 * HOUR)
    gap = F.abs(F.col("r_us") - F.col("us"))
    return pairs.groupBy("seq").agg(F.min_by("r_kind", F.struct(gap, F.col("r_seq"))).alias("label"), F.min(gap).alias("gap"))


@query("J07_strict_past_profile", """
SELECT a.fact, count(b.fact) AS n, count(b.fact) FILTER (WHERE b.won) AS wins, sum(b.cents) AS cents FROM facts a LEFT JOIN facts b
ON b.entity = a.entity AND b.day + 30 < a.day AND b.class <> a.class GROUP BY a.fact""")
def j07(spark, d):
    """Facts available (30 days after their date) before the decision; those of the own class
    (series) are taken off again by the same running sums over (entity, class)."""
    f = facts(spark, d).withColumn("ready", F.col("day") + 30).withColumn("w", F.col("won").cast("long"))
    sums = lambda by: [F.sum(F.lit(1)).over(W.upto(by, ["ready", "fact"])).alias("n"), F.sum("w").over(W.upto(by, ["ready", "fact"])).alias("wins"), F.sum("cents").over(W.upto(by, ["ready", "fact"])).alias("sum")]
    probes = f.select("fact", "entity", "class", F.col("day").alias("ready"))
    all_ = asof(probes, f.select("entity", "ready", "fact", *sums(["entity"])), ["entity"], "ready", ["n", "wins", "sum"], order="fact", strict=True, prefix="a_")
    own = asof(all_, f.select("entity", "class", "ready", "fact", *sums(["entity", "class"])), ["entity", "class"], "ready", ["n", "wins", "sum"], order="fact", strict=True, prefix="o_")
    less = lambda c: F.coalesce(F.col(f"a_{c}"), F.lit(0)) - F.coalesce(F.col(f"o_{c}"), F.lit(0))
    n = less("n")
    return own.select("fact", n.alias("n"), less("wins").alias("wins"), F.when(n > 0, less("sum")).alias("cents"))


@query("J08_composite_keys", """
SELECT s.grp, s.step, f.entity, p.p_brand AS brand, n.n_name AS nation FROM steps s JOIN facts f ON s.grp = f.fact LEFT JOIN part p ON s.part = p.p_partkey
LEFT JOIN supplier u ON s.supp = u.s_suppkey LEFT JOIN nation n ON u.s_nationkey = n.n_nationkey WHERE s.qty >= 40""")
def j08(spark, d):
    s, f = steps(spark, d).where("qty >= 40"), facts(spark, d)
    dims = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("nation"))
    return s.join(f, s["grp"] == f["fact"]).join(table(spark, d, "part"), F.col("part") == F.col("p_partkey"), "left").join(dims, F.col("supp") == F.col("s_suppkey"), "left").select("grp", "step", "entity", F.col("p_brand").alias("brand"), "nation")


@query("J09_outer_merge_fill", """
WITH a AS (SELECT key, us, max_by(cents, seq) AS c FROM tape WHERE kind = 'view' GROUP BY key, us), b AS (SELECT key, us, max_by(cents, seq) AS c FROM tape WHERE kind = 'click' GROUP BY key, us),
m AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.us, b.us) AS us, a.c AS ac, b.c AS bc FROM a FULL OUTER JOIN b ON a.key = b.key AND a.us = b.us)
SELECT key, us, last_value(ac IGNORE NULLS) OVER w AS left_cents, last_value(bc IGNORE NULLS) OVER w AS right_cents FROM m WINDOW w AS (PARTITION BY key ORDER BY us ROWS UNBOUNDED PRECEDING)""")
def j09(spark, d):
    t = tape(spark, d).where("kind IN ('view', 'click')")
    rows = t.groupBy("key", "us").agg(F.max_by(F.when(F.col("kind") == "view", F.col("cents")), F.when(F.col("kind") == "view", F.col("seq"))).alias("ac"), F.max_by(F.when(F.col("kind") == "click", F.col("cents")), F.when(F.col("kind") == "click", F.col("seq"))).alias("bc"))
    w = W.upto(["key"], ["us"])
    return rows.select("key", "us", F.last("ac", True).over(w).alias("left_cents"), F.last("bc", True).over(w).alias("right_cents"))


@query("J10_lookback_semi", """
SELECT a.seq FROM tape a WHERE a.kind = 'purchase' AND EXISTS (SELECT 1 FROM tape b WHERE b.kind = 'error' AND b.key = a.key AND b.us >= a.us - 7200000000 AND b.us < a.us)""")
def j10(spark, d):
    t = tape(spark, d)
    return J.interval_semi(_probes(t), t.where("kind = 'error'").select("key", "us"), ["key"], "us", -2 * HOUR, -1).select("seq")


@query("J11_lookahead_semi", """
SELECT a.seq, EXISTS (SELECT 1 FROM tape b WHERE b.kind = 'purchase' AND b.key = a.key AND b.us > a.us AND b.us <= a.us + 14400000000) AS avenged FROM tape a WHERE a.kind = 'error'""")
def j11(spark, d):
    t = tape(spark, d)
    errors = t.where("kind = 'error'").select("key", "us", "seq")
    hit = J.interval_semi(errors, t.where("kind = 'purchase'").select("key", "us"), ["key"], "us", 1, 4 * HOUR).select("seq", F.lit(True).alias("hit"))
    return errors.join(hit, "seq", "left").select("seq", F.coalesce("hit", F.lit(False)).alias("avenged"))


@query("J12_fuzzy_band_match", """
WITH l AS (SELECT fact, day, cents, class, lower(regexp_replace(class, '[^A-Za-z]', '', 'g')) AS name FROM facts WHERE status = 'F'),
r AS (SELECT fact, day, class, lower(regexp_replace(class, '[^A-Za-z]', '', 'g')) AS name FROM facts WHERE status = 'O'),
m AS (SELECT l.fact, r.fact AS other, CASE WHEN l.name = r.name THEN 2 WHEN least(length(l.name), length(r.name)) >= 4 AND (contains(l.name, r.name) OR contains(r.name, l.name)) THEN 1 ELSE 0 END AS score, abs(l.day - r.day) AS gap FROM l JOIN r ON abs(l.day - r.day) <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY score DESC, gap, other) AS rn, count(*) FILTER (WHERE score > 0) OVER (PARTITION BY fact, score, gap) AS tied FROM m)
SELECT fact, other, CAST(score AS INT) AS score, gap, tied > 1 AS ambiguous FROM k WHERE rn = 1 AND score > 0""")
def j12(spark, d):
    """Facts of one day and name have the same candidates, so days and names are matched, not
    facts."""
    from ..functions.scalars import letters, name_score

    f = facts(spark, d).withColumn("name", letters("class"))
    left = f.where("status = 'F'").select("fact", "day", "name")
    right = f.where("status = 'O'").groupBy("day", "name").agg(F.min("fact").alias("fact"), F.count(F.lit(1)).alias("n"))
    m = J.interval_pairs(left.select("day", "name").distinct(), right, [], "day", -2, 2).withColumn("score", name_score("name", "r_name")).withColumn("gap", F.abs(F.col("r_day") - F.col("day")))
    even = m.where("score > 0").groupBy("day", "name", "score", "gap").agg(F.min("r_fact").alias("other"), F.sum("r_n").alias("n"))
    best = even.groupBy("day", "name").agg(F.min(F.struct((-F.col("score")).alias("least"), "gap", "other", "score", "n")).alias("x"))
    return left.join(best, ["day", "name"]).select("fact", "x.other", "x.score", "x.gap", (F.col("x.n") > 1).alias("ambiguous"))


@query("J13_unordered_pair_match", """
WITH l AS (SELECT s.grp, min(part) AS p, max(part) AS q, min(day) AS day FROM steps s GROUP BY grp HAVING min(part) < max(part)),
r AS (SELECT s.grp, min(supp) AS p, max(supp) AS q, min(day) AS day FROM steps s GROUP BY grp HAVING min(supp) < max(supp)),
m AS (SELECT l.grp, r.grp AS other, row_number() OVER (PARTITION BY l.grp ORDER BY r.grp) AS rn FROM l JOIN r ON l.p % 10 = r.p % 10 AND l.q % 10 = r.q % 10 AND abs(l.day - r.day) <= 36 AND l.grp <> r.grp)
SELECT grp, other FROM m WHERE rn = 1""")
def j13(spark, d):
    """Each group's parts against the suppliers of every other group.  The first two candidates
    of a day are enough, as one of them may be the group itself."""
    s, by = steps(spark, d), ["p", "q", "day"]
    side = lambda c: s.groupBy("grp").agg((F.min(c) % 10).alias("p"), (F.max(c) % 10).alias("q"), F.min("day").alias("day"), (F.min(c) < F.max(c)).alias("two")).where("two").drop("two")
    left = side("part")
    right = side("supp").withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("grp"))).where("rn <= 2").drop("rn")
    m = J.interval_pairs(left.select(*by).distinct(), right, ["p", "q"], "day", -36, 36)
    first = m.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("r_grp")), 1, 2).alias("g"))
    other = F.get(F.filter("g", lambda x: x != F.col("grp")), F.lit(0))
    return left.join(first, by).select("grp", other.alias("other")).where("other IS NOT NULL")


@query("J14_mutual_unique_pairs", """
WITH l AS (SELECT fact, entity, day FROM facts WHERE status = 'F'), r AS (SELECT fact, entity, day FROM facts WHERE status = 'P'),
m AS (SELECT l.fact, r.fact AS other, count(*) OVER (PARTITION BY l.fact) AS nl, count(*) OVER (PARTITION BY r.fact) AS nr FROM l JOIN r ON l.entity = r.entity AND abs(l.day - r.day) <= 20)
SELECT l.fact, CASE WHEN m.nl = 1 AND m.nr = 1 THEN m.other END AS other, CASE WHEN m.fact IS NULL THEN 'unmatched' WHEN m.nl = 1 AND m.nr = 1 THEN 'paired' ELSE 'ambiguous' END AS outcome, count(*) AS n
FROM l LEFT JOIN m ON l.fact = m.fact GROUP BY ALL""")
def j14(spark, d):
    f = facts(spark, d).select("fact", "entity", "day", "status")
    left = f.where("status = 'F'").drop("status")
    m = J.interval_pairs(left, f.where("status = 'P'").drop("status"), ["entity"], "day", -20, 20)
    m = m.withColumn("nl", F.count(F.lit(1)).over(Window.partitionBy("fact"))).withColumn("nr", F.count(F.lit(1)).over(Window.partitionBy("r_fact"))).select("fact", "r_fact", ((F.col("nl") == 1) & (F.col("nr") == 1)).alias("one"))
    out = left.select("fact").join(m, "fact", "left")
    outcome = F.when(F.col("one").isNull(), "unmatched").when(F.col("one"), "paired").otherwise("ambiguous")
    return out.select("fact", F.when(F.col("one"), F.col("r_fact")).alias("other"), outcome.alias("outcome")).groupBy("fact", "other", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("J15_latest_annotation", """
WITH p AS (SELECT key, us, seq, nullif(k % 4, 0) AS a, nullif(k % 3, 0) AS b FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, seq, cents, nullif(k % 4, 1) AS a, nullif(k % 3, 1) AS b FROM tape WHERE kind = 'signup')
SELECT p.seq, max_by(f.cents, (f.us, f.seq)) AS note, count(*) AS n FROM p JOIN f ON p.key = f.key AND f.us <= p.us AND f.us >= p.us - 432000000000 AND (p.a IS NULL OR f.a IS NULL OR p.a = f.a) AND (p.b IS NULL OR f.b IS NULL OR p.b = f.b)
AND ((p.a IS NOT NULL AND f.a IS NOT NULL) OR (p.b IS NOT NULL AND f.b IS NOT NULL)) GROUP BY p.seq""")
def j15(spark, d):
    """Identity columns that either side doesn't know are skipped; at least one must be compared."""
    t = tape(spark, d)
    p = t.where("kind = 'purchase'").select("key", "us", "seq", F.nullif(F.col("k") % 4, F.lit(0)).alias("a"), F.nullif(F.col("k") % 3, F.lit(0)).alias("b"))
    f = t.where("kind = 'signup'").select("key", "us", "seq", "cents", F.nullif(F.col("k") % 4, F.lit(1)).alias("a"), F.nullif(F.col("k") % 3, F.lit(1)).alias("b"))
    m = J.interval_pairs(p, f, ["key"], "us", -5 * DAY, 0)
    fits = F.coalesce(F.col("a") == F.col("r_a"), F.lit(True)) & F.coalesce(F.col("b") == F.col("r_b"), F.lit(True)) & ((F.col("a") == F.col("r_a")).isNotNull() | (F.col("b") == F.col("r_b")).isNotNull())
    return m.where(fits).groupBy("seq").agg(F.max_by("r_cents", F.struct("r_us", "r_seq")).alias("note"), F.count(F.lit(1)).alias("n"))


@query("J16_prioritised_lookup", """
WITH a AS (SELECT key, k, max(cents) AS v FROM tape WHERE kind = 'signup' GROUP BY key, k), b AS (SELECT key, max(cents) AS v FROM tape WHERE kind = 'error' AND k > 90 GROUP BY key), c AS (SELECT k, max(cents) AS v FROM tape WHERE kind = 'click' GROUP BY k)
SELECT t.seq, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'both' WHEN b.v IS NOT NULL THEN 'key' WHEN c.v IS NOT NULL THEN 'k' END AS level FROM tape t LEFT JOIN a ON t.key = a.key AND t.k = a.k LEFT JOIN b ON t.key = b.key LEFT JOIN c ON t.k = c.k WHERE t.kind = 'purchase'""")
def j16(spark, d):
    t = tape(spark, d)
    a = t.where("kind = 'signup'").groupBy("key", "k").agg(F.max("cents").alias("va"))
    b = t.where("kind = 'error' AND k > 90").groupBy("key").agg(F.max("cents").alias("vb"))
    c = t.where("kind = 'click'").groupBy("k").agg(F.max("cents").alias("vc"))
    m = t.where("kind = 'purchase'").join(a, ["key", "k"], "left").join(b, "key", "left").join(c, "k", "left")
    level = F.when(F.col("va").isNotNull(), "both").when(F.col("vb").isNotNull(), "key").when(F.col("vc").isNotNull(), "k")
    return m.select("seq", F.coalesce("va", "vb", "vc").alias("v"), level.alias("level"))


@query("J17_snapshot_proximity", """
WITH s AS (SELECT grp, step, side, qty AS x, disc AS y FROM steps), p AS (SELECT a.grp, a.step, a.side <> b.side AS cross_side, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM s a JOIN s b ON a.grp = b.grp AND a.step <> b.step)
SELECT grp, step, count(*) FILTER (WHERE cross_side AND dist <= 10) AS foes_near, count(*) FILTER (WHERE NOT cross_side AND dist <= 10) AS friends_near, round(min(dist) FILTER (WHERE cross_side), 4) AS nearest_foe FROM p GROUP BY grp, step""")
def j17(spark, d):
    s = steps(spark, d).select("grp", "step", "side", F.col("qty").alias("x"), F.col("disc").alias("y"))
    o = s.select(F.col("grp").alias("g2"), F.col("step").alias("s2"), F.col("side").alias("side2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    p = s.join(o, (F.col("grp") == F.col("g2")) & (F.col("step") != F.col("s2"))).withColumn("foe", F.col("side") != F.col("side2")).withColumn("dist", F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2))))
    return p.groupBy("grp", "step").agg(F.count_if(F.col("foe") & (F.col("dist") <= 10)).alias("foes_near"), F.count_if(~F.col("foe") & (F.col("dist") <= 10)).alias("friends_near"), F.round(F.min(F.when(F.col("foe"), F.col("dist"))), 4).alias("nearest_foe"))


@query("J18_set_overlap", """
WITH m AS (SELECT DISTINCT grp, part % 50 AS m FROM steps), n AS (SELECT grp, count(*) AS n FROM m GROUP BY grp),
c AS (SELECT a.grp AS a, b.grp AS b, count(*) AS common FROM m a JOIN m b ON a.m = b.m AND a.grp < b.grp GROUP BY ALL HAVING count(*) >= 3)
SELECT c.a, c.b, c.common, x.n + y.n - c.common AS in_all FROM c JOIN n x ON c.a = x.grp JOIN n y ON c.b = y.grp WHERE 100 * c.common >= 60 * (x.n + y.n - c.common)""")
def j18(spark, d):
    return SJ.overlap_pairs(steps(spark, d).select("grp", (F.col("part") % 50).alias("m")), "grp", "m", 3, 60)


@query("J19_offset_grid", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us FROM tape WHERE kind = 'view'), g AS (SELECT CAST(unnest(range(-10, 46, 5)) AS INT) AS off),
h AS (SELECT g.off, p.key, count(*) AS hits FROM p, g WHERE EXISTS (SELECT 1 FROM f WHERE f.key = p.key AND abs(f.us - (p.us + CAST(g.off AS BIGINT) * 60000000)) <= 300000000) GROUP BY ALL)
SELECT key, max_by(off, (hits, -off)) AS off, max(hits) AS hits FROM h GROUP BY key""")
def j19(spark, d):
    t = tape(spark, d)
    shifted = _probes(t).withColumn("off", F.explode(F.sequence(F.lit(-10), F.lit(45), F.lit(5)))).withColumn("us", F.col("us") + F.col("off").cast("long") * MIN)
    hits = J.interval_semi(shifted, _quotes(t).select("key", "us"), ["key"], "us", -5 * MIN, 5 * MIN).groupBy("key", "off").agg(F.count(F.lit(1)).alias("hits"))
    return hits.groupBy("key").agg(F.max_by("off", F.struct("hits", -F.col("off"))).alias("off"), F.max("hits").alias("hits"))


@query("J20_side_binding", """
WITH l AS (SELECT key, kind, max_by(cents, (us, seq)) AS last FROM tape WHERE kind IN ('view', 'click') GROUP BY key, kind), w AS (SELECT key, max(last) FILTER (WHERE kind = 'view') AS a, max(last) FILTER (WHERE kind = 'click') AS b FROM l GROUP BY key)
SELECT key, a, b, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a > b THEN 'view' WHEN b > a THEN 'click' ELSE 'tie' END AS winner FROM w""")
def j20(spark, d):
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("cents")), F.when(F.col("kind") == k, F.struct("us", "seq")))
    w = tape(spark, d).where("kind IN ('view', 'click')").groupBy("key").agg(last("view").alias("a"), last("click").alias("b"))
    return w.select("key", "a", "b", F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown").when(F.col("a") > F.col("b"), "view").when(F.col("b") > F.col("a"), "click").otherwise("tie").alias("winner"))


@query("J21_unpivot_sides", """
SELECT grp, step, 'own' AS perspective, qty AS mine, disc AS theirs, win FROM steps WHERE step = 1 UNION ALL SELECT grp, step, 'other', disc, qty, NOT win FROM steps WHERE step = 1""")
def j21(spark, d):
    s = steps(spark, d).where("step = 1")
    view = lambda name, a, b, w: F.struct(F.lit(name).alias("perspective"), F.col(a).alias("mine"), F.col(b).alias("theirs"), w.alias("win"))
    return s.select("grp", "step", F.inline(F.array(view("own", "qty", "disc", F.col("win")), view("other", "disc", "qty", ~F.col("win")))))


@query("J22_two_sided_profiles", """
WITH p AS (SELECT supp, round(avg(qty), 6) AS q, count(*) AS n FROM steps GROUP BY supp), h AS (SELECT grp, min_by(supp, step) AS home, max_by(supp, step) AS away FROM steps GROUP BY grp)
SELECT h.grp, round(a.q - b.q, 4) AS diff, a.n - b.n AS dn FROM h JOIN p a ON h.home = a.supp JOIN p b ON h.away = b.supp""")
def j22(spark, d):
    s = steps(spark, d)
    p = s.groupBy("supp").agg(F.round(F.avg("qty"), 6).alias("q"), F.count(F.lit(1)).alias("n"))
    h = s.groupBy("grp").agg(F.min_by("supp", "step").alias("home"), F.max_by("supp", "step").alias("away"))
    as_ = lambda k: p.select(F.col("supp").alias(k), F.col("q").alias(k + "_q"), F.col("n").alias(k + "_n"))
    return h.join(as_("home"), "home").join(as_("away"), "away").select("grp", F.round(F.col("home_q") - F.col("away_q"), 4).alias("diff"), (F.col("home_n") - F.col("away_n")).alias("dn"))


@query("J23_semi_anti", """
SELECT c_custkey AS entity, CASE WHEN c_custkey IN (SELECT entity FROM facts) THEN 'matched' ELSE 'unmatched' END AS outcome FROM customer""")
def j23(spark, d):
    c, f = table(spark, d, "customer").select(F.col("c_custkey").alias("entity")), facts(spark, d).select("entity")
    return c.join(f, "entity", "left_semi").withColumn("outcome", F.lit("matched")).unionByName(c.join(f, "entity", "left_anti").withColumn("outcome", F.lit("unmatched")))


@query("J24_trigger_horizons", """
WITH p AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'purchase'), g AS (SELECT p.*, h, p.us + h * 3600000000 AS at FROM p, (VALUES (1), (6), (24)) v(h)), f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view'),
a AS (SELECT g.*, f.cents AS entry, g.us - f.us AS age FROM g ASOF LEFT JOIN f ON g.key = f.key AND g.us >= f.us), e AS (SELECT a.*, f.cents AS exit, f.us - a.at AS wait FROM a ASOF LEFT JOIN f ON a.key = f.key AND a.at <= f.us)
SELECT h, CASE WHEN entry IS NULL THEN 'no_entry' WHEN age > 43200000000 THEN 'stale_entry' WHEN exit IS NULL THEN 'no_exit' WHEN wait > 21600000000 THEN 'late_exit' ELSE 'ok' END AS reason, count(*) AS n, sum(CASE WHEN age <= 43200000000 AND wait <= 21600000000 THEN exit - entry END) AS drift FROM e GROUP BY ALL""")
def j24(spark, d):
    t = tape(spark, d)
    f = _quotes(t)
    a = asof(_probes(t), f, ["key"], "us", ["cents"], prefix="e_").withColumn("h", F.explode(F.array(F.lit(1), F.lit(6), F.lit(24)))).withColumn("age", F.col("us") - F.col("e_us")).withColumn("us", F.col("us") + F.col("h").cast("long") * HOUR)
    e = asof(a, f, ["key"], "us", ["cents"], direction="forward", prefix="x_").withColumn("wait", F.col("x_us") - F.col("us"))
    reason = F.when(F.col("e_cents").isNull(), "no_entry").when(F.col("age") > 12 * HOUR, "stale_entry").when(F.col("x_cents").isNull(), "no_exit").when(F.col("wait") > 6 * HOUR, "late_exit").otherwise("ok")
    fine = (F.col("age") <= 12 * HOUR) & (F.col("wait") <= 6 * HOUR)
    return e.groupBy("h", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(fine, F.col("x_cents") - F.col("e_cents"))).alias("drift"))


@query("J25_snapshot_cutoff", """
SELECT f.fact, f.day, count(s.step) FILTER (WHERE s.day <= f.day + 60) AS seen, sum(s.qty) FILTER (WHERE s.day <= f.day + 60) AS qty, max(s.day) FILTER (WHERE s.day <= f.day + 60) AS last_day FROM facts f JOIN steps s ON f.fact = s.grp GROUP BY f.fact, f.day""")
def j25(spark, d):
    m = facts(spark, d).join(steps(spark, d).select("grp", "step", "qty", F.col("day").alias("at")), F.col("fact") == F.col("grp"))
    seen = F.col("at") <= F.col("day") + 60
    return m.groupBy("fact", "day").agg(F.count(F.when(seen, 1)).alias("seen"), F.sum(F.when(seen, F.col("qty"))).alias("qty"), F.max(F.when(seen, F.col("at"))).alias("last_day"))


@query("J26_two_sided_pairing", """
WITH p AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'purchase'), v AS (SELECT key, us, cents FROM tape WHERE kind = 'view'), c AS (SELECT key, us, cents FROM tape WHERE kind = 'click'),
a AS (SELECT p.*, CASE WHEN p.us - v.us <= 43200000000 THEN v.cents END AS own FROM p ASOF LEFT JOIN v ON p.key = v.key AND p.us >= v.us), b AS (SELECT a.*, CASE WHEN a.us - c.us <= 43200000000 THEN c.cents END AS other FROM a ASOF LEFT JOIN c ON a.key = c.key AND a.us >= c.us)
SELECT seq, 'own' AS perspective, own - other AS edge FROM b WHERE own IS NOT NULL AND other IS NOT NULL UNION ALL SELECT seq, 'other', other - own FROM b WHERE own IS NOT NULL AND other IS NOT NULL""")
def j26(spark, d):
    t = tape(spark, d)
    a = asof(_probes(t), _quotes(t), ["key"], "us", ["cents"], tolerance=12 * HOUR, prefix="v_")
    b = asof(a, t.where("kind = 'click'").select("key", "us", "seq", "cents"), ["key"], "us", ["cents"], tolerance=12 * HOUR, prefix="c_").where("v_cents IS NOT NULL AND c_cents IS NOT NULL")
    gap = F.col("v_cents") - F.col("c_cents")
    return b.select("seq", F.inline(F.array(F.struct(F.lit("own").alias("perspective"), gap.alias("edge")), F.struct(F.lit("other").alias("perspective"), (-gap).alias("edge")))))


SHOCKS = """
q AS (SELECT key, us, seq, cents, lag(cents) OVER (PARTITION BY key ORDER BY us, seq) AS prev FROM tape WHERE kind <> 'error'),
c AS (SELECT key, us, seq, cents, cents - prev AS move FROM q WHERE abs(cents - prev) >= 4000),
r AS (SELECT key, min(us) AS us FROM c GROUP BY key UNION ALL SELECT r.key, (SELECT min(c.us) FROM c WHERE c.key = r.key AND c.us >= r.us + 86400000000) AS us FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.key = r.key AND c.us >= r.us + 86400000000)),
shocks AS (SELECT c.* FROM c JOIN r ON c.key = r.key AND c.us = r.us)"""


def shocks(spark, d, cooldown=W.cooldown):
    """Moves of at least 40.00 against the last tick, one a day and key at most."""
    q = tape(spark, d).where("kind <> 'error'").select("key", "us", "seq", "cents")
    move = F.col("cents") - F.lag("cents").over(Window.partitionBy("key").orderBy("us", "seq"))
    return cooldown(q.withColumn("move", move).where(F.abs("move") >= 4000), ["key"], "us", "seq", DAY)


@query("W11_cooldown", f"WITH RECURSIVE {SHOCKS.strip()} SELECT key, us, seq, move FROM shocks")
def w11(spark, d):
    return shocks(spark, d).select("key", "us", "seq", "move")


@query("W11_cooldown_hot_keys", f"WITH RECURSIVE {SHOCKS.strip()} SELECT key, us, seq, move FROM shocks")
def w11_hot(spark, d):
    """As W11_cooldown, with chains of successors in place of a pass, so that no key is one task's work."""
    return shocks(spark, d, CH.cooldown_spread).select("key", "us", "seq", "move")


def study_sql(horizons=(6, 24, 72), latencies=(1,)) -> str:
    """CTEs of the study at horizons and latencies in hours."""
    hours, late = (", ".join(f"({x})" for x in xs) for xs in (horizons, latencies))
    return f"""{SHOCKS.strip()},
f AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view'), g AS (SELECT s.key, s.seq, s.us, s.move, h, latency, s.us + latency * 3600000000 AS t_in, s.us + h * 3600000000 AS t_out FROM shocks s, (VALUES {hours}) v(h), (VALUES {late}) w(latency)),
a AS (SELECT g.*, f.cents AS entry, f.us - g.t_in AS w_in FROM g ASOF LEFT JOIN f ON g.key = f.key AND g.t_in <= f.us), e AS (SELECT a.*, f.cents AS exit, f.us - a.t_out AS w_out FROM a ASOF LEFT JOIN f ON a.key = f.key AND a.t_out <= f.us),
study AS (SELECT key, seq, us, move, h, latency, CASE WHEN w_in <= 86400000000 AND w_out <= 86400000000 THEN (exit - entry) * CASE WHEN move > 0 THEN -1 ELSE 1 END END AS pnl FROM e)"""


STUDY = study_sql()


def study(spark, d, horizons=(6, 24, 72), latency_hours=1):
    """Each shock and horizon: enter at the first quote after the latency, leave at the first
    one after the horizon, against the move; null where either quote comes too late."""
    f = tape(spark, d).where("kind = 'view'").select("key", "us", "seq", "cents")
    s = shocks(spark, d).select("key", "seq", "move", F.col("us").alias("t0"))
    entry = asof(s.withColumn("us", F.col("t0") + latency_hours * HOUR), f, ["key"], "us", ["cents"], direction="forward", tolerance=DAY, prefix="i_").drop("us")
    out = entry.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("us", F.col("t0") + F.col("h").cast("long") * HOUR)
    leave = asof(out, f, ["key"], "us", ["cents"], direction="forward", tolerance=DAY, prefix="o_")
    pnl = (F.col("o_cents") - F.col("i_cents")) * F.when(F.col("move") > 0, -1).otherwise(1)
    return leave.select("key", "seq", F.col("t0").alias("us"), "move", "h", pnl.alias("pnl"))


@query("J27_event_study", f"WITH RECURSIVE {STUDY} SELECT h, count(*) AS n, count(pnl) AS filled, sum(pnl) AS total, round(avg(pnl), 4) AS mean, round(quantile_cont(pnl, 0.5), 4) AS median, count(*) FILTER (WHERE pnl > 0) AS hits FROM study GROUP BY h")
def j27(spark, d):
    return study(spark, d).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count("pnl").alias("filled"), F.sum("pnl").alias("total"), F.round(F.avg("pnl"), 4).alias("mean"), F.round(F.percentile("pnl", 0.5), 4).alias("median"), F.count_if(F.col("pnl") > 0).alias("hits"))
