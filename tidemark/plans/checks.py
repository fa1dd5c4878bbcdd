"""Queries F01 to F28: filters, predicates, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import windows as W
from ..sources.tables import days, facts, steps, table, tape
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _key():
    return Window.partitionBy("key").orderBy("us", "seq")


@query("F01_finite_number", "SELECT seq, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN CAST(k AS DOUBLE) ELSE CAST(cents AS DOUBLE) END AS num FROM tape")
def f01(spark, d):
    raw = F.when(F.col("k") % 4 == 0, "NaN").when(F.col("k") % 4 == 1, F.concat(F.lit("x"), F.col("k"))).when(F.col("k") % 4 == 2, F.col("k").cast("string")).otherwise(F.col("cents").cast("string"))
    num = F.expr("try_cast(raw AS double)")
    t = tape(spark, d).withColumn("raw", raw).withColumn("num", num)
    return t.select("seq", F.when(~F.isnan("num") & (F.abs("num") < float("inf")), F.col("num")).alias("num"))


@query("F02_timestamp_fallback", "SELECT seq, coalesce(CASE WHEN k % 3 = 0 THEN us END, CASE WHEN k % 3 = 1 THEN us + 1 END, us + 2) AS at, CASE k % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'received' ELSE 'recv' END AS clock FROM tape")
def f02(spark, d):
    t = tape(spark, d).withColumns({"local": F.when(F.col("k") % 3 == 0, F.col("us")), "received": F.when(F.col("k") % 3 == 1, F.col("us") + 1), "recv": F.col("us") + 2})
    return t.select("seq", F.coalesce("local", "received", "recv").alias("at"), F.when(F.col("local").isNotNull(), "local").when(F.col("received").isNotNull(), "received").otherwise("recv").alias("clock"))


@query("F03_decided_facts", "SELECT fact, entity, won FROM facts WHERE status IN ('F', 'O') AND cents > 0 AND class IS NOT NULL AND class <> '4-NOT SPECIFIED'")
def f03(spark, d):
    return facts(spark, d).where(F.col("status").isin("F", "O") & (F.col("cents") > 0) & (F.col("class") != "4-NOT SPECIFIED")).select("fact", "entity", "won")


@query("F04_strict_eligibility", "SELECT seq, CASE WHEN kind = 'error' THEN 'ineligible' WHEN k % 2 = 1 THEN 'transport' WHEN k - 50 < -2 THEN 'early' WHEN k - 50 > 30 THEN 'late' END AS reason FROM tape")
def f04(spark, d):
    lag = F.col("k") - 50
    r = K.first_reason([(F.col("kind") == "error", "ineligible"), (F.col("k") % 2 == 1, "transport"), (lag < -2, "early"), (lag > 30, "late")])
    return tape(spark, d).select("seq", r.alias("reason"))


@query("F05_reasons", "SELECT coalesce(CASE WHEN qty < 5 THEN 'few' WHEN disc = 0 THEN 'no_discount' WHEN line > 6 THEN 'line' WHEN cents > 8000000 THEN 'dear' END, 'kept') AS reason, count(*) AS n FROM steps GROUP BY 1")
def f05(spark, d):
    r = K.first_reason([(F.col("qty") < 5, "few"), (F.col("disc") == 0, "no_discount"), (F.col("line") > 6, "line"), (F.col("cents") > 8_000_000, "dear")])
    return steps(spark, d).groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("F06_group_quarantine", "SELECT grp, step FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps t WHERE t.grp = s.grp AND (t.qty < 3 OR t.disc = 10))")
def f06(spark, d):
    s = steps(spark, d).withColumn("reason", K.first_reason([(F.col("qty") < 3, "few"), (F.col("disc") == 10, "top")]))
    return K.quarantine(s.select("grp", "step", "reason"), ["grp"])


@query("F07_checked_join", "SELECT s.grp, s.step, f.entity, f.fact IS NOT NULL AS found FROM steps s LEFT JOIN facts f ON s.grp = f.fact WHERE s.qty = 50")
def f07(spark, d):
    s = steps(spark, d).where("qty = 50").select("grp", "step")
    return K.checked_join(s, facts(spark, d).select(F.col("fact").alias("grp"), "entity"), ["grp"]).select("grp", "step", "entity", F.col("_found").alias("found"))


@query("F08_duplicate_keys", "SELECT l_orderkey AS grp, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f08(spark, d):
    return K.duplicate_keys(steps(spark, d), ["grp", "line"])


@query("F09_contiguity", "SELECT grp, count(*) = max(line) AND count(DISTINCT line) = count(*) AS contiguous, bool_and(later) AS monotone FROM (SELECT *, coalesce(lead(day) OVER (PARTITION BY grp ORDER BY line, step) > day, true) AS later FROM steps) GROUP BY grp")
def f09(spark, d):
    """Rows of one line stand in order of their days, as steps do: three columns are sorted once, and a line that comes again
    follows itself."""
    o = Window.partitionBy("grp").orderBy("line", "day")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("bigint").alias("line"), days("l_shipdate").alias("day"))
    s = s.select("grp", "line", F.coalesce(F.lead("day").over(o) > F.col("day"), F.lit(True)).alias("later"), F.col("line").eqNullSafe(F.lag("line").over(o)).alias("again"))
    n = F.count(F.lit(1))
    return s.groupBy("grp").agg(((n == F.max("line")) & (F.count_if(F.col("line").isNotNull() & ~F.col("again")) == n)).alias("contiguous"), F.bool_and("later").alias("monotone"))


@query("F10_column_roles", "WITH r(name, role) AS (VALUES ('grp', 'metadata'), ('step', 'metadata'), ('qty', 'feature'), ('disc', 'feature'), ('win', 'label')), c AS (UNPIVOT (SELECT count(grp) AS grp, count(step) AS step, count(qty) AS qty, count(disc) AS disc, count(win) AS win FROM steps) ON grp, step, qty, disc, win INTO NAME name VALUE n) SELECT name, role, n FROM r JOIN c USING (name)")
def f10(spark, d):
    """Role metadata of a dataset's columns, checked to be disjoint and exhaustive."""
    s = K.require_columns(steps(spark, d), ["grp", "step", "qty", "disc", "win"]).select("grp", "step", "qty", "disc", "win")
    s = K.with_roles(s, {"metadata": ["grp", "step"], "feature": ["qty", "disc"], "label": ["win"]}, forbidden=("win",))
    roles = F.create_map(*[F.lit(x) for f in s.schema.fields for x in (f.name, f.metadata["role"])])
    stats = s.agg(*[F.count(c).alias(c) for c in s.columns])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.element_at(roles, F.lit(c)).alias("role"), F.col(c).alias("n")) for c in s.columns])))


@query("F11_label_recomputation", "WITH g AS (SELECT grp, sum(CASE WHEN win THEN qty ELSE -qty END) AS final, max_by(flag, (line, step)) AS stored FROM steps GROUP BY grp) SELECT grp, final, stored, (final > 0) = (stored = 'R') AS agrees FROM g")
def f11(spark, d):
    g = steps(spark, d).groupBy("grp").agg(F.sum(F.when(F.col("win"), F.col("qty")).otherwise(-F.col("qty"))).alias("final"), F.max_by("flag", F.struct("line", "step")).alias("stored"))
    return g.withColumn("agrees", (F.col("final") > 0) == (F.col("stored") == "R"))


@query("F12_reconcile", "WITH g AS (SELECT grp, count(*) AS n, bool_or(win) AS won FROM steps GROUP BY grp) SELECT f.fact, CASE WHEN g.grp IS NULL THEN 'missing' WHEN g.n < 2 THEN 'invalid' WHEN g.won <> f.won THEN 'disagrees' ELSE 'matched' END AS status FROM facts f LEFT JOIN g ON f.fact = g.grp")
def f12(spark, d):
    g = steps(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bool_or("win").alias("g_won"))
    status = F.when(F.col("grp").isNull(), "missing").when(F.col("n") < 2, "invalid").when(F.col("g_won") != F.col("won"), "disagrees").otherwise("matched")
    f = facts(spark, d)
    return f.join(g, f["fact"] == g["grp"], "left").select("fact", status.alias("status"))


@query("F13_cache_audit", "WITH a AS (SELECT supp, avg(qty) AS q FROM steps GROUP BY supp), b AS (SELECT supp, avg(qty) AS q FROM steps WHERE grp % 50 <> 0 GROUP BY supp) SELECT coalesce(a.supp, b.supp) AS supp, CASE WHEN a.supp IS NULL OR b.supp IS NULL THEN 'missing' WHEN abs(a.q - b.q) <= 0.05 THEN 'same' ELSE 'differs' END AS status FROM a FULL OUTER JOIN b ON a.supp = b.supp")
def f13(spark, d):
    s = steps(spark, d)
    a, b = s.groupBy("supp").agg(F.avg("qty").alias("qa")), s.where("grp % 50 <> 0").groupBy("supp").agg(F.avg("qty").alias("qb"))
    status = F.when(F.col("qa").isNull() | F.col("qb").isNull(), "missing").when(F.abs(F.col("qa") - F.col("qb")) <= 0.05, "same").otherwise("differs")
    return a.join(b, "supp", "full").select("supp", status.alias("status"))


QA = "qa AS (SELECT kind, count(*) AS n, round(avg(CASE WHEN cents > 500 THEN 1.0 ELSE 0 END), 6) AS valid, round(quantile_cont(gap, 0.5), 2) AS gap50, round(quantile_cont(gap, 0.95), 2) AS gap95, count(*) FILTER (WHERE gap > 36000000000) AS stale, count(*) FILTER (WHERE same) AS repeated FROM (SELECT *, us - lag(us) OVER (PARTITION BY key ORDER BY us, seq) AS gap, coalesce(k = lag(k) OVER (PARTITION BY key ORDER BY us, seq), false) AS same FROM tape) GROUP BY kind)"


def capture_qa(spark, d):
    t = tape(spark, d).withColumns({"gap": F.col("us") - F.lag("us").over(_key()), "same": F.coalesce(F.col("k") == F.lag("k").over(_key()), F.lit(False))})
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("cents") > 500).cast("int")), 6).alias("valid"), F.round(F.percentile("gap", 0.5), 2).alias("gap50"), F.round(F.percentile("gap", 0.95), 2).alias("gap95"), F.count_if(F.col("gap") > 10 * HOUR).alias("stale"), F.count_if("same").alias("repeated"))


@query("F14_capture_qa", f"WITH {QA} SELECT * FROM qa")
def f14(spark, d):
    return capture_qa(spark, d)


@query("F15_classify", f"WITH {QA} SELECT kind, CASE WHEN valid < 0.85 OR stale * 2 > n THEN 'FAIL' WHEN stale * 3 > n OR repeated > 20 THEN 'WARN' ELSE 'PASS' END AS verdict, concat_ws(',', CASE WHEN valid < 0.85 THEN 'valid' END, CASE WHEN stale * 3 > n THEN 'stale' END, CASE WHEN repeated > 20 THEN 'repeated' END) AS reasons FROM qa")
def f15(spark, d):
    bad, warn, rep = F.col("valid") < 0.85, F.col("stale") * 3 > F.col("n"), F.col("repeated") > 20
    verdict = F.when(bad | (F.col("stale") * 2 > F.col("n")), "FAIL").when(warn | rep, "WARN").otherwise("PASS")
    reasons = F.array_compact(F.array(F.when(bad, "valid"), F.when(warn, "stale"), F.when(rep, "repeated")))
    return capture_qa(spark, d).select("kind", verdict.alias("verdict"), F.array_join(reasons, ",").alias("reasons"))


@query("F16_sessions", """
WITH s AS (SELECT *, count(*) FILTER (WHERE kind = 'signup') OVER w AS segment, us - lag(us) OVER (PARTITION BY key ORDER BY us, seq) AS gap FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING))
SELECT key, segment, count(*) AS n, min(us) AS start_us, max(us) AS end_us, coalesce(max(gap) FILTER (WHERE kind = 'signup') <= 18000000000, false) AS restart FROM s GROUP BY key, segment""")
def f16(spark, d):
    t = tape(spark, d).withColumns({"segment": F.count(F.when(F.col("kind") == "signup", 1)).over(W.upto(["key"], ["us", "seq"])), "gap": F.col("us") - F.lag("us").over(_key())})
    restart = F.coalesce(F.max(F.when(F.col("kind") == "signup", F.col("gap"))) <= 5 * HOUR, F.lit(False))
    return t.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), restart.alias("restart"))


@query("F17_completeness", "SELECT key, k // 10 AS bout, CASE WHEN count(*) FILTER (WHERE kind <> 'error') = 0 THEN 'unobserved' WHEN count(*) FILTER (WHERE kind = 'signup') = 0 THEN 'no_first' WHEN count(*) FILTER (WHERE kind = 'purchase') = 0 THEN 'no_terminal' ELSE 'complete' END AS status FROM tape GROUP BY ALL")
def f17(spark, d):
    none = lambda c: F.count_if(c) == 0
    k = F.col("kind")
    status = F.when(none(k != "error"), "unobserved").when(none(k == "signup"), "no_first").when(none(k == "purchase"), "no_terminal").otherwise("complete")
    return tape(spark, d).groupBy("key", F.floor(F.col("k") / 10).cast("int").alias("bout")).agg(status.alias("status"))


@query("F18_coverage_overlap", "WITH s AS (SELECT key, min(us) FILTER (WHERE kind = 'view') AS v0, max(us) FILTER (WHERE kind = 'view') AS v1, min(us) FILTER (WHERE kind = 'click') AS c0, max(us) FILTER (WHERE kind = 'click') AS c1 FROM tape GROUP BY key) SELECT key, greatest(0, least(v1, c1) - greatest(v0, c0)) AS overlap, greatest(0, least(v1, c1) - greatest(v0, c0)) >= 2160000000000 AS enough FROM s WHERE v0 IS NOT NULL AND c0 IS NOT NULL")
def f18(spark, d):
    ends = lambda kind: (F.min(F.when(F.col("kind") == kind, F.col("us"))), F.max(F.when(F.col("kind") == kind, F.col("us"))))
    (v0, v1), (c0, c1) = ends("view"), ends("click")
    s = tape(spark, d).groupBy("key").agg(v0.alias("v0"), v1.alias("v1"), c0.alias("c0"), c1.alias("c1")).where("v0 IS NOT NULL AND c0 IS NOT NULL")
    o = F.greatest(F.lit(0), F.least("v1", "c1") - F.greatest("v0", "c0"))
    return s.select("key", o.alias("overlap"), (o >= 25 * DAY).alias("enough"))


@query("F19_startable", "SELECT fact, day FROM facts WHERE day BETWEEN 9500 AND 9530 ORDER BY day, fact")
def f19(spark, d):
    return facts(spark, d).where(F.col("day").between(9500, 9530)).select("fact", "day").orderBy("day", "fact")


@query("F20_book_validity", "SELECT grp, step, CASE WHEN part IS NULL THEN 'identity' WHEN day < 9200 THEN 'stale' WHEN qty = 0 THEN 'empty' WHEN disc * 5 >= qty THEN 'crossed' WHEN qty < 10 THEN 'thin' ELSE 'ok' END AS reason FROM steps")
def f20(spark, d):
    r = K.first_reason([(F.col("part").isNull(), "identity"), (F.col("day") < 9200, "stale"), (F.col("qty") == 0, "empty"), (F.col("disc") * 5 >= F.col("qty"), "crossed"), (F.col("qty") < 10, "thin")])
    return steps(spark, d).select("grp", "step", F.coalesce(r, F.lit("ok")).alias("reason"))


@query("F21_terminal_state", "WITH s AS (SELECT grp, step, count(*) FILTER (WHERE win) OVER w AS a, count(*) FILTER (WHERE NOT win) OVER w AS b FROM steps WINDOW w AS (PARTITION BY grp ORDER BY step ROWS UNBOUNDED PRECEDING)) SELECT grp, step, CASE WHEN a >= 2 AND b >= 2 THEN 'contested' WHEN a >= 2 THEN 'won' WHEN b >= 2 THEN 'lost' END AS state FROM s")
def f21(spark, d):
    w = W.upto(["grp"], ["step"])
    s = steps(spark, d).select("grp", "step", F.count(F.when(F.col("win"), 1)).over(w).alias("a"), F.count(F.when(~F.col("win"), 1)).over(w).alias("b"))
    return s.select("grp", "step", F.when((F.col("a") >= 2) & (F.col("b") >= 2), "contested").when(F.col("a") >= 2, "won").when(F.col("b") >= 2, "lost").alias("state"))


@query("F22_terminal_score", "SELECT fact, cents % 20 AS a, day % 20 AS b, CASE WHEN greatest(cents % 20, day % 20) < 13 THEN false WHEN greatest(cents % 20, day % 20) = 13 THEN least(cents % 20, day % 20) < 12 ELSE (greatest(cents % 20, day % 20) - 13) % 3 = 0 AND greatest(cents % 20, day % 20) - least(cents % 20, day % 20) BETWEEN 2 AND 4 END AS terminal, CASE WHEN (cents % 20) + (day % 20) < 24 THEN ((cents % 20 + day % 20) // 12) % 2 = 0 ELSE ((cents % 20 + day % 20 - 24) // 3) % 2 = 0 END AS first_side FROM facts")
def f22(spark, d):
    """First to 13 with overtime of three steps a half; side by parity of halves played."""
    a, b = F.col("cents") % 20, F.col("day") % 20
    top, low, n = F.greatest(a, b), F.least(a, b), a + b
    over = F.when(top < 13, False).when(top == 13, low < 12).otherwise(((top - 13) % 3 == 0) & (top - low).between(2, 4))
    side = F.when(n < 24, F.floor(n / 12) % 2 == 0).otherwise(F.floor((n - 24) / 3) % 2 == 0)
    return facts(spark, d).select("fact", a.alias("a"), b.alias("b"), over.alias("terminal"), side.alias("first_side"))


@query("F23_min_history", "WITH n AS (SELECT fact, entity, count(*) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own, count(*) OVER (PARTITION BY entity % 50 ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS other FROM facts) SELECT fact, least(own, other) >= 3 AS eligible FROM n")
def f23(spark, d):
    f = facts(spark, d).withColumn("pool", F.col("entity") % 50)
    n = F.count(F.lit(1))
    return f.select("fact", (F.least(n.over(W.earlier(["entity"], "day")), n.over(W.earlier(["pool"], "day"))) >= 3).alias("eligible"))


@query("F24_snapshot_validity", "SELECT grp, CASE WHEN count(*) < 4 THEN 'size' WHEN count(DISTINCT part) < count(*) THEN 'repeated' WHEN abs(count(*) FILTER (WHERE side = 'O') - count(*) FILTER (WHERE side = 'F')) > 1 THEN 'unbalanced' WHEN max(qty) > 49 THEN 'range' ELSE 'ok' END AS problem FROM steps GROUP BY grp")
def f24(spark, d):
    n, of = F.count(F.lit(1)), lambda s: F.count_if(F.col("side") == s)
    problem = F.when(n < 4, "size").when(F.count_distinct("part") < n, "repeated").when(F.abs(of("O") - of("F")) > 1, "unbalanced").when(F.max("qty") > 49, "range").otherwise("ok")
    return steps(spark, d).groupBy("grp").agg(problem.alias("problem"))


@query("F25_domain_validation", "SELECT bool_and(qty BETWEEN 1 AND 50) AS qty_ok, bool_and(disc BETWEEN 0 AND 10) AS disc_ok, bool_and(side IN ('O', 'F')) AS side_ok, bool_and(qty < 50) AS strict_ok, count(*) AS n FROM steps")
def f25(spark, d):
    return steps(spark, d).agg(F.bool_and(F.col("qty").between(1, 50)).alias("qty_ok"), F.bool_and(F.col("disc").between(0, 10)).alias("disc_ok"), F.bool_and(F.col("side").isin("O", "F")).alias("side_ok"), F.bool_and(F.col("qty") < 50).alias("strict_ok"), F.count(F.lit(1)).alias("n"))


@query("F26_open_close_identity", "SELECT c.c_custkey AS id, CASE WHEN c.c_acctbal < 0 THEN 'closed' WHEN n.n_name IS NULL THEN 'no_nation' WHEN c.c_name NOT LIKE 'Customer#%' THEN 'name' WHEN c.c_mktsegment = 'MACHINERY' THEN 'topic' ELSE 'bound' END AS status FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def f26(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    r = K.first_reason([(F.col("c_acctbal") < 0, "closed"), (F.col("n_name").isNull(), "no_nation"), (~F.col("c_name").startswith("Customer#"), "name"), (F.col("c_mktsegment") == "MACHINERY", "topic")])
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce(r, F.lit("bound")).alias("status"))


@query("F27_resolution", "SELECT s.grp, max_by(s.part, s.win) AS winner FROM steps s JOIN facts f ON s.grp = f.fact WHERE f.status = 'F' GROUP BY s.grp HAVING count(*) FILTER (WHERE s.win) = 1")
def f27(spark, d):
    closed = facts(spark, d).where("status = 'F'").select(F.col("fact").alias("grp"))
    g = steps(spark, d).join(closed, "grp").groupBy("grp").agg(F.max(F.when(F.col("win"), F.col("part"))).alias("winner"), F.count_if("win").alias("n"))
    return g.where("n = 1").select("grp", "winner")


@query("F28_spec_validation", "SELECT conv_id, CASE WHEN min(turn) <> 0 THEN 'start' WHEN count(*) <> max(turn) + 1 THEN 'turns' WHEN bool_or(text IS NULL OR text = '') THEN 'text' WHEN bool_or(role NOT IN ('user', 'assistant', 'system')) THEN 'role' ELSE 'ok' END AS status, count(*) AS n FROM conversations GROUP BY conv_id")
def f28(spark, d):
    c = table(spark, d, "conversations")
    n = F.count(F.lit(1))
    status = F.when(F.min("turn") != 0, "start").when(n != F.max("turn") + 1, "turns").when(F.bool_or(F.col("text").isNull() | (F.col("text") == "")), "text").when(F.bool_or(~F.col("role").isin("user", "assistant", "system")), "role").otherwise("ok")
    return c.groupBy("conv_id").agg(status.alias("status"), n.alias("n"))
