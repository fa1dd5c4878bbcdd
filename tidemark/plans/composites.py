"""Queries C01 to C41 and W31: computations built from the other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import checks as K
from ..operators import joins as J
from ..operators import windows as W
from ..operators.asof import asof
from ..sources.tables import facts, steps, table, tape
from .aggregates import SCORED, scored
from .joins import STUDY, study
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _grp():
    return Window.partitionBy("grp").orderBy("step")


def _key():
    return Window.partitionBy("key").orderBy("us", "seq")


@query("W31_wide_horizons", f"WITH RECURSIVE {STUDY} SELECT key, seq, max(pnl) FILTER (WHERE h = 6) AS h6, max(pnl) FILTER (WHERE h = 24) AS h24, max(pnl) FILTER (WHERE h = 72) AS h72 FROM study GROUP BY key, seq")
def w31(spark, d):
    wide = study(spark, d).groupBy("key", "seq").pivot("h", [6, 24, 72]).agg(F.max("pnl"))
    return wide.select("key", "seq", *[F.col(str(h)).alias(f"h{h}") for h in (6, 24, 72)])


@query("C01_best_of_book", "SELECT grp, day, max(cents) FILTER (WHERE side = 'O') AS best_bid, min(cents) FILTER (WHERE side = 'F') AS best_ask, arg_max(qty, (cents, qty)) FILTER (WHERE side = 'O') AS bid_size FROM steps GROUP BY grp, day")
def c01(spark, d):
    o = F.col("side") == "O"
    return steps(spark, d).groupBy("grp", "day").agg(F.max(F.when(o, F.col("cents"))).alias("best_bid"), F.min(F.when(~o, F.col("cents"))).alias("best_ask"), F.max(F.when(o, F.struct("cents", "qty"))).alias("x")).select("grp", "day", "best_bid", "best_ask", F.col("x.qty").alias("bid_size"))


@query("C02_boundaries_filled", "WITH f AS (SELECT *, last_value(CASE WHEN kind = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS bout FROM tape) SELECT key, coalesce(bout, -1) AS bout, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY us, seq) AS seqs FROM f WHERE kind IN ('signup', 'purchase') GROUP BY ALL")
def c02(spark, d):
    bout = F.last(F.when(F.col("kind") == "signup", F.col("k")), True).over(W.upto(["key"], ["us", "seq"]))
    t = tape(spark, d).withColumn("bout", F.coalesce(bout, F.lit(-1))).where("kind IN ('signup', 'purchase')")
    seqs = F.transform(F.array_sort(F.collect_list(F.struct("us", "seq"))), lambda x: x["seq"].cast("string"))
    return t.groupBy("key", "bout").agg(F.count(F.lit(1)).alias("n"), F.array_join(seqs, ",").alias("seqs"))


@query("C03_candidate_lists", "WITH c AS (SELECT grp, min_by(part, step) AS a, max_by(part, step) AS b, count(*) AS n FROM steps GROUP BY grp) SELECT grp, a, b FROM c WHERE a <> b AND a % 20 <> 0 AND b % 20 <> 0")
def c03(spark, d):
    c = steps(spark, d).groupBy("grp").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("step", "part"))).alias("rows"))).alias("j"))
    rows = F.from_json("j", "rows ARRAY<STRUCT<step: BIGINT, part: BIGINT>>")["rows"]
    p = c.select("grp", rows[0]["part"].alias("a"), F.element_at(rows, -1)["part"].alias("b"))
    return p.where("a <> b AND a % 20 <> 0 AND b % 20 <> 0")


@query("C04_closing_line", """
WITH p AS (SELECT key, us, seq, k FROM tape WHERE kind = 'purchase'), f AS (SELECT key, us, cents FROM tape WHERE kind = 'view'), c AS (SELECT p.*, CASE WHEN p.us - f.us <= 86400000000 THEN f.cents END AS close FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us >= f.us)
SELECT thr, count(*) AS bets, sum(CASE WHEN k >= 50 THEN close ELSE -close END) AS pnl FROM c, (VALUES (5), (20), (40)) v(thr) WHERE close IS NOT NULL AND abs(k - close / 100.0) >= thr GROUP BY thr""")
def c04(spark, d):
    t = tape(spark, d)
    c = asof(t.where("kind = 'purchase'").select("key", "us", "seq", "k"), t.where("kind = 'view'").select("key", "us", "seq", "cents"), ["key"], "us", ["cents"], tolerance=DAY).where("f_cents IS NOT NULL")
    b = c.withColumn("thr", F.explode(F.array(F.lit(5), F.lit(20), F.lit(40)))).where(F.abs(F.col("k") - F.col("f_cents") / 100) >= F.col("thr"))
    return b.groupBy("thr").agg(F.count(F.lit(1)).alias("bets"), F.sum(F.when(F.col("k") >= 50, F.col("f_cents")).otherwise(-F.col("f_cents"))).alias("pnl"))


@query("C05_equal_spaced_steps", """
WITH b AS (SELECT key, min(us) AS u0, max(us) AS u1 FROM tape GROUP BY key HAVING count(*) > 1), g AS (SELECT key, i, u0 + (u1 - u0) * i // 10 AS us FROM b, (SELECT unnest(range(0, 11)) AS i)), f AS (SELECT key, us, seq, cents FROM tape), a AS (SELECT g.*, f.cents FROM g ASOF LEFT JOIN f ON g.key = f.key AND g.us >= f.us)
SELECT key, CAST(i AS INT) AS i, lead(cents) OVER (PARTITION BY key ORDER BY i) - cents AS pnl FROM a""")
def c05(spark, d):
    t = tape(spark, d).select("key", "us", "seq", "cents")
    b = t.groupBy("key").agg(F.min("us").alias("u0"), F.max("us").alias("u1"), F.count(F.lit(1)).alias("n")).where("n > 1")
    g = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("key", "i", F.expr("u0 + (u1 - u0) * i div 10").alias("us"))
    a = asof(g, t, ["key"], "us", ["cents"])
    w = Window.partitionBy("key").orderBy("i")
    return a.select("key", "i", (F.lead("f_cents").over(w) - F.col("f_cents")).alias("pnl"))


@query("C06_back_aligned_clock", """
WITH e AS (SELECT key, max(us) AS end_us, max(k) AS k1 FROM tape GROUP BY key), p AS (SELECT t.key, t.seq, e.end_us - CAST(e.k1 - t.k AS BIGINT) * 7200000000 AS us FROM tape t JOIN e ON t.key = e.key WHERE t.kind = 'purchase'), f AS (SELECT key, us, cents FROM tape WHERE kind = 'view')
SELECT p.seq, f.cents, p.us - f.us AS age FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us >= f.us""")
def c06(spark, d):
    t = tape(spark, d)
    e = t.groupBy("key").agg(F.max("us").alias("end_us"), F.max("k").alias("k1"))
    p = t.where("kind = 'purchase'").join(e, "key").select("key", "seq", (F.col("end_us") - (F.col("k1") - F.col("k")).cast("bigint") * 2 * HOUR).alias("us"))
    return asof(p, t.where("kind = 'view'").select("key", "us", "seq", "cents"), ["key"], "us", ["cents"]).select("seq", F.col("f_cents").alias("cents"), (F.col("us") - F.col("f_us")).alias("age"))


@query("C07_score_attach", "WITH x AS (SELECT p_brand AS name, avg(p_size) AS score FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand) SELECT s.side, round(avg(x.score), 4) AS score, count(*) AS n, count(x.score) AS known FROM steps s JOIN part p ON s.part = p.p_partkey LEFT JOIN x ON p.p_brand = x.name GROUP BY s.side")
def c07(spark, d):
    p = table(spark, d, "part")
    x = p.where("p_partkey % 3 = 0").groupBy("p_brand").agg(F.avg("p_size").alias("score"))
    m = steps(spark, d).join(p.select("p_partkey", "p_brand"), F.col("part") == F.col("p_partkey")).join(x, "p_brand", "left")
    return m.groupBy("side").agg(F.round(F.avg("score"), 4).alias("score"), F.count(F.lit(1)).alias("n"), F.count("score").alias("known"))


@query("C08_expected_observed", "WITH e AS (SELECT grp, list_distinct(list(part % 10)) AS e FROM steps WHERE side = 'O' GROUP BY grp), o AS (SELECT grp, list_distinct(list(part % 10)) AS o FROM steps WHERE side = 'F' GROUP BY grp) SELECT e.grp, CASE WHEN o.o IS NULL THEN 'pending' WHEN len(list_filter(o.o, lambda x: NOT list_contains(e.e, x))) = 0 THEN 'ok' ELSE 'mismatch' END AS status FROM e LEFT JOIN o ON e.grp = o.grp")
def c08(spark, d):
    of = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("part") % 10))
    g = steps(spark, d).groupBy("grp").agg(of("O").alias("e"), of("F").alias("o")).where(F.size("e") > 0)
    return g.select("grp", F.when(F.size("o") == 0, "pending").when(F.size(F.array_except("o", "e")) == 0, "ok").otherwise("mismatch").alias("status"))


@query("C09_group_roster", "SELECT grp, array_to_string(list_sort(list_distinct(list(supp) FILTER (WHERE qty >= 5))), ',') AS roster, min_by(side, step) AS first_side, CASE WHEN count(*) > 3 AND min_by(side, step) = 'O' THEN 'F' WHEN count(*) > 3 THEN 'O' ELSE min_by(side, step) END AS last_side FROM steps GROUP BY grp HAVING count(*) FILTER (WHERE qty >= 5) > 0")
def c09(spark, d):
    active = F.collect_set(F.when(F.col("qty") >= 5, F.col("supp")))
    g = steps(spark, d).groupBy("grp").agg(active.alias("r"), F.min_by("side", "step").alias("first_side"), F.count(F.lit(1)).alias("n")).where(F.size("r") > 0)
    flip = F.when(F.col("n") > 3, F.when(F.col("first_side") == "O", "F").otherwise("O")).otherwise(F.col("first_side"))
    return g.select("grp", F.array_join(F.array_sort("r").cast("array<string>"), ",").alias("roster"), "first_side", flip.alias("last_side"))


@query("C10_decision_transitions", "WITH t AS (SELECT side, win, CASE WHEN qty < 15 THEN 'low' WHEN qty < 35 THEN 'mid' ELSE 'high' END AS tier, lag(CASE WHEN qty < 15 THEN 'low' WHEN qty < 35 THEN 'mid' ELSE 'high' END) OVER w AS prev_tier, lag(win) OVER w AS prev_win FROM steps WINDOW w AS (PARTITION BY grp ORDER BY step)) SELECT *, round(n * 1.0 / sum(n) OVER (PARTITION BY prev_tier, prev_win), 6) AS share FROM (SELECT prev_tier, prev_win, tier, count(*) AS n FROM t WHERE prev_tier IS NOT NULL GROUP BY prev_tier, prev_win, tier)")
def c10(spark, d):
    t = steps(spark, d).withColumn("tier", S.bucket("qty", [15, 35], ["low", "mid", "high"]))
    t = t.select("tier", F.lag("tier").over(_grp()).alias("prev_tier"), F.lag("win").over(_grp()).alias("prev_win")).where("prev_tier IS NOT NULL")
    n = t.groupBy("prev_tier", "prev_win", "tier").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prev_tier", "prev_win")), 6))


@query("C11_steps_with_final", "SELECT grp, step, coalesce(sum(CASE WHEN win THEN 1 ELSE -1 END) OVER (PARTITION BY grp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS diff_before, sum(CASE WHEN win THEN 1 ELSE -1 END) OVER (PARTITION BY grp) AS final_diff, count(*) OVER (PARTITION BY grp) AS total FROM steps")
def c11(spark, d):
    x, g = F.when(F.col("win"), 1).otherwise(-1), Window.partitionBy("grp")
    return steps(spark, d).select("grp", "step", F.coalesce(F.sum(x).over(W.before(["grp"], ["step"])), F.lit(0)).alias("diff_before"), F.sum(x).over(g).alias("final_diff"), F.count(F.lit(1)).over(g).alias("total"))


@query("C12_states_before", """
WITH h AS (SELECT DISTINCT supp, day FROM steps), x AS (SELECT supp, day, sum(qty) AS q, count(*) AS n FROM steps GROUP BY ALL), p AS (SELECT a.fact, a.day, b.supp FROM facts a JOIN (SELECT DISTINCT grp, supp FROM steps) b ON a.fact = b.grp),
r AS (SELECT p.fact, p.supp, sum(x.q) AS q, sum(x.n) AS n FROM p LEFT JOIN x ON x.supp = p.supp AND x.day < p.day GROUP BY ALL) SELECT fact, CASE WHEN count(*) = count(n) THEN round(avg(q * 1.0 / n), 4) END AS form, count(*) AS members FROM r GROUP BY fact""")
def c12(spark, d):
    """Members' state strictly before the fact; unknown unless every member's is known."""
    s = steps(spark, d)
    x = s.groupBy("supp", "day").agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("supp").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    state = x.select("supp", "day", F.lit(0).alias("seq"), F.sum("q").over(w).alias("q"), F.sum("n").over(w).alias("n"))
    p = facts(spark, d).select("fact", "day").join(s.select(F.col("grp").alias("fact"), "supp").distinct(), "fact")
    r = asof(p, state, ["supp"], "day", ["q", "n"], strict=True)
    g = r.groupBy("fact").agg(F.avg(F.col("f_q") / F.col("f_n")).alias("form"), F.count(F.lit(1)).alias("members"), F.count("f_n").alias("known"))
    return g.select("fact", F.when(F.col("members") == F.col("known"), F.round("form", 4)).alias("form"), "members")


@query("C13_rates_by_stage", "WITH c AS (SELECT s.grp, k, count(*) FILTER (WHERE s.win AND s.step <= k) AS won, f.won AS y FROM steps s JOIN facts f ON s.grp = f.fact, (VALUES (2), (4)) v(k) GROUP BY s.grp, k, f.won) SELECT k, won, count(*) AS n, round(avg(CASE WHEN y THEN 1.0 ELSE 0 END), 6) AS rate FROM c GROUP BY k, won")
def c13(spark, d):
    s = steps(spark, d).groupBy("grp").agg(*[F.count_if(F.col("win") & (F.col("step") <= k)).alias(f"w{k}") for k in (2, 4)])
    m = s.join(facts(spark, d).select(F.col("fact").alias("grp"), F.col("won").alias("y")), "grp")
    c = m.select("y", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("won")) for k in (2, 4)])))
    return c.groupBy("k", "won").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("int")), 6).alias("rate"))


@query("C14_paired_sides", "WITH t AS (SELECT supp, sum(qty) AS s, count(*) AS n FROM steps GROUP BY supp), o AS (SELECT supp, grp, sum(qty) AS s, count(*) AS n FROM steps GROUP BY ALL), l AS (SELECT o.grp, o.supp, CASE WHEN t.n > o.n THEN (t.s - o.s) * 1.0 / (t.n - o.n) ELSE 25.0 END AS skill FROM o JOIN t ON o.supp = t.supp), g AS (SELECT s.grp, avg(l.skill) FILTER (WHERE s.win) AS w, avg(l.skill) FILTER (WHERE NOT s.win) AS b FROM steps s JOIN l ON s.grp = l.grp AND s.supp = l.supp GROUP BY s.grp) SELECT count(*) AS pairs, round(avg(CASE WHEN w > b THEN 1.0 WHEN w = b THEN 0.5 ELSE 0 END), 3) AS accuracy FROM g WHERE w IS NOT NULL AND b IS NOT NULL")
def c14(spark, d):
    s = steps(spark, d)
    skill = A.leave_one_out(s, "supp", "grp", "qty").select("supp", "grp", F.coalesce("mean_other", F.lit(25.0)).alias("skill"))
    g = s.join(skill, ["supp", "grp"]).groupBy("grp").agg(F.avg(F.when(F.col("win"), F.col("skill"))).alias("w"), F.avg(F.when(~F.col("win"), F.col("skill"))).alias("b")).dropna()
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.when(F.col("w") > F.col("b"), 1.0).when(F.col("w") == F.col("b"), 0.5).otherwise(0.0)), 3).alias("accuracy"))


@query("C15_pairs_dated", "SELECT a.grp, a.step AS step_a, b.step AS step_b, f.day FROM steps a JOIN steps b ON a.grp = b.grp AND a.side = 'O' AND b.side = 'F' JOIN facts f ON a.grp = f.fact")
def c15(spark, d):
    s = steps(spark, d)
    side = lambda x, n: s.where(F.col("side") == x).select("grp", F.col("step").alias(n))
    return side("O", "step_a").join(side("F", "step_b"), "grp").join(facts(spark, d).select(F.col("fact").alias("grp"), "day"), "grp")


@query("C16_member_events", "WITH g AS (SELECT grp, list_sort(list_distinct(list(part))) AS r, bool_or(win) AS won FROM steps GROUP BY grp) SELECT grp, unnest(r) AS member, won FROM g")
def c16(spark, d):
    g = steps(spark, d).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("part")).cast("array<string>"), ",").alias("r"), F.bool_or("win").alias("won"))
    return g.select("grp", F.explode(F.split("r", ",").cast("array<bigint>")).alias("member"), "won")


@query("C17_target_coverage", "SELECT c.c_mktsegment AS segment, count(DISTINCT f.fact) AS facts, count(DISTINCT f.entity) AS entities, count(DISTINCT f.day) AS days, c.c_mktsegment IN ('BUILDING', 'MACHINERY') AS priority FROM customer c LEFT JOIN facts f ON f.entity = c.c_custkey GROUP BY c.c_mktsegment")
def c17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    m = c.join(facts(spark, d), F.col("entity_id") == F.col("entity"), "left")
    return m.groupBy("segment").agg(F.count_distinct("fact").alias("facts"), F.count_distinct("entity").alias("entities"), F.count_distinct("day").alias("days")).withColumn("priority", F.col("segment").isin("BUILDING", "MACHINERY"))


@query("C18_arm_summary", f"WITH RECURSIVE {STUDY} SELECT h, CASE WHEN move > 0 THEN 'short' ELSE 'long' END AS arm, count(pnl) AS n, count(*) FILTER (WHERE pnl > 0) AS hits, sum(pnl) FILTER (WHERE pnl > 0) AS won, sum(pnl) FILTER (WHERE pnl < 0) AS lost FROM study GROUP BY ALL")
def c18(spark, d):
    p = F.col("pnl")
    return study(spark, d).groupBy("h", F.when(F.col("move") > 0, "short").otherwise("long").alias("arm")).agg(F.count("pnl").alias("n"), F.count_if(p > 0).alias("hits"), F.sum(F.when(p > 0, p)).alias("won"), F.sum(F.when(p < 0, p)).alias("lost"))


@query("C19_strategy_join", """
WITH p AS (SELECT supp, round(avg(qty), 6) AS strength FROM steps WHERE grp % 2 = 0 GROUP BY supp), s AS (SELECT grp, min_by(supp, step) AS a, max_by(supp, step) AS b FROM steps WHERE grp % 2 = 1 GROUP BY grp),
m AS (SELECT s.grp, f.fact, f.won, x.strength - y.strength AS edge FROM s LEFT JOIN facts f ON s.grp = f.fact LEFT JOIN p x ON s.a = x.supp LEFT JOIN p y ON s.b = y.supp)
SELECT CASE WHEN fact IS NULL THEN 'no_label' WHEN edge IS NULL THEN 'no_strength' WHEN abs(edge) < 0.05 THEN 'no_edge' ELSE 'taken' END AS reason, count(*) AS n, count(*) FILTER (WHERE won = (edge > 0)) AS agree FROM m GROUP BY 1""")
def c19(spark, d):
    s = steps(spark, d)
    p = s.where("grp % 2 = 0").groupBy("supp").agg(F.round(F.avg("qty"), 6).alias("strength"))
    g = s.where("grp % 2 = 1").groupBy("grp").agg(F.min_by("supp", "step").alias("a"), F.max_by("supp", "step").alias("b"))
    f = facts(spark, d).select("fact", "won")
    as_ = lambda k: p.select(F.col("supp").alias(k), F.col("strength").alias(f"s_{k}"))
    m = g.join(f, g["grp"] == f["fact"], "left").join(as_("a"), "a", "left").join(as_("b"), "b", "left").withColumn("edge", F.col("s_a") - F.col("s_b"))
    r = K.first_reason([(F.col("fact").isNull(), "no_label"), (F.col("edge").isNull(), "no_strength"), (F.abs("edge") < 0.05, "no_edge")])
    return m.groupBy(F.coalesce(r, F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("won") == (F.col("edge") > 0)).alias("agree"))


@query("C20_exit_windows", """
WITH p AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'purchase'), x AS (SELECT p.seq, w, p.cents, quantile_cont(f.cents, 0.5) AS level, count(*) AS n FROM p JOIN (VALUES (12), (48)) v(w) ON true JOIN tape f ON f.key = p.key AND f.kind = 'view' AND f.us > p.us AND f.us <= p.us + CAST(w AS BIGINT) * 3600000000 GROUP BY p.seq, w, p.cents)
SELECT w, count(*) AS n, round(avg(level - cents), 4) AS mean, count(*) FILTER (WHERE level > cents) AS hits FROM x GROUP BY w""")
def c20(spark, d):
    t = tape(spark, d).select("key", "us", "seq", "cents", "kind")
    m = J.interval_pairs(t.where("kind = 'purchase'").drop("kind"), t.where("kind = 'view'"), ["key"], "us", 1, 48 * HOUR)
    m = m.withColumn("w", F.explode(F.array(F.lit(12), F.lit(48)))).where(F.col("r_us") - F.col("us") <= F.col("w").cast("bigint") * HOUR)
    x = m.groupBy("seq", "w", "cents").agg(F.percentile("r_cents", 0.5).alias("level"))
    return x.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("level") - F.col("cents")), 4).alias("mean"), F.count_if(F.col("level") > F.col("cents")).alias("hits"))


@query("C21_role_table", "SELECT supp, n, CASE WHEN rate >= 0.36 THEN 'star' WHEN qty >= 26 THEN 'heavy' ELSE 'support' END AS role, rank() OVER (ORDER BY rate DESC, supp) AS place FROM (SELECT supp, count(*) AS n, round(avg(CASE WHEN win THEN 1.0 ELSE 0 END), 6) AS rate, avg(qty) AS qty FROM steps GROUP BY supp)")
def c21(spark, d):
    """Ranked over suppliers, a dimension."""
    p = steps(spark, d).groupBy("supp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("win").cast("int")), 6).alias("rate"), F.avg("qty").alias("qty"))
    role = F.when(F.col("rate") >= 0.36, "star").when(F.col("qty") >= 26, "heavy").otherwise("support")
    return p.select("supp", "n", role.alias("role"), F.rank().over(Window.orderBy(F.desc("rate"), "supp")).cast("bigint").alias("place"))


@query("C22_signature_gaps", "WITH v AS (SELECT grp, supp, count(*) AS n FROM steps GROUP BY ALL), t AS (SELECT grp, supp AS team FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, supp) AS rn FROM v) WHERE rn = 1), s AS (SELECT s.grp, t.team, f.day, CAST(sum(s.disc) * 1000000 // count(*) AS BIGINT) AS sig FROM steps s JOIN t ON s.grp = t.grp JOIN facts f ON s.grp = f.fact GROUP BY s.grp, t.team, f.day), g AS (SELECT *, sum(sig) OVER w AS past, count(sig) OVER w AS n FROM s WINDOW w AS (PARTITION BY team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT grp, team, CAST(sig * n - past AS DOUBLE) / CAST(nullif(n, 0) AS DOUBLE) AS gap FROM g")
def c22(spark, d):
    s = steps(spark, d)
    v = s.groupBy("grp", "supp").agg(F.count(F.lit(1)).alias("n"))
    team = v.groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("m"), "supp")).alias("x")).select("grp", F.col("x.supp").alias("team"))
    # Signatures are whole millionths, so that sums of them are exact.
    g = s.groupBy("grp").agg(F.expr("sum(disc) * 1000000 div count(1)").alias("sig")).join(team, "grp").join(facts(spark, d).select(F.col("fact").alias("grp"), "day"), "grp")
    past, n = (f("sig").over(W.earlier(["team"], "day")) for f in (F.sum, F.count))
    return g.select("grp", "team", F.try_divide((F.col("sig") * n - past).cast("double"), n.cast("double")).alias("gap"))


@query("C22_head_to_head", """
WITH v AS (SELECT grp, supp, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, supp) AS rn FROM steps GROUP BY grp, supp), t AS (SELECT grp, min(supp) AS a, max(supp) AS b FROM v WHERE rn <= 2 GROUP BY grp HAVING count(*) = 2),
x AS (SELECT s.grp, f.day, s.qty, s.disc, CASE WHEN s.win THEN 1 ELSE 0 END AS y FROM steps s JOIN facts f ON s.grp = f.fact),
e AS (SELECT day, count(*) AS n, sum(qty) AS q, sum(disc) AS d, sum(y) AS y, sum(qty * qty) AS qq, sum(qty * disc) AS qd, sum(disc * disc) AS dd, sum(qty * y) AS qy, sum(disc * y) AS dy FROM x GROUP BY day),
p AS (SELECT day, sum(n) OVER w AS n, sum(q) OVER w AS q, sum(d) OVER w AS d, sum(y) OVER w AS y, sum(qq) OVER w AS qq, sum(qd) OVER w AS qd, sum(dd) OVER w AS dd, sum(qy) OVER w AS qy, sum(dy) OVER w AS dy FROM e WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT day, CAST(n AS DOUBLE) AS n, CAST(q AS DOUBLE) AS q, CAST(d AS DOUBLE) AS d, CAST(y AS DOUBLE) AS y, CAST(n * qq - q * q AS DOUBLE) AS vq, CAST(n * dd - d * d AS DOUBLE) AS vd, CAST(n * qd - q * d AS DOUBLE) AS cov, CAST(n * qy - q * y AS DOUBLE) AS gq, CAST(n * dy - d * y AS DOUBLE) AS gd FROM p WHERE n >= 100),
w AS (SELECT x.grp, x.day, x.y AS won, c.n, c.y AS before, (vd * gq - cov * gd) * (n * x.qty - q) + (vq * gd - cov * gq) * (n * x.disc - d) > 0 AS vote FROM x JOIN c USING (day))
SELECT t.a, t.b, w.grp, w.day, count(*) AS steps, count(*) FILTER (WHERE vote) AS votes, 2 * count(*) FILTER (WHERE vote) > count(*) AS predicted, sum(won) * n > before * count(*) AS actual FROM w JOIN t USING (grp) GROUP BY t.a, t.b, w.grp, w.day, n, before""")
def c22_walk(spark, d):
    """Every group of a pair of teams (the two suppliers with the most steps in it), its steps predicted from all strictly
    earlier groups: a vote is a step with more chance than the wins so far, and the majority is held against the outcome.

    There is a model for each day, all at once: a linear one needs sums of products alone, and
    those up to a day are running sums over days."""
    s, f = steps(spark, d), facts(spark, d).select(F.col("fact").alias("grp"), "day")
    counts = s.groupBy("grp", "supp").agg(F.count(F.lit(1)).alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "supp"))), 1, 2)["supp"]
    teams = counts.groupBy("grp").agg(first.alias("two")).where("size(two) = 2").select("grp", F.array_min("two").alias("a"), F.array_max("two").alias("b"))
    x = s.drop("day").join(f, "grp").select("grp", "day", "qty", "disc", F.col("win").cast("long").alias("y"))
    sums = {"n": F.lit(1), "q": F.col("qty"), "d": F.col("disc"), "y": F.col("y"), "qq": F.col("qty") * F.col("qty"), "qd": F.col("qty") * F.col("disc"), "dd": F.col("disc") * F.col("disc"), "qy": F.col("qty") * F.col("y"), "dy": F.col("disc") * F.col("y")}
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # over days
    p = x.groupBy("day").agg(*[F.sum(v).alias(k) for k, v in sums.items()]).select("day", *[F.sum(k).over(before).cast("decimal(38,0)").alias(k) for k in sums]).where("n >= 100")
    double = lambda e: F.expr(f"cast({e} as double)")
    whole = lambda a, b, c, e: F.expr(f"cast(cast({a} as decimal(18,0)) * cast({b} as decimal(18,0)) - cast({c} as decimal(18,0)) * cast({e} as decimal(18,0)) as double)")
    c = p.select("day", *[double(k).alias(k) for k in ("n", "q", "d", "y")], whole("n", "qq", "q", "q").alias("vq"), whole("n", "dd", "d", "d").alias("vd"), whole("n", "qd", "q", "d").alias("cov"), whole("n", "qy", "q", "y").alias("gq"), whole("n", "dy", "d", "y").alias("gd"))
    c = c.withColumnRenamed("y", "before")
    vote = (F.col("vd") * F.col("gq") - F.col("cov") * F.col("gd")) * (F.col("n") * F.col("qty") - F.col("q")) + (F.col("vq") * F.col("gd") - F.col("cov") * F.col("gq")) * (F.col("n") * F.col("disc") - F.col("d")) > 0
    w = x.join(c, "day").groupBy("grp", "day", "n", "before").agg(F.count(F.lit(1)).alias("steps"), F.count_if(vote).alias("votes"), F.sum("y").alias("won"))
    return w.join(teams, "grp").select("a", "b", "grp", "day", "steps", "votes", (2 * F.col("votes") > F.col("steps")).alias("predicted"), (F.col("won") * F.col("n") > F.col("before") * F.col("steps")).alias("actual"))


@query("C23_source_audit", "WITH a AS (SELECT key, max(us) AS last_us, max_by(kind, (us, seq)) AS last_kind, count(*) AS n FROM tape GROUP BY key), x AS (SELECT key FROM tape WHERE kind = 'error' AND k = 99) SELECT key, last_kind, n, last_kind IN ('purchase', 'view') AS normal_end FROM a WHERE key NOT IN (SELECT key FROM x)")
def c23(spark, d):
    t = tape(spark, d)
    a = t.groupBy("key").agg(F.max_by("kind", F.struct("us", "seq")).alias("last_kind"), F.count(F.lit(1)).alias("n"))
    out = t.where("kind = 'error' AND k = 99").select("key").distinct()
    return a.join(out, "key", "left_anti").withColumn("normal_end", F.col("last_kind").isin("purchase", "view"))


@query("C24_spec_assembly", "WITH s AS (SELECT grp, count(*) AS maps, min(day) AS day0 FROM steps GROUP BY grp), f AS (SELECT fact, entity, day FROM facts) SELECT s.grp, CASE WHEN f.fact IS NULL THEN 'no_event' WHEN s.maps > 7 THEN 'too_many' WHEN abs(s.day0 - f.day) > 700 THEN 'moved' ELSE 'ok' END AS status FROM s LEFT JOIN f ON s.grp = f.fact")
def c24(spark, d):
    s = steps(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("maps"), F.min("day").alias("day0"))
    f = facts(spark, d).select("fact", "day")
    r = K.first_reason([(F.col("fact").isNull(), "no_event"), (F.col("maps") > 7, "too_many"), (F.abs(F.col("day0") - F.col("day")) > 700, "moved")])
    return s.join(f, s["grp"] == f["fact"], "left").select("grp", F.coalesce(r, F.lit("ok")).alias("status"))


@query("C25_history_landing", "SELECT t.key, n.n_name AS nation, count(*) AS n, min(t.cents) AS low, max(t.cents) AS high FROM tape t JOIN nation n ON t.key % 25 = n.n_nationkey WHERE t.kind IN ('view', 'click') GROUP BY ALL")
def c25(spark, d):
    t = tape(spark, d)
    both = t.where("kind = 'view'").select("key", "cents").unionByName(t.where("kind = 'click'").select("key", "cents"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return both.join(n, F.col("key") % 25 == F.col("n_nationkey")).groupBy("key", "nation").agg(F.count(F.lit(1)).alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"))


@query("C26_review_queue", "SELECT DISTINCT key, k, CASE WHEN EXISTS (SELECT 1 FROM tape p WHERE p.kind = 'purchase' AND p.key = t.key AND p.k = t.k) THEN 'verified' ELSE 'waiting' END AS status FROM tape t WHERE kind = 'click'")
def c26(spark, d):
    t = tape(spark, d)
    done = t.where("kind = 'purchase'").select("key", "k").distinct().withColumn("ok", F.lit(True))
    return t.where("kind = 'click'").select("key", "k").distinct().join(done, ["key", "k"], "left").select("key", "k", F.when(F.col("ok"), "verified").otherwise("waiting").alias("status"))


@query("C27_category_counts", "SELECT grp, count(*) FILTER (WHERE qty < 15) AS low, count(*) FILTER (WHERE qty >= 15 AND qty < 35) AS mid, count(*) FILTER (WHERE qty >= 35) AS high, count(*) AS items FROM steps GROUP BY grp")
def c27(spark, d):
    g = steps(spark, d).groupBy("grp").agg(F.collect_list("qty").alias("q"))
    n = lambda f: F.aggregate("q", F.lit(0), lambda a, x: a + F.when(f(x), 1).otherwise(0)).cast("bigint")
    return g.select("grp", n(lambda x: x < 15).alias("low"), n(lambda x: (x >= 15) & (x < 35)).alias("mid"), n(lambda x: x >= 35).alias("high"), F.size("q").cast("bigint").alias("items"))


@query("C28_mechanism_ledger", f"WITH RECURSIVE {STUDY} SELECT h, CASE WHEN key % 2 = 0 THEN 'even' ELSE 'odd' END AS mechanism, count(pnl) AS n, coalesce(sum(pnl), 0) AS net FROM study GROUP BY ALL")
def c28(spark, d):
    return study(spark, d).groupBy("h", F.when(F.col("key") % 2 == 0, "even").otherwise("odd").alias("mechanism")).agg(F.count("pnl").alias("n"), F.coalesce(F.sum("pnl"), F.lit(0)).alias("net"))


@query("C29_acceptance_ledger", "WITH s AS (SELECT key, us // 604800000000 AS round, count(*) AS n, count(*) FILTER (WHERE kind = 'purchase') AS trades, sum(CASE WHEN kind = 'purchase' THEN cents ELSE 0 END) AS net FROM tape GROUP BY ALL) SELECT round, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(net) AS BIGINT) AS net FROM s GROUP BY round")
def c29(spark, d):
    t = tape(spark, d).withColumn("round", F.floor(F.col("us") / (7 * DAY)))
    p = F.col("kind") == "purchase"
    s = t.groupBy("key", "round").agg(F.count(F.lit(1)).alias("n"), F.count_if(p).alias("trades"), F.sum(F.when(p, F.col("cents")).otherwise(0)).alias("net"))
    return s.groupBy("round").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"), F.sum("trades").alias("trades"), F.sum("net").alias("net"))


@query("C31_combination_lookup", "WITH n AS (SELECT side, flag, line, count(*) AS n, count(*) FILTER (WHERE qty > 25) AS w FROM steps GROUP BY ALL) SELECT a.side, b.flag, c.line, round((coalesce(n.w, 0) + 5) / (coalesce(n.n, 0) + 10.0), 6) AS p FROM (SELECT DISTINCT side FROM steps) a, (SELECT DISTINCT flag FROM steps) b, (SELECT DISTINCT line FROM steps) c LEFT JOIN n ON n.side = a.side AND n.flag = b.flag AND n.line = c.line")
def c31(spark, d):
    """All combinations of three small category columns."""
    s = steps(spark, d)
    n = s.groupBy("side", "flag", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("qty") > 25).alias("w"))
    every = s.agg(F.collect_set("side").alias("a"), F.collect_set("flag").alias("b"), F.collect_set("line").alias("c")).select(F.explode("a").alias("side"), "b", "c").select("side", F.explode("b").alias("flag"), "c").select("side", "flag", F.explode("c").alias("line"))
    return every.join(n, ["side", "flag", "line"], "left").select("side", "flag", "line", F.round((F.coalesce("w", F.lit(0)) + 5) / (F.coalesce("n", F.lit(0)) + 10), 6).alias("p"))


@query("C33_sparse_counts", "SELECT grp, part % 8 AS cell, count(*) AS n FROM steps GROUP BY ALL")
def c33(spark, d):
    cells = F.transform(F.collect_list(F.col("part") % 8), lambda x: x)
    g = steps(spark, d).groupBy("grp").agg(cells.alias("c"))
    m = g.select("grp", F.explode(F.array_distinct("c")).alias("cell"), "c")
    return m.select("grp", "cell", F.size(F.filter("c", lambda x: x == F.col("cell"))).cast("bigint").alias("n"))


@query("C34_regime_metrics", f"WITH {SCORED} SELECT quality, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM scored GROUP BY quality")
def c34(spark, d):
    m = scored(spark, d).groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *A.metrics("p", "y"))
    return m.select("quality", "n", F.round("brier", 6).alias("brier"), F.round("accuracy", 6).alias("accuracy"))


@query("C35_dated_groups", "SELECT s.grp, f.day, f.entity, count(*) AS n, sum(CASE WHEN s.win THEN 1 ELSE 0 END) AS wins FROM steps s JOIN facts f ON s.grp = f.fact GROUP BY ALL")
def c35(spark, d):
    s = steps(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("win").cast("bigint")).alias("wins"))
    return s.join(facts(spark, d).select(F.col("fact").alias("grp"), "day", "entity"), "grp")


@query("C36_live_snapshot", "SELECT key, max_by(cents, (us, seq)) FILTER (WHERE kind = 'view') AS odds, max_by(k, (us, seq)) FILTER (WHERE kind = 'click') AS score, max(us) AS at FROM tape GROUP BY key")
def c36(spark, d):
    last = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.struct("us", "seq")))
    return tape(spark, d).groupBy("key").agg(last("view", "cents").alias("odds"), last("click", "k").alias("score"), F.max("us").alias("at"))


@query("C37_ranked_alignment", "WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n, s_acctbal AS b FROM supplier), c AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS seg FROM customer) SELECT s.id, min_by(c.id, (CASE c.seg WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c.id)) AS market, count(*) AS options FROM s JOIN c ON s.n = c.n GROUP BY s.id")
def c37(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"))
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    best = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.min_by("c_custkey", F.struct(rank, F.col("c_custkey"))).alias("market"), F.count(F.lit(1)).alias("options"))
    return s.join(best, "n").select("id", "market", "options")


@query("C38_cohort_report", "SELECT n.n_regionkey AS region, year(o.o_orderdate) AS y, count(*) AS n, round(avg(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL")
def c38(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    m = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return m.groupBy(F.col("n_regionkey").alias("region"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))


@query("C39_current_side", "SELECT grp, step, CASE WHEN line <= 3 THEN side WHEN line <= 6 THEN CASE side WHEN 'O' THEN 'F' ELSE 'O' END END AS now_side FROM steps")
def c39(spark, d):
    other = F.when(F.col("side") == "O", "F").otherwise("O")
    return steps(spark, d).select("grp", "step", F.when(F.col("line") <= 3, F.col("side")).when(F.col("line") <= 6, other).alias("now_side"))


@query("C40_cluster_keys", "SELECT coalesce(CAST(nullif(entity % 7, 0) AS VARCHAR), status || ':' || class) AS cluster, count(*) AS n FROM facts GROUP BY 1")
def c40(spark, d):
    key = F.coalesce(F.nullif(F.col("entity") % 7, F.lit(0)).cast("string"), F.concat_ws(":", "status", "class"))
    return facts(spark, d).groupBy(key.alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("C41_selected_members", "WITH t AS (SELECT entity FROM facts GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 10) SELECT fact, entity FROM facts WHERE entity IN (SELECT entity FROM t)")
def c41(spark, d):
    f = facts(spark, d)
    top = f.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(10)
    return f.join(top, "entity", "left_semi").select("fact", "entity")
