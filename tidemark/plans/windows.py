"""Queries W01 to W34 (W11 is with the joins) and L01 to L06, X01 to X04."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import windows as W
from ..operators.asof import asof
from ..sources.tables import STEP_KEYS, facts, step_order, steps, table, tape
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _grp():
    return Window.partitionBy("grp").orderBy("step")


def _key():
    return Window.partitionBy("key").orderBy("us", "seq")


@query("W01_lag_lead_diff", "SELECT seq, lag(cents) OVER w AS prev, lead(cents) OVER w AS next, cents - lag(cents) OVER w AS diff, us - lag(us) OVER w AS gap FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq)")
def w01(spark, d):
    return tape(spark, d).select("seq", F.lag("cents").over(_key()).alias("prev"), F.lead("cents").over(_key()).alias("next"), (F.col("cents") - F.lag("cents").over(_key())).alias("diff"), (F.col("us") - F.lag("us").over(_key())).alias("gap"))


@query("W02_running_score", """
WITH g AS (SELECT *, max(CASE WHEN line > step + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY step ROWS UNBOUNDED PRECEDING) AS gap FROM steps)
SELECT grp, step, CASE WHEN gap = 0 THEN coalesce(sum(CASE WHEN win THEN 1 ELSE 0 END) OVER w, 0) END AS won, CASE WHEN gap = 0 THEN coalesce(sum(CASE WHEN win THEN 0 ELSE 1 END) OVER w, 0) END AS lost FROM g WINDOW w AS (PARTITION BY grp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w02(spark, d):
    """Score before a step; unknown from the first gap in the numbers on."""
    b = W.before(["grp"], ["step"])
    gap = F.max((F.col("line") > F.col("step") + 1).cast("int")).over(W.upto(["grp"], ["step"]))
    s = steps(spark, d).withColumn("gap", gap)
    run = lambda c: F.when(F.col("gap") == 0, F.coalesce(F.sum(c.cast("long")).over(b), F.lit(0)))
    return s.select("grp", "step", run(F.col("win")).alias("won"), run(~F.col("win")).alias("lost"))


@query("W03_signed_streak", """
WITH i AS (SELECT *, step - row_number() OVER (PARTITION BY grp, win ORDER BY step) AS isl FROM steps), r AS (SELECT *, row_number() OVER (PARTITION BY grp, win, isl ORDER BY step) * CASE WHEN win THEN 1 ELSE -1 END AS streak FROM i)
SELECT grp, step, coalesce(lag(streak) OVER (PARTITION BY grp ORDER BY step), 0) AS entering FROM r""")
def w03(spark, d):
    """All windows are over the order of the steps itself, so rows are sorted once."""
    o, win = step_order(), F.col("l_returnflag") == "R"
    s = table(spark, d, "lineitem").select(*STEP_KEYS, win.alias("win"))
    s = s.withColumns({"step": F.row_number().over(o).cast("bigint"), "breaks": F.coalesce(F.col("win") != F.lag("win").over(o), F.lit(True))})
    first = F.last(F.when(F.col("breaks"), F.col("step")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("streak", (F.col("step") - first + 1) * F.when(F.col("win"), 1).otherwise(-1))
    return s.select(F.col("l_orderkey").alias("grp"), "step", F.coalesce(F.lag("streak").over(o), F.lit(0)).alias("entering"))


@query("W04_forward_majority", """
WITH f AS (SELECT grp, step, sum(CASE WHEN win THEN 1 ELSE 0 END) OVER w AS wins, count(*) OVER w AS n FROM steps WINDOW w AS (PARTITION BY grp ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT grp, step, wins >= 2 AS label FROM f WHERE n = 3""")
def w04(spark, d):
    w = _grp().rowsBetween(0, 2)
    return steps(spark, d).select("grp", "step", (F.sum(F.col("win").cast("int")).over(w) >= 2).alias("label"), F.count(F.lit(1)).over(w).alias("n")).where("n = 3").drop("n")


@query("W05_trailing_sum", "SELECT a.seq, CAST((SELECT sum(b.cents) FROM tape b WHERE b.key = a.key AND b.us > a.us - 86400000000 AND (b.us, b.seq) <= (a.us, a.seq)) AS BIGINT) AS total FROM tape a")
def w05(spark, d):
    return W.trailing_sum(tape(spark, d).select("key", "us", "seq", "cents"), ["key"], "us", "seq", "cents", DAY, "total").select("seq", "total")


@query("W06_realised_volatility", """
WITH m AS (SELECT key, us, seq, cents, CAST(pow(cents - lag(cents) OVER (PARTITION BY key ORDER BY us, seq), 2) AS BIGINT) AS sq FROM tape)
SELECT a.seq, round(sqrt(CAST((SELECT coalesce(sum(b.sq), 0) FROM m b WHERE b.key = a.key AND b.us > a.us - 86400000000 AND (b.us, b.seq) <= (a.us, a.seq)) AS DOUBLE)), 4) AS vol FROM m a""")
def w06(spark, d):
    t = tape(spark, d).select("key", "us", "seq", "cents")
    move = F.col("cents") - F.lag("cents").over(_key())
    return W.trailing_sum(t.withColumn("sq", move * move), ["key"], "us", "seq", "sq", DAY, "total").select("seq", F.round(F.sqrt("total"), 4).alias("vol"))


@query("W07_lagged_returns", """
WITH v AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view'), s AS (SELECT key, us - 86400000000 AS at, seq, cents FROM v), a AS (SELECT s.*, f.cents AS old, s.at - f.us AS age FROM s ASOF LEFT JOIN v f ON s.key = f.key AND s.at >= f.us)
SELECT seq, cents - old AS change, CASE WHEN age <= 172800000000 THEN round((cents - old) / 24.0, 4) END AS velocity FROM a""")
def w07(spark, d):
    v = tape(spark, d).where("kind = 'view'").select("key", "us", "seq", "cents")
    old = asof(v.withColumn("us", F.col("us") - DAY), v, ["key"], "us", ["cents"])
    change = F.col("cents") - F.col("f_cents")
    return old.select("seq", change.alias("change"), F.when(F.col("us") - F.col("f_us") <= 2 * DAY, F.round(change / 24.0, 4)).alias("velocity"))


@query("W08_forward_fill", """
SELECT seq, last_value(CASE WHEN kind = 'view' THEN cents END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN kind = 'click' THEN cents END IGNORE NULLS) OVER w AS ask, us - last_value(CASE WHEN kind = 'view' THEN us END IGNORE NULLS) OVER w AS age FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""")
def w08(spark, d):
    w = W.upto(["key"], ["us", "seq"])
    last = lambda kind, c: F.last(F.when(F.col("kind") == kind, F.col(c)), True).over(w)
    return tape(spark, d).select("seq", last("view", "cents").alias("bid"), last("click", "cents").alias("ask"), (F.col("us") - last("view", "us")).alias("age"))


@query("W09_episodes", """
WITH f AS (SELECT *, cents >= 5000 AS hot, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS rn FROM tape), i AS (SELECT *, rn - row_number() OVER (PARTITION BY key, hot ORDER BY us, seq) AS isl FROM f)
SELECT key, min(seq) AS first_seq, count(*) AS n, max(us) - min(us) AS span, max(cents) AS peak FROM i WHERE hot GROUP BY key, isl""")
def w09(spark, d):
    t = tape(spark, d).withColumn("hot", F.col("cents") >= 5000)
    runs = W.islands(t, ["key"], ["us", "seq"], F.col("hot") != F.lag("hot").over(_key())).where("hot")
    return runs.groupBy("key", "island").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("span"), F.max("cents").alias("peak")).drop("island")


@query("W10_chains", """
WITH l AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 14400000000 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS brk FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq)), c AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS chain FROM l)
SELECT key, kind, min(seq) AS first_seq, count(*) AS n, sum(cents) AS cents FROM c GROUP BY key, chain, kind HAVING count(*) >= 2""")
def w10(spark, d):
    same = (F.col("us") - F.lag("us").over(_key()) <= 4 * HOUR) & (F.lag("kind").over(_key()) == F.col("kind"))
    c = W.islands(tape(spark, d), ["key"], ["us", "seq"], ~same, "chain")
    return c.groupBy("key", "chain", "kind").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).where("n >= 2").drop("chain")


@query("W12_last_n_within_days", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day, fact) AS rn FROM facts)
SELECT a.fact, count(b.fact) AS n, count(b.fact) FILTER (WHERE b.won) AS wins, (SELECT round(avg(c.cents), 4) FROM r c WHERE c.entity = a.entity AND c.rn BETWEEN a.rn - 3 AND a.rn - 1) AS roll3
FROM r a LEFT JOIN r b ON b.entity = a.entity AND b.rn BETWEEN a.rn - 5 AND a.rn - 1 AND b.day >= a.day - 365 GROUP BY a.fact, a.entity, a.rn""")
def w12(spark, d):
    order = Window.partitionBy("entity").orderBy("day", "fact")
    last = F.collect_list(F.struct("day", "won")).over(order.rowsBetween(-5, -1))
    near = F.filter("last", lambda x: x["day"] >= F.col("day") - 365)
    f = facts(spark, d).withColumn("last", last).withColumn("roll3", F.round(F.avg("cents").over(order.rowsBetween(-3, -1)), 4))
    return f.select("fact", F.size(near).cast("long").alias("n"), F.size(F.filter(near, lambda x: x["won"])).cast("long").alias("wins"), "roll3")


@query("W13_past_mean_no_ties", """
SELECT a.fact, (SELECT round(avg(b.cents), 4) FROM facts b WHERE b.entity = a.entity AND b.day < a.day) AS mean, (SELECT count(*) FROM facts b WHERE b.entity = a.entity AND b.day < a.day) AS n FROM facts a""")
def w13(spark, d):
    w = W.earlier(["entity"], "day")
    return facts(spark, d).select("fact", F.round(F.avg("cents").over(w), 4).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))


@query("W14_first_event", """
SELECT grp, min_by(part, step) AS first_part, min_by(side, step) AS first_side, count(*) FILTER (WHERE day = m) AS at_once FROM (SELECT *, min(day) OVER (PARTITION BY grp) AS m FROM steps) GROUP BY grp""")
def w14(spark, d):
    s = steps(spark, d).withColumn("m", F.min("day").over(Window.partitionBy("grp")))
    return s.groupBy("grp").agg(F.min_by("part", "step").alias("first_part"), F.min_by("side", "step").alias("first_side"), F.count_if(F.col("day") == F.col("m")).alias("at_once"))


@query("W15_first_last_value", "SELECT key, min_by(cents, (us, seq)) AS first_cents, max_by(cents, (us, seq)) AS last_cents, count(*) AS n FROM tape GROUP BY key")
def w15(spark, d):
    return tape(spark, d).groupBy("key").agg(F.min_by("cents", F.struct("us", "seq")).alias("first_cents"), F.max_by("cents", F.struct("us", "seq")).alias("last_cents"), F.count(F.lit(1)).alias("n"))


@query("W16_resolution_instant", """
WITH u AS (SELECT key, max(us) FILTER (WHERE cents < 8000) AS last_open FROM tape GROUP BY key) SELECT t.key, min(t.us) AS resolved FROM tape t JOIN u ON t.key = u.key WHERE u.last_open IS NULL OR t.us > u.last_open GROUP BY t.key""")
def w16(spark, d):
    last = F.max(F.when(F.col("cents") < 8000, F.col("us"))).over(Window.partitionBy("key"))
    t = tape(spark, d).select("key", "us", last.alias("last_open"))
    return t.where("last_open IS NULL OR us > last_open").groupBy("key").agg(F.min("us").alias("resolved"))


@query("W17_jumps", """
WITH v AS (SELECT key, us, seq, cents FROM tape WHERE kind = 'view'), c AS (SELECT key, us, cents FROM tape WHERE kind = 'click'), j AS (SELECT * FROM (SELECT *, cents - lag(cents) OVER (PARTITION BY key ORDER BY us, seq) AS move FROM v) WHERE abs(move) >= 5000),
a AS (SELECT j.*, c.cents AS old FROM j ASOF LEFT JOIN c ON j.key = c.key AND j.us >= c.us), b AS (SELECT a.*, c.cents AS new FROM a ASOF LEFT JOIN c ON a.key = c.key AND a.us <= c.us)
SELECT seq, move, new - old AS other_move, coalesce(sign(move) * sign(new - old) < 0, false) AS mirrored FROM b""")
def w17(spark, d):
    t = tape(spark, d).select("key", "us", "seq", "cents", "kind")
    v, c = t.where("kind = 'view'").drop("kind"), t.where("kind = 'click'").drop("kind")
    j = v.withColumn("move", F.col("cents") - F.lag("cents").over(_key())).where(F.abs("move") >= 5000)
    b = asof(asof(j, c, ["key"], "us", ["cents"], prefix="b_"), c, ["key"], "us", ["cents"], direction="forward", prefix="a_")
    other = F.col("a_cents") - F.col("b_cents")
    return b.select("seq", "move", other.alias("other_move"), F.coalesce(F.signum("move") * F.signum(other) < 0, F.lit(False)).alias("mirrored"))


@query("W18_plateau", """
WITH p AS (SELECT key, us, seq FROM tape WHERE kind = 'purchase')
SELECT p.seq, count(*) AS n, round(quantile_cont(f.cents, 0.5), 4) AS level FROM p JOIN tape f ON f.key = p.key AND f.us BETWEEN p.us AND p.us + 86400000000 AND f.kind IN ('view', 'click') GROUP BY p.seq HAVING count(*) >= 3""")
def w18(spark, d):
    t = tape(spark, d).select("key", "us", "seq", "cents", "kind")
    pairs = J.interval_pairs(t.where("kind = 'purchase'").select("key", "us", "seq"), t.where("kind IN ('view', 'click')"), ["key"], "us", 0, DAY)
    return pairs.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("r_cents", 0.5), 4).alias("level")).where("n >= 3")


@query("W19_timeline", """
SELECT grp, step, sum(coalesce(nullif(disc, 0), 115)) OVER (PARTITION BY grp ORDER BY step ROWS UNBOUNDED PRECEDING) AS from_start, sum(coalesce(nullif(disc, 0), 115)) OVER (PARTITION BY grp ORDER BY step DESC ROWS UNBOUNDED PRECEDING) AS to_end FROM steps""")
def w19(spark, d):
    length = F.coalesce(F.nullif("disc", F.lit(0)), F.lit(115))
    back = Window.partitionBy("grp").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return steps(spark, d).select("grp", "step", F.sum(length).over(W.upto(["grp"], ["step"])).alias("from_start"), F.sum(length).over(back).alias("to_end"))


@query("W20_lock_in", """
WITH c AS (SELECT grp, step, (qty >= 25) = win AS ok FROM steps), m AS (SELECT *, max(step) FILTER (WHERE NOT ok) OVER (PARTITION BY grp) AS last_bad FROM c) SELECT grp, min(step) AS locked FROM m WHERE last_bad IS NULL OR step > last_bad GROUP BY grp""")
def w20(spark, d):
    s = steps(spark, d).withColumn("ok", (F.col("qty") >= 25) == F.col("win"))
    return s.groupBy("grp").agg(F.max(F.when(~F.col("ok"), F.col("step"))).alias("bad"), F.max("step").alias("n")).where("bad IS NULL OR bad < n").select("grp", (F.coalesce("bad", F.lit(0)) + 1).alias("locked"))


@query("W21_monotone_quarantine", """
WITH RECURSIVE o AS (SELECT grp, step, day, line, row_number() OVER (PARTITION BY grp ORDER BY step, line) AS n FROM steps),
r AS (SELECT grp, step, n, day AS bar_day, line AS bar_line, true AS accepted FROM o WHERE n = 1
UNION ALL SELECT o.grp, o.step, o.n, CASE WHEN o.day >= r.bar_day AND o.line >= r.bar_line THEN o.day ELSE r.bar_day END, CASE WHEN o.day >= r.bar_day AND o.line >= r.bar_line THEN o.line ELSE r.bar_line END, o.day >= r.bar_day AND o.line >= r.bar_line FROM r JOIN o ON o.grp = r.grp AND o.n = r.n + 1)
SELECT grp, step, accepted FROM r""")
def w21(spark, d):
    """Steps whose day and line both don't fall below the last accepted step's."""
    return W.monotone(steps(spark, d).select("grp", "step", "day", "line"), ["grp"], "step", "line", ["day", "line"]).select("grp", "step", "accepted")


@query("W22_coalesce_unchanged", """
WITH l AS (SELECT *, lag(kind) OVER w IS NOT DISTINCT FROM kind AND row_number() OVER w > 1 AS same FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq)), i AS (SELECT *, count(*) FILTER (WHERE NOT same) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS isl FROM l)
SELECT key, kind, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM i GROUP BY key, isl, kind""")
def w22(spark, d):
    new = ~F.lag("kind").over(_key()).eqNullSafe(F.col("kind"))
    i = W.islands(tape(spark, d), ["key"], ["us", "seq"], new)
    return i.groupBy("key", "island", "kind").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("island")


@query("W23_head_to_head_rest", """
WITH p AS (SELECT fact, day, won, entity, least(entity % 40, (entity * 7) % 40) AS a, greatest(entity % 40, (entity * 7) % 40) AS b FROM facts)
SELECT x.fact, (SELECT count(*) FROM p y WHERE y.a = x.a AND y.b = x.b AND y.day < x.day AND y.day >= x.day - 730) AS met, (SELECT count(*) FROM p y WHERE y.a = x.a AND y.b = x.b AND y.day < x.day AND y.day >= x.day - 730 AND y.won) AS won,
coalesce(least(60, x.day - (SELECT max(y.day) FROM p y WHERE y.entity = x.entity AND y.day < x.day)), 30) AS rest FROM p x""")
def w23(spark, d):
    e = F.col("entity")
    f = facts(spark, d).withColumn("a", F.least(e % 40, e * 7 % 40)).withColumn("b", F.greatest(e % 40, e * 7 % 40))
    w = Window.partitionBy("a", "b").orderBy("day").rangeBetween(-730, -1)
    rest = F.coalesce(F.least(F.lit(60), F.col("day") - F.max("day").over(W.earlier(["entity"], "day"))), F.lit(30))
    return f.select("fact", F.count(F.lit(1)).over(w).alias("met"), F.count(F.when(F.col("won"), 1)).over(w).alias("won"), rest.alias("rest"))


@query("W24_bucket_by_boundary", """
SELECT t.seq, (SELECT count(*) FROM tape b WHERE b.key = t.key AND b.kind = 'signup' AND b.us <= t.us) AS bucket FROM tape t WHERE t.kind <> 'signup'""")
def w24(spark, d):
    """Number of boundaries at or before an event; 0 before the first."""
    w = Window.partitionBy("key").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    return tape(spark, d).select("seq", "kind", F.count(F.when(F.col("kind") == "signup", 1)).over(w).alias("bucket")).where("kind <> 'signup'").drop("kind")


@query("W25_bracket_exit", """
WITH e AS (SELECT key, min_by(cents, (us, seq)) AS entry, min((us, seq)) AS at FROM tape GROUP BY key), x AS (SELECT t.key, e.entry, t.us, t.seq, t.cents, t.cents >= e.entry + 3000 AS tp, t.cents <= e.entry - 3000 AS sl FROM tape t JOIN e ON t.key = e.key WHERE (t.us, t.seq) > e.at)
SELECT key, coalesce(min_by(CASE WHEN tp THEN 'TP' ELSE 'SL' END, (us, seq)) FILTER (WHERE tp OR sl), 'END') AS outcome, coalesce(min_by(cents, (us, seq)) FILTER (WHERE tp OR sl), max_by(cents, (us, seq))) - min(entry) AS pnl FROM x GROUP BY key""")
def w25(spark, d):
    t = tape(spark, d).withColumn("entry", F.first("cents").over(_key())).withColumn("rn", F.row_number().over(_key())).where("rn > 1")
    hit = F.when(F.col("cents") >= F.col("entry") + 3000, "TP").when(F.col("cents") <= F.col("entry") - 3000, "SL")
    at = F.struct("us", "seq")
    t = t.withColumn("hit", hit).withColumn("at", at)
    first = lambda c: F.min_by(c, F.when(F.col("hit").isNotNull(), F.col("at")))
    touched = F.count("hit") > 0
    g = t.groupBy("key").agg(F.when(touched, first("hit")).otherwise("END").alias("outcome"), F.when(touched, first("cents")).otherwise(F.max_by("cents", "at")).alias("leave"), F.min("entry").alias("entry"))
    return g.select("key", "outcome", (F.col("leave") - F.col("entry")).alias("pnl"))


@query("W26_capped_selection", """
WITH r AS (SELECT key, us, seq, cents, k, CASE WHEN cents < 1000 THEN 'small' WHEN k < 10 THEN 'low_k' WHEN kind = 'error' THEN 'bad_kind' END AS reason FROM tape), a AS (SELECT *, row_number() OVER (PARTITION BY key, us // 86400000000, reason IS NULL ORDER BY us, seq) AS rb FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY key, us // 604800000000, reason IS NULL AND rb = 1 ORDER BY us, seq) AS rs FROM a), c AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN rb > 1 THEN 'not_first' WHEN rs > 3 THEN 'over_cap' ELSE 'taken' END AS outcome FROM b)
SELECT seq, outcome, sum(CASE WHEN outcome = 'taken' THEN cents ELSE 0 END) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS cash FROM c""")
def w26(spark, d):
    """First eligible tick of a key and day, three a key and week, with the running total."""
    reason = F.when(F.col("cents") < 1000, "small").when(F.col("k") < 10, "low_k").when(F.col("kind") == "error", "bad_kind")
    t = tape(spark, d).withColumn("reason", reason).withColumn("day", F.floor(F.col("us") / DAY)).withColumn("week", F.floor(F.col("us") / (7 * DAY)))
    t = t.withColumn("rb", F.row_number().over(Window.partitionBy("key", "day", F.col("reason").isNull()).orderBy("us", "seq")))
    t = t.withColumn("rs", F.row_number().over(Window.partitionBy("key", "week", F.col("reason").isNull() & (F.col("rb") == 1)).orderBy("us", "seq")))
    outcome = F.coalesce(F.col("reason"), F.when(F.col("rb") > 1, "not_first").when(F.col("rs") > 3, "over_cap").otherwise("taken"))
    t = t.withColumn("outcome", outcome)
    return t.select("seq", "outcome", F.sum(F.when(F.col("outcome") == "taken", F.col("cents")).otherwise(0)).over(W.upto(["key"], ["us", "seq"])).alias("cash"))


@query("W27_z_score", """
WITH s AS (SELECT supp, avg(qty) AS q, avg(disc) AS x FROM steps GROUP BY supp) SELECT supp, round((q - avg(q) OVER ()) / stddev_samp(q) OVER () + 0.5 * (x - avg(x) OVER ()) / stddev_samp(x) OVER (), 4) AS score FROM s""")
def w27(spark, d):
    """The mean and deviation are one row, joined back; a window without keys would be one task."""
    s = steps(spark, d).groupBy("supp").agg(F.avg("qty").alias("q"), F.avg("disc").alias("x"))
    m = s.agg(F.avg("q").alias("mq"), F.stddev_samp("q").alias("sq"), F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx"))
    return s.join(F.broadcast(m)).select("supp", F.round((F.col("q") - F.col("mq")) / F.col("sq") + 0.5 * (F.col("x") - F.col("mx")) / F.col("sx"), 4).alias("score"))


@query("W28_prefix_context", """
SELECT grp, count(*) FILTER (WHERE win) AS wins, max(qty) AS top, count(*) FILTER (WHERE win AND step > 3) AS late_wins, count(*) FILTER (WHERE qty >= 45) AS stomps FROM steps WHERE step <= 6 GROUP BY grp""")
def w28(spark, d):
    return steps(spark, d).where("step <= 6").groupBy("grp").agg(F.count_if("win").alias("wins"), F.max("qty").alias("top"), F.count_if(F.col("win") & (F.col("step") > 3)).alias("late_wins"), F.count_if(F.col("qty") >= 45).alias("stomps"))


@query("W29_checkpoints", """
SELECT grp, k, count(*) FILTER (WHERE win AND step <= k) AS wins, sum(qty) FILTER (WHERE step <= k) AS qty FROM steps, (VALUES (2), (4), (6)) v(k) GROUP BY grp, k""")
def w29(spark, d):
    s = steps(spark, d)
    each = s.groupBy("grp").agg(*[x for k in (2, 4, 6) for x in (F.count_if(F.col("win") & (F.col("step") <= k)).alias(f"w{k}"), F.sum(F.when(F.col("step") <= k, F.col("qty"))).alias(f"q{k}"))])
    return each.select("grp", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("wins"), F.col(f"q{k}").alias("qty")) for k in (2, 4, 6)])))


@query("W30_own_past_mean", "SELECT grp, step, round(avg(qty) OVER (PARTITION BY grp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS past, qty FROM steps")
def w30(spark, d):
    return steps(spark, d).select("grp", "step", F.round(F.avg("qty").over(W.before(["grp"], ["step"])), 4).alias("past"), "qty")


@query("W32_score_continuity", """
WITH s AS (SELECT key, us, seq, k // 10 AS a, lag(k // 10) OVER (PARTITION BY key ORDER BY us, seq) AS pa, cents // 1000 AS b, lag(cents // 1000) OVER (PARTITION BY key ORDER BY us, seq) AS pb FROM tape)
SELECT CASE WHEN pa IS NULL THEN 'first' WHEN a < pa OR b < pb THEN 'backwards' WHEN (a - pa) + (b - pb) = 1 THEN 'one' WHEN a = pa AND b = pb THEN 'same' ELSE 'jump' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def w32(spark, d):
    t = tape(spark, d).select("key", "us", "seq", F.floor(F.col("k") / 10).alias("a"), F.floor(F.col("cents") / 1000).alias("b"))
    t = t.withColumns({"da": F.col("a") - F.lag("a").over(_key()), "db": F.col("b") - F.lag("b").over(_key())})
    reason = F.when(F.col("da").isNull(), "first").when((F.col("da") < 0) | (F.col("db") < 0), "backwards").when(F.col("da") + F.col("db") == 1, "one").when((F.col("da") == 0) & (F.col("db") == 0), "same").otherwise("jump")
    return t.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("W33_transition_inference", """
WITH RECURSIVE o AS (SELECT key, seq, k // 20 AS a, cents // 4000 AS b, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS n FROM tape WHERE k IS NOT NULL AND cents IS NOT NULL),
r AS (SELECT key, seq, n, a AS la, b AS lb, CAST(NULL AS VARCHAR) AS winner FROM o WHERE n = 1
UNION ALL SELECT key, seq, n, CASE WHEN ok THEN a ELSE la END, CASE WHEN ok THEN b ELSE lb END, CASE WHEN ok THEN CASE WHEN a > la THEN 'a' ELSE 'b' END END
FROM (SELECT o.key, o.seq, o.n, o.a, o.b, r.la, r.lb, o.a >= r.la AND o.b >= r.lb AND o.a + o.b - r.la - r.lb = 1 AS ok FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1) x)
SELECT seq, winner FROM r WHERE winner IS NOT NULL""")
def w33(spark, d):
    """Winners inferred from score changes between accepted rows: the next accepted row is
    the one whose scores don't fall and rise by one in all; others are skipped, as are rows with a null score."""

    def infer(last, a, b):
        if a is None or b is None:
            return last, (None,)
        if last is None:
            return (a, b), (None,)
        if a >= last[0] and b >= last[1] and a + b - last[0] - last[1] == 1:
            return (a, b), ("a" if a > last[0] else "b",)
        return last, (None,)

    t = tape(spark, d).select("key", "us", "seq", F.floor(F.col("k") / 20).alias("a"), F.floor(F.col("cents") / 4000).alias("b"))
    return W.ordered_pass(t, ["key"], ["us", "seq"], ["a", "b"], {"winner": "string"}, infer).where("winner IS NOT NULL").select("seq", "winner")


@query("W34_violations", """
WITH m AS (SELECT key, us, seq, last_value(CASE WHEN kind = 'view' THEN cents END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN kind = 'click' THEN cents END IGNORE NULLS) OVER w AS ask, k FROM tape WINDOW w AS (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, coalesce(bid > ask, false) AS bad, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS rn FROM m), i AS (SELECT *, rn - row_number() OVER (PARTITION BY key, bad ORDER BY us, seq) AS isl FROM f)
SELECT key, min(seq) AS first_seq, max(bid - ask) AS profit, min(k) AS size, count(*) AS n FROM i WHERE bad GROUP BY key, isl HAVING max(bid - ask) >= 2000 AND count(*) >= 2""")
def w34(spark, d):
    w = W.upto(["key"], ["us", "seq"])
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("cents")), True).over(w)
    m = tape(spark, d).withColumns({"bid": last("view"), "ask": last("click")}).withColumn("bad", F.coalesce(F.col("bid") > F.col("ask"), F.lit(False)))
    i = W.islands(m, ["key"], ["us", "seq"], F.col("bad") != F.lag("bad").over(_key())).where("bad")
    return i.groupBy("key", "island").agg(F.min("seq").alias("first_seq"), F.max(F.col("bid") - F.col("ask")).alias("profit"), F.min("k").alias("size"), F.count(F.lit(1)).alias("n")).where("profit >= 2000 AND n >= 2").drop("island")


@query("L01_top_k", "SELECT seq, cents FROM tape ORDER BY cents DESC, seq LIMIT 15")
def l01(spark, d):
    return tape(spark, d).select("seq", "cents").orderBy(F.desc("cents"), "seq").limit(15)


@query("L02_group_top_k", "SELECT supp, part, n FROM (SELECT supp, part, count(*) AS n, row_number() OVER (PARTITION BY supp ORDER BY count(*) DESC, part) AS rn FROM steps GROUP BY supp, part) WHERE rn <= 5")
def l02(spark, d):
    n = steps(spark, d).groupBy("supp", "part").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("supp").orderBy(F.desc("n"), "part"))).where("rn <= 5").drop("rn")


@query("L03_argmax_tiebreak", "SELECT arg_max(part, (w, q, -part)) AS part, max(n) FILTER (WHERE n >= 3) AS most FROM (SELECT part, count(*) AS n, count(*) FILTER (WHERE win) AS w, max(qty) AS q FROM steps GROUP BY part) WHERE n >= 3")
def l03(spark, d):
    p = steps(spark, d).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("w"), F.max("qty").alias("q")).where("n >= 3")
    return p.agg(F.max_by("part", F.struct("w", "q", -F.col("part"))).alias("part"), F.max("n").alias("most"))


@query("L04_stable_sort", "SELECT seq, row_number() OVER (PARTITION BY key ORDER BY kind, us, seq) AS place FROM tape")
def l04(spark, d):
    return tape(spark, d).select("seq", F.row_number().over(Window.partitionBy("key").orderBy("kind", "us", "seq")).cast("long").alias("place"))


@query("L05_first_levels", "SELECT grp, array_to_string(list_slice(list(cents ORDER BY cents DESC, step), 1, 3), ',') AS best FROM steps WHERE qty > 5 GROUP BY grp")
def l05(spark, d):
    s = steps(spark, d).where("qty > 5").groupBy("grp").agg(F.reverse(F.array_sort(F.collect_list("cents"))).alias("all"))
    return s.select("grp", F.array_join(F.slice("all", 1, 3).cast("array<string>"), ",").alias("best"))


@query("L06_max_edge", "SELECT grp, step, CASE WHEN qty * 2 - 50 >= 50 - disc * 10 THEN 'a' ELSE 'b' END AS choice, greatest(qty * 2 - 50, 50 - disc * 10) AS edge FROM steps")
def l06(spark, d):
    a, b = F.col("qty") * 2 - 50, 50 - F.col("disc") * 10
    best = F.array_max(F.array(F.struct(a.alias("edge"), F.lit(1).alias("first"), F.lit("a").alias("choice")), F.struct(b.alias("edge"), F.lit(0).alias("first"), F.lit("b").alias("choice"))))
    return steps(spark, d).select("grp", "step", best.alias("x")).select("grp", "step", "x.choice", "x.edge")


@query("X01_union_all", "SELECT 'a' AS part_of, grp, step FROM steps WHERE win UNION ALL SELECT 'b', grp, step FROM steps WHERE qty > 30")
def x01(spark, d):
    s = steps(spark, d)
    return s.where("win").select(F.lit("a").alias("part_of"), "grp", "step").unionByName(s.where("qty > 30").select(F.lit("b").alias("part_of"), "grp", "step"))


@query("X02_distinct", "SELECT DISTINCT supp, side FROM steps")
def x02(spark, d):
    return steps(spark, d).select("supp", "side").dropDuplicates()


@query("X03_key_sets", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_right")
def x03(spark, d):
    a, b = facts(spark, d).select("fact"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"))
    return a.subtract(b).agg(F.count(F.lit(1)).alias("only_left")).join(b.subtract(a).agg(F.count(F.lit(1)).alias("only_right")))


@query("X04_common_cohort", "WITH m AS (SELECT fact, CASE WHEN cents % 3 > 0 THEN cents % 100 END AS a, CASE WHEN cents % 5 > 0 THEN cents % 70 END AS b, won FROM facts) SELECT count(*) AS n, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND won IS NOT NULL")
def x04(spark, d):
    c = F.col("cents")
    m = facts(spark, d).select("won", F.when(c % 3 > 0, c % 100).alias("a"), F.when(c % 5 > 0, c % 70).alias("b")).dropna()
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 4).alias("a"), F.round(F.avg("b"), 4).alias("b"))
