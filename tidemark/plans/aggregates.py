"""Queries A01 to A43."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import setjoin as SJ
from ..operators import windows as W
from ..sources.tables import facts, steps, table, tape
from .joins import STUDY, study, study_sql
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000

#: A deterministic score and label of labelled documents.
SCORED = "scored AS (SELECT l.doc_id, l.toxic AS y, l.quality, d.lang, d.source, (d.n_chars % 97 + 1) / 100.0 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.toxic IS NOT NULL)"


def scored(spark, d):
    n = F.col("n_chars") % 97 + 1
    return table(spark, d, "labels").where("toxic IS NOT NULL").join(table(spark, d, "documents").select("doc_id", "lang", "source", (n / 100.0).alias("p")), "doc_id").select("doc_id", F.col("toxic").alias("y"), "quality", "lang", "source", "p")


@query("A01_group_profile", "SELECT supp, count(*) AS n, round(avg(qty), 4) AS qty, round(avg(nullif(disc, 0)), 4) AS disc, sum(cents) AS cents, round(sum(cents) FILTER (WHERE win) * 1.0 / sum(cents), 4) AS won_share FROM steps GROUP BY supp")
def a01(spark, d):
    won = F.sum(F.when(F.col("win"), F.col("cents"))) / F.sum("cents")
    return steps(spark, d).groupBy("supp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qty"), 4).alias("qty"), F.round(F.avg(F.nullif("disc", F.lit(0))), 4).alias("disc"), F.sum("cents").alias("cents"), F.round(won, 4).alias("won_share"))


@query("A02_conditional_rate", "SELECT part, CASE WHEN count(*) FILTER (WHERE side = 'O') >= 5 THEN round(avg(CASE WHEN win THEN 1.0 ELSE 0 END) FILTER (WHERE side = 'O'), 4) END AS rate, count(*) FILTER (WHERE side = 'O') AS n FROM steps GROUP BY part")
def a02(spark, d):
    o = F.col("side") == "O"
    rate = F.when(F.count_if(o) >= 5, F.round(F.avg(F.when(o, F.col("win").cast("int"))), 4))
    return steps(spark, d).groupBy("part").agg(rate.alias("rate"), F.count_if(o).alias("n"))


@query("A03_mode", "SELECT key, kind, n FROM (SELECT key, kind, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, kind) AS rn FROM tape GROUP BY key, kind) WHERE rn = 1")
def a03(spark, d):
    n = tape(spark, d).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "kind")).alias("x")).select("key", "x.kind", (-F.col("x.m")).alias("n"))


@query("A04_conditional_distribution", "SELECT side, flag, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY side), 6) AS share FROM steps GROUP BY side, flag")
def a04(spark, d):
    n = steps(spark, d).groupBy("side", "flag").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("side")), 6))


@query("A05_pivot", "SELECT key, coalesce(max_by(cents, (us, seq)) FILTER (WHERE kind = 'view'), 0) AS view, coalesce(max_by(cents, (us, seq)) FILTER (WHERE kind = 'click'), 0) AS click, coalesce(max_by(cents, (us, seq)) FILTER (WHERE kind = 'error'), 0) AS error FROM tape GROUP BY key")
def a05(spark, d):
    return tape(spark, d).groupBy("key").pivot("kind", ["view", "click", "error"]).agg(F.max_by("cents", F.struct("us", "seq"))).na.fill(0)


@query("A06_leave_one_out", "WITH g AS (SELECT supp, part % 20 AS grp20, sum(qty) AS s, count(qty) AS n FROM steps GROUP BY ALL) SELECT supp, grp20, CAST(sum(n) OVER (PARTITION BY supp) - n AS BIGINT) AS n_other, round(CASE WHEN sum(n) OVER (PARTITION BY supp) - n >= 5 THEN (sum(s) OVER (PARTITION BY supp) - s) * 1.0 / (sum(n) OVER (PARTITION BY supp) - n) END, 4) AS mean_other FROM g")
def a06(spark, d):
    s = steps(spark, d).withColumn("grp20", F.col("part") % 20)
    return A.leave_one_out(s, "supp", "grp20", "qty", 5).withColumn("mean_other", F.round("mean_other", 4))


@query("A07_shrunken_rate", "SELECT part, round((count(*) FILTER (WHERE win) + 10 * 0.33) / (count(*) + 10), 6) AS rate FROM steps GROUP BY part")
def a07(spark, d):
    return steps(spark, d).groupBy("part").agg(F.round(A.shrunken(F.count_if("win"), F.count(F.lit(1)), 0.33, 10), 6).alias("rate"))


@query("A08_decay_profile", "SELECT a.fact, round((coalesce(sum(pow(2, (b.day - a.day) / 90.0)) FILTER (WHERE b.won), 0) + 4 * 0.35) / (coalesce(sum(pow(2, (b.day - a.day) / 90.0)), 0) + 4), 4) AS form FROM facts a LEFT JOIN facts b ON b.entity = a.entity AND b.day < a.day GROUP BY a.fact")
def a08(spark, d):
    """Half-life weights from running sums of 2^(day/90) up to the decision, rebased there."""
    w = F.pow(F.lit(2.0), F.col("day") / 90.0 - 110)
    back = F.pow(F.lit(2.0), 110 - F.col("day") / 90.0)
    past = W.earlier(["entity"], "day")
    run = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0.0)) * back
    return facts(spark, d).select("fact", F.round(A.shrunken(run(F.when(F.col("won"), w)), run(w), 0.35, 4), 4).alias("form"))


@query("A09_distinct_grains", "SELECT status, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT day) AS days, count(DISTINCT coalesce(nullif(entity % 5, 0), day)) AS fallback FROM facts GROUP BY status")
def a09(spark, d):
    return facts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("day").alias("days"), F.count_distinct(F.coalesce(F.nullif(F.col("entity") % 5, F.lit(0)), F.col("day"))).alias("fallback"))


@query("A10_quantiles", "SELECT kind, round(quantile_cont(cents, 0.05), 4) AS q05, round(quantile_cont(cents, 0.5), 4) AS q50, round(quantile_cont(cents, 0.95), 4) AS q95, round(stddev_pop(cents), 4) AS sp, round(stddev_samp(cents), 4) AS ss FROM tape GROUP BY kind")
def a10(spark, d):
    return tape(spark, d).groupBy("kind").agg(*[F.round(F.percentile("cents", q), 4).alias(n) for q, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))], F.round(F.stddev_pop("cents"), 4).alias("sp"), F.round(F.stddev_samp("cents"), 4).alias("ss"))


@query("A11_trade_summary", f"WITH RECURSIVE {STUDY} SELECT count(pnl) AS n, round(avg(pnl), 4) AS mean, round(quantile_cont(pnl, 0.5), 4) AS median, round(count(*) FILTER (WHERE pnl > 0) * 1.0 / count(pnl), 4) AS hit, round(sum(pnl) FILTER (WHERE pnl > 0) * 1.0 / nullif(-sum(pnl) FILTER (WHERE pnl < 0), 0), 4) AS profit_factor FROM study")
def a11(spark, d):
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return study(spark, d).agg(F.count("pnl").alias("n"), F.round(F.avg("pnl"), 4).alias("mean"), F.round(F.percentile("pnl", 0.5), 4).alias("median"), F.round(F.count_if(F.col("pnl") > 0) / F.count("pnl"), 4).alias("hit"), F.round(F.try_divide(won, lost), 4).alias("profit_factor"))


@query("A12_cohort_cube", "WITH s AS (SELECT *, unnest([20, 30, 40]) AS thr FROM steps) SELECT thr, side, flag, count(*) AS n, sum(qty) AS qty, grouping(side, flag) AS level FROM s WHERE qty >= thr GROUP BY GROUPING SETS ((thr), (thr, side), (thr, flag))")
def a12(spark, d):
    s = steps(spark, d).withColumn("thr", F.explode(F.array(F.lit(20), F.lit(30), F.lit(40)))).where("qty >= thr")
    g = s.groupingSets([["thr"], ["thr", "side"], ["thr", "flag"]], "thr", "side", "flag")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), (F.grouping("side") * 2 + F.grouping("flag")).cast("long").alias("level"))


@query("A13_probability_metrics", f"WITH {SCORED} SELECT lang, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM scored GROUP BY lang")
def a13(spark, d):
    m = scored(spark, d).groupBy("lang").agg(*A.metrics("p", "y"))
    return m.select("lang", *[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "accuracy")])


@query("A14_weighted_metrics", f"WITH {SCORED}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY source) AS w FROM scored) SELECT round(sum(w * pow(p - y, 2)) / sum(w), 6) AS brier, round(sum(w * CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) / sum(w), 6) AS log_loss, round(sum(w * CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) / sum(w), 6) AS accuracy FROM w")
def a14(spark, d):
    s = scored(spark, d)
    w = s.join(s.groupBy("source").agg((1.0 / F.count(F.lit(1))).alias("w")), "source")
    m = w.agg(*A.metrics("p", "y", "w"))
    return m.select(*[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "accuracy")])


@query("A15_auc", f"WITH {SCORED}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM scored) SELECT lang, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auc FROM r GROUP BY lang")
def a15(spark, d):
    return A.auc(scored(spark, d), ["lang"], "p", "y").withColumn("auc", F.round("auc", 6))


@query("A16_calibration_bins", f"WITH {SCORED} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM scored GROUP BY 1")
def a16(spark, d):
    b = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")
    return scored(spark, d).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("actual"))


@query("A17_equal_frequency_error", f"WITH {SCORED}, c AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM scored), b AS (SELECT s.*, len(list_filter(c.q, lambda x: s.p > x)) AS bin FROM scored s, c), g AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY bin) SELECT round(sum(n * gap) / sum(n), 6) AS ece, CAST(count(*) AS BIGINT) AS bins FROM g")
def a17(spark, d):
    s = scored(spark, d)
    cuts = s.agg(F.percentile("p", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("q"))
    b = s.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("q", lambda x: F.col("p") > x)))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return g.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.count(F.lit(1)).alias("bins"))


@query("A18_wilson", "WITH s AS (SELECT supp, count(*) FILTER (WHERE win) AS w, count(*) AS n FROM steps GROUP BY supp) SELECT supp, round((w * 1.0 / n + 3.8416 / (2 * n) - 1.96 * sqrt(w * 1.0 / n * (1 - w * 1.0 / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((w * 1.0 / n + 3.8416 / (2 * n) + 1.96 * sqrt(w * 1.0 / n * (1 - w * 1.0 / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM s")
def a18(spark, d):
    low, high = A.wilson(F.col("w"), F.col("n"))
    s = steps(spark, d).groupBy("supp").agg(F.count_if("win").cast("double").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    return s.select("supp", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("A19_acceptance_verdict", f"WITH RECURSIVE {STUDY} SELECT h, count(pnl) AS n, round(avg(pnl) - 1.96 * stddev_samp(pnl) / sqrt(count(pnl)), 4) AS low, CASE WHEN count(pnl) < 20 THEN 'too_few' WHEN avg(pnl) - 1.96 * stddev_samp(pnl) / sqrt(count(pnl)) > 0 THEN 'accept' WHEN avg(pnl) < 0 THEN 'reject' ELSE 'open' END AS verdict FROM study GROUP BY h")
def a19(spark, d):
    g = study(spark, d).groupBy("h").agg(F.count("pnl").alias("n"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"))
    low = F.col("m") - 1.96 * F.col("s") / F.sqrt("n")
    return g.select("h", "n", F.round(low, 4).alias("low"), F.when(F.col("n") < 20, "too_few").when(low > 0, "accept").when(F.col("m") < 0, "reject").otherwise("open").alias("verdict"))


@query("A20_cluster_bootstrap")
def a20(spark, d):
    return A.cluster_bootstrap(study(spark, d).where("pnl IS NOT NULL"), ["h"], "key", "pnl", draws=400)


@query("A21_paired_increment", f"WITH {SCORED}, l AS (SELECT source, avg(pow(0.1 - y, 2)) - avg(pow(p - y, 2)) AS gain FROM scored GROUP BY source) SELECT round(avg(gain), 6) AS gain, count(*) AS sources FROM l")
def a21(spark, d):
    loss = lambda p: F.avg(F.pow(p - F.col("y"), F.lit(2.0)))
    each = scored(spark, d).groupBy("source").agg((loss(F.lit(0.1)) - loss(F.col("p"))).alias("gain"))
    return each.agg(F.round(F.avg("gain"), 6).alias("gain"), F.count(F.lit(1)).alias("sources"))


@query("A21_paired_increment_ci")
def a21_ci(spark, d):
    s = scored(spark, d).withColumn("gain", F.pow(0.1 - F.col("y"), F.lit(2.0)) - F.pow(F.col("p") - F.col("y"), F.lit(2.0)))
    return A.cluster_bootstrap(s.withColumn("all", F.lit(1)), ["all"], "source", "gain", draws=400).drop("all")


@query("A22_hierarchical_weights", """
WITH s AS (SELECT entity, grp, line, step FROM steps JOIN facts ON fact = grp), n1 AS (SELECT entity, grp, line, count(*) AS n FROM s GROUP BY ALL), n2 AS (SELECT entity, grp, count(*) AS n FROM n1 GROUP BY ALL), n3 AS (SELECT entity, count(*) AS n FROM n2 GROUP BY ALL)
SELECT s.grp, s.step, round(1.0 / (n1.n * n2.n * n3.n), 8) AS weight FROM s JOIN n1 USING (entity, grp, line) JOIN n2 USING (entity, grp) JOIN n3 USING (entity)""")
def a22(spark, d):
    """Every entity weighs 1, shared equally by its groups, their lines, their steps.  Steps of a line weigh the same, so the
    order by line alone gives the same rows, from one sort of two columns; entities' counts come from a row for each group."""
    line, rank = Window.partitionBy("grp", "line").orderBy("line"), Window.partitionBy("grp").orderBy("line")
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("bigint").alias("line"))
    s = i.select("grp", "line", F.row_number().over(rank).cast("bigint").alias("step"), F.dense_rank().over(rank).cast("bigint").alias("rank"), F.count(F.lit(1)).over(line).alias("n1"))
    s = s.withColumn("n2", F.max("rank").over(Window.partitionBy("grp"))).where("line IS NOT NULL")
    of = facts(spark, d).groupBy(F.col("fact").alias("grp"), "entity").agg(F.count(F.lit(1)).alias("times")).join(i.select("grp").distinct(), "grp")
    of = of.join(of.groupBy("entity").agg(F.count(F.lit(1)).alias("n3")), "entity").select("grp", "times", "n3")
    weight = 1.0 / (F.col("n1") * F.col("times") * F.col("n2") * F.col("n3"))
    each = s.join(of, "grp").select("grp", "step", F.round(weight, 8).alias("weight"), "times")
    return each.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("grp", "step", "weight")


@query("A23_correlation", "WITH r AS (SELECT supp, avg(qty) AS x, avg(disc) AS y FROM steps GROUP BY supp), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM r) SELECT round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 4) AS spearman FROM k")
def a23(spark, d):
    """Ranks are taken among the suppliers' means: a dimension, so one ordered task is small."""
    r = steps(spark, d).groupBy("supp").agg(F.avg("qty").alias("x"), F.avg("disc").alias("y"))
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    return r.select("x", "y", rank("x").alias("rx"), rank("y").alias("ry")).agg(F.round(F.corr("x", "y"), 4).alias("pearson"), F.round(F.corr("rx", "ry"), 4).alias("spearman"))


@query("A24_entropy_overlap", """
WITH n AS (SELECT key, kind, count(*) AS n FROM tape GROUP BY ALL), s AS (SELECT key, round(-sum(n * 1.0 / t * ln(n * 1.0 / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS t FROM n) GROUP BY key),
p AS (SELECT key, list_distinct(list(k // 10)) AS pool FROM tape WHERE kind = 'purchase' GROUP BY key), q AS (SELECT key, list_distinct(list(k // 10)) AS pool FROM tape WHERE kind = 'view' GROUP BY key)
SELECT s.key, s.entropy, round(len(list_intersect(p.pool, q.pool)) * 1.0 / len(list_distinct(list_concat(p.pool, q.pool))), 6) AS overlap FROM s LEFT JOIN p ON s.key = p.key LEFT JOIN q ON s.key = q.key""")
def a24(spark, d):
    t = tape(spark, d)
    n = t.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("key")))
    share = F.col("n") / F.col("t")
    s = n.groupBy("key").agg(F.round(-F.sum(share * F.log(share)), 6).alias("entropy"))
    pool = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.floor(F.col("k") / 10)))
    g = t.groupBy("key").agg(pool("purchase").alias("p"), pool("view").alias("q"))
    overlap = F.when((F.size("p") > 0) & (F.size("q") > 0), F.round(F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q")), 6))
    return s.join(g, "key").select("key", "entropy", overlap.alias("overlap"))


@query("A25_components")
def a25(spark, d):
    """Groups that share three members or more, and what they reach.  SQL would pair all that
    reach each other; a test compares small tables with brute force."""
    return J.min_labels(SJ.overlap_links(steps(spark, d), "grp", "supp", 3))


@query("A26_majority_label", """
WITH v AS (SELECT entity, class, count(*) AS n FROM facts GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, class) AS rn, sum(n) OVER (PARTITION BY entity) AS total FROM v)
SELECT entity, CASE WHEN n >= 3 AND n * 1.0 / total >= 0.3 THEN class END AS label, round(n * 1.0 / total, 4) AS share FROM b WHERE rn = 1""")
def a26(spark, d):
    v = facts(spark, d).groupBy("entity", "class").agg(F.count(F.lit(1)).alias("n"))
    b = v.groupBy("entity").agg(F.min(F.struct((-F.col("n")).alias("m"), "class")).alias("x"), F.sum("n").alias("total")).select("entity", (-F.col("x.m")).alias("n"), "x.class", "total")
    share = F.col("n") / F.col("total")
    return b.select("entity", F.when((F.col("n") >= 3) & (share >= 0.3), F.col("class")).alias("label"), F.round(share, 4).alias("share"))


@query("A27_keep_first", "SELECT key, kind, k, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, kind, k ORDER BY us, seq) AS rn FROM tape) WHERE rn = 1")
def a27(spark, d):
    return tape(spark, d).groupBy("key", "kind", "k").agg(F.min_by("seq", F.struct("us", "seq")).alias("seq"))


@query("A28_canonical_member", "SELECT grp, min(part) AS part, min_by(cents, (part, step)) AS cents, array_to_string(list_sort(list_distinct(list(supp))), ',') AS members FROM steps GROUP BY grp")
def a28(spark, d):
    return steps(spark, d).groupBy("grp").agg(F.min("part").alias("part"), F.min_by("cents", F.struct("part", "step")).alias("cents"), F.array_join(F.array_sort(F.collect_set("supp")).cast("array<string>"), ",").alias("members"))


@query("A29_expected_winner", "WITH s AS (SELECT grp, sum(qty) FILTER (WHERE side = 'O') AS a, sum(qty) FILTER (WHERE side = 'F') AS b, count(*) FILTER (WHERE win AND side = 'O') AS wa, count(*) FILTER (WHERE win AND side = 'F') AS wb FROM steps GROUP BY grp) SELECT count(*) AS n, round(avg(CASE WHEN (coalesce(a, 0) > coalesce(b, 0)) = (wa > wb) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM s WHERE wa <> wb")
def a29(spark, d):
    o = F.col("side") == "O"
    s = steps(spark, d).groupBy("grp").agg(F.coalesce(F.sum(F.when(o, F.col("qty"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~o, F.col("qty"))), F.lit(0)).alias("b"), F.count_if(o & F.col("win")).alias("wa"), F.count_if(~o & F.col("win")).alias("wb")).where("wa <> wb")
    hit = (F.col("a") > F.col("b")) == (F.col("wa") > F.col("wb"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))


@query("A30_group_summary", "SELECT grp, count(*) AS n, count(*) FILTER (WHERE win) AS wins, bool_or(win) FILTER (WHERE step = 1) AS first_won, count(*) FILTER (WHERE win AND side = 'O') AS o_wins, count(*) FILTER (WHERE win AND side = 'F') AS f_wins, min_by(side, step) AS first_side FROM steps GROUP BY grp")
def a30(spark, d):
    return steps(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("wins"), F.bool_or(F.when(F.col("step") == 1, F.col("win"))).alias("first_won"), F.count_if(F.col("win") & (F.col("side") == "O")).alias("o_wins"), F.count_if(F.col("win") & (F.col("side") == "F")).alias("f_wins"), F.min_by("side", "step").alias("first_side"))


@query("A31_score_state_odds", """
WITH b AS (SELECT grp, step, win, count(*) FILTER (WHERE win) OVER w AS a, count(*) FILTER (WHERE NOT win) OVER w AS b FROM steps WINDOW w AS (PARTITION BY grp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE win) AS w FROM b GROUP BY ALL HAVING count(*) >= 8) SELECT a, b, n, round(w * 1.0 / nullif(n - w, 0), 6) AS odds, round(0.4 * w / nullif(0.4 * w + 0.6 * (n - w), 0), 6) AS updated FROM g""")
def a31(spark, d):
    """Odds of winning at a score (won against lost there), and a prior of 0.4 updated by them."""
    w = W.before(["grp"], ["step"])
    s = steps(spark, d).select("win", F.count(F.when(F.col("win"), 1)).over(w).alias("a"), F.count(F.when(~F.col("win"), 1)).over(w).alias("b"))
    g = s.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("w")).where("n >= 8")
    lost = F.col("n") - F.col("w")
    return g.select("a", "b", "n", F.round(F.try_divide(F.col("w"), lost), 6).alias("odds"), F.round(F.try_divide(0.4 * F.col("w"), 0.4 * F.col("w") + 0.6 * lost), 6).alias("updated"))


@query("A32_snapshot_geometry", "WITH p AS (SELECT a.grp, sqrt(pow(a.qty - b.qty, 2) + pow(a.disc - b.disc, 2)) AS d FROM steps a JOIN steps b ON a.grp = b.grp AND a.step < b.step) SELECT p.grp, count(*) AS pairs, round(avg(d), 4) AS mean, round(max(d), 4) AS top, max(d) <= 10 AS stacked FROM p GROUP BY p.grp")
def a32(spark, d):
    s = steps(spark, d).select("grp", "step", "qty", "disc")
    o = s.select("grp", *[F.col(c).alias("o_" + c) for c in ("step", "qty", "disc")])
    dist = F.sqrt(F.pow(F.col("qty") - F.col("o_qty"), F.lit(2)) + F.pow(F.col("disc") - F.col("o_disc"), F.lit(2)))
    p = s.join(o, "grp").where("step < o_step").withColumn("d", dist)
    return p.groupBy("grp").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.max("d"), 4).alias("top"), (F.max("d") <= 10).alias("stacked"))


@query("A33_stat_lines", "SELECT f.entity, s.side, count(*) AS n, count(*) FILTER (WHERE s.win) AS wins, sum(s.qty) AS qty, count(DISTINCT s.part) AS parts, count(*) FILTER (WHERE s.step = 1 AND s.win) AS openings FROM steps s JOIN facts f ON s.grp = f.fact GROUP BY f.entity, s.side")
def a33(spark, d):
    """Parts are counted where they are new in a sort, which spills, instead of in a map of all of them."""
    m = steps(spark, d).select("grp", "side", "win", "qty", "part", ((F.col("step") == 1) & F.col("win")).alias("opening")).join(facts(spark, d).select(F.col("fact").alias("grp"), "entity"), "grp").drop("grp")
    again = F.col("part").eqNullSafe(F.lag("part").over(Window.partitionBy("entity", "side").orderBy("part")))
    m = m.withColumn("new", F.col("part").isNotNull() & ~again)
    return m.groupBy("entity", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("wins"), F.sum("qty").alias("qty"), F.count_if("new").alias("parts"), F.count_if("opening").alias("openings"))


@query("A34_survivor_totals", "WITH k AS (SELECT key, k, sum(cents) FILTER (WHERE kind = 'error') AS dmg, bool_or(kind = 'signup') AS dead FROM tape GROUP BY key, k) SELECT key, count(*) FILTER (WHERE NOT dead) AS alive, sum(greatest(0, 10000 - coalesce(dmg, 0))) FILTER (WHERE NOT dead) AS health FROM k GROUP BY key")
def a34(spark, d):
    k = tape(spark, d).groupBy("key", "k").agg(F.sum(F.when(F.col("kind") == "error", F.col("cents"))).alias("dmg"), F.bool_or(F.col("kind") == "signup").alias("dead"))
    left = F.greatest(F.lit(0), 10000 - F.coalesce("dmg", F.lit(0)))
    return k.groupBy("key").agg(F.count_if(~F.col("dead")).alias("alive"), F.sum(F.when(~F.col("dead"), left)).alias("health"))


@query("A35_trajectory_summary", """
WITH g AS (SELECT grp, step, win, sum(CASE WHEN win THEN 1 ELSE -1 END) OVER (PARTITION BY grp ORDER BY step ROWS UNBOUNDED PRECEDING) AS gap FROM steps), s AS (SELECT grp, min_by(win, step) AS first_won, max(gap) AS top, min(gap) AS low, max_by(gap, step) AS final FROM g GROUP BY grp)
SELECT *, CASE WHEN final > 0 AND low < 0 OR final < 0 AND top > 0 THEN 'comeback' WHEN abs(final) >= 3 THEN 'stomp' WHEN final = 0 THEN 'even' ELSE 'normal' END AS shape FROM s""")
def a35(spark, d):
    gap = F.sum(F.when(F.col("win"), 1).otherwise(-1)).over(W.upto(["grp"], ["step"]))
    s = steps(spark, d).withColumn("gap", gap).groupBy("grp").agg(F.min_by("win", "step").alias("first_won"), F.max("gap").alias("top"), F.min("gap").alias("low"), F.max_by("gap", "step").alias("final"))
    back = ((F.col("final") > 0) & (F.col("low") < 0)) | ((F.col("final") < 0) & (F.col("top") > 0))
    return s.withColumn("shape", F.when(back, "comeback").when(F.abs("final") >= 3, "stomp").when(F.col("final") == 0, "even").otherwise("normal"))


@query("A36_pnl_slices", f"WITH RECURSIVE {STUDY} SELECT h, CASE WHEN abs(move) < 6000 THEN 'low' WHEN abs(move) < 10000 THEN 'mid' ELSE 'high' END AS band, move > 0 AS up, count(pnl) AS n, sum(pnl) AS signal, sum(abs(pnl)) AS oracle FROM study WHERE pnl IS NOT NULL GROUP BY ALL")
def a36(spark, d):
    m = F.abs("move")
    band = F.when(m < 6000, "low").when(m < 10000, "mid").otherwise("high")
    return study(spark, d).where("pnl IS NOT NULL").groupBy("h", band.alias("band"), (F.col("move") > 0).alias("up")).agg(F.count("pnl").alias("n"), F.sum("pnl").alias("signal"), F.sum(F.abs("pnl")).alias("oracle"))


@query("A37_entity_portrait", "SELECT key, count(*) AS n, round(avg(CASE WHEN kind = 'purchase' THEN 1.0 ELSE 0 END), 4) AS buys, round(avg(cents) FILTER (WHERE kind = 'purchase'), 4) AS paid, count(*) FILTER (WHERE kind = 'view') AS view, count(*) FILTER (WHERE kind = 'click') AS click, CASE WHEN count(*) FILTER (WHERE kind = 'purchase') * 4 >= count(*) THEN 'buyer' WHEN count(*) FILTER (WHERE kind = 'error') * 4 >= count(*) THEN 'unlucky' ELSE 'other' END AS role FROM tape GROUP BY key")
def a37(spark, d):
    n, of = F.count(F.lit(1)), lambda kind: F.count_if(F.col("kind") == kind)
    role = F.when(of("purchase") * 4 >= n, "buyer").when(of("error") * 4 >= n, "unlucky").otherwise("other")
    return tape(spark, d).groupBy("key").agg(n.alias("n"), F.round(of("purchase") / n, 4).alias("buys"), F.round(F.avg(F.when(F.col("kind") == "purchase", F.col("cents"))), 4).alias("paid"), of("view").alias("view"), of("click").alias("click"), role.alias("role"))


@query("A38_target_encoding", "WITH e AS (SELECT part, avg(CASE WHEN win THEN 1.0 ELSE 0 END) AS r FROM steps WHERE grp % 5 <> 0 GROUP BY part), g AS (SELECT avg(CASE WHEN win THEN 1.0 ELSE 0 END) AS r FROM steps WHERE grp % 5 <> 0) SELECT s.grp, s.step, round(coalesce(e.r, g.r), 6) AS encoded FROM steps s LEFT JOIN e ON s.part = e.part, g WHERE s.grp % 5 = 0")
def a38(spark, d):
    s = steps(spark, d).withColumn("y", F.col("win").cast("int"))
    train, test = s.where("grp % 5 <> 0"), s.where("grp % 5 = 0")
    return test.join(train.groupBy("part").agg(F.avg("y").alias("r")), "part", "left").join(F.broadcast(train.agg(F.avg("y").alias("all")))).select("grp", "step", F.round(F.coalesce("r", "all"), 6).alias("encoded"))


@query("A39_latency_decay", f"WITH RECURSIVE {study_sql((24,), (0, 1, 3))} SELECT latency, count(*) AS n, count(pnl) AS filled, round(avg(pnl), 4) AS mean FROM study GROUP BY latency")
def a39(spark, d):
    """The event study at several latencies."""
    each = [study(spark, d, (24,), lat).withColumn("latency", F.lit(lat)) for lat in (0, 1, 3)]
    all_ = each[0].unionByName(each[1]).unionByName(each[2])
    return all_.groupBy("latency").agg(F.count(F.lit(1)).alias("n"), F.count("pnl").alias("filled"), F.round(F.avg("pnl"), 4).alias("mean"))


@query("A40_win_table", "SELECT supp, part % 10 AS place, count(*) AS n, count(*) FILTER (WHERE win) AS wins, round((count(*) FILTER (WHERE win) + 5 * 0.33) / (count(*) + 5), 6) AS rate FROM steps GROUP BY ALL")
def a40(spark, d):
    return steps(spark, d).groupBy("supp", (F.col("part") % 10).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("wins"), F.round(A.shrunken(F.count_if("win"), F.count(F.lit(1)), 0.33, 5), 6).alias("rate"))


@query("A41_counters", "SELECT kind, CASE WHEN cents < 500 THEN 'tiny' WHEN k < 5 THEN 'low_k' ELSE 'ok' END AS status, count(*) AS n FROM tape GROUP BY ALL")
def a41(spark, d):
    status = F.when(F.col("cents") < 500, "tiny").when(F.col("k") < 5, "low_k").otherwise("ok")
    return tape(spark, d).groupBy("kind", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("A42_segment_means", "WITH s AS (SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(list_avg(CAST(list_slice(e, 1, n // 8) AS DOUBLE[])), 4) AS head, round(list_avg(CAST(list_slice(e, n // 4 + 1, n // 2) AS DOUBLE[])), 4) AS middle FROM s")
def a42(spark, d):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.size("embedding").alias("n"))
    n = F.col("n")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(part))
    q = lambda k: F.floor(n / k).cast("int")
    return e.select("vec_id", F.round(mean(F.slice("e", F.lit(1), q(8))), 4).alias("head"), F.round(mean(F.slice("e", q(4) + 1, q(2) - q(4))), 4).alias("middle"))


@query("A43_settled_first", "SELECT entity, min_by(fact, (day, fact)) AS fact, min_by(won, (day, fact)) AS won, count(*) AS n FROM facts WHERE status <> 'P' GROUP BY entity")
def a43(spark, d):
    return facts(spark, d).where("status <> 'P'").groupBy("entity").agg(F.min_by("fact", F.struct("day", "fact")).alias("fact"), F.min_by("won", F.struct("day", "fact")).alias("won"), F.count(F.lit(1)).alias("n"))
