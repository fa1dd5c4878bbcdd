"""Queries M01 to M22, U01 to U07, C30 and C32: splits, MLlib models and extension points.

Splits, weights and closed-form fits have oracles; fitted models return rows only.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import clusters as C
from ..operators import effects as EF
from ..operators import frozen as FZ
from ..operators import windows as W
from ..scratch import materialize, scratch_path
from ..sources.tables import facts, steps, table, tape
from .registry import query

DAY = 86_400_000_000


def _orders(spark, d):
    """Facts with past form (strictly before the day), price and class; y = won."""
    past = W.earlier(["entity"], "day")
    won = F.coalesce(F.sum(F.col("won").cast("int")).over(past), F.lit(0))
    f = facts(spark, d)
    return f.select("fact", "entity", "day", "class", F.col("won").cast("double").alias("y"), A.shrunken(won, F.count(F.lit(1)).over(past), 0.33, 4.0).alias("form"), (F.col("cents") / 1e7).alias("price"))


def _logistic(columns: list[str], **more) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x0"), StandardScaler(inputCol="x0", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, standardization=False, maxIter=25, **more)])


def _scored(model, df):
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def fit_tick_model(spark, d):
    """Whether a tick is a purchase, from price and k; used by the scoring stream."""
    t = tape(spark, d).withColumns({"x1": F.col("cents") / 100, "x2": F.col("k").cast("double"), "y": (F.col("kind") == "purchase").cast("double")}).dropna(subset=["x1", "x2"])
    return Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01)]).fit(t)


@query("M01_fixed_step_folds", "WITH g AS (SELECT min(day) AS d0, max(day) AS d1 FROM facts), f AS (SELECT CAST(i AS INT) AS fold, d0 + 720 + i * 180 AS test_start FROM (SELECT *, unnest(range(0, (d1 - d0 - 720) // 180 + 1)) AS i FROM g WHERE d1 >= d0 + 720)) SELECT f.fold, f.test_start, count(*) FILTER (WHERE x.day < f.test_start) AS train, count(*) FILTER (WHERE x.day >= f.test_start AND x.day < f.test_start + 180) AS test FROM f, facts x GROUP BY ALL HAVING count(*) FILTER (WHERE x.day < f.test_start) >= 500")
def m01(spark, d):
    """Folds grow by 180 days after the first 720; counted a day, not a row, at a time."""
    f = facts(spark, d)
    days = f.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    ends = f.agg(F.min("day").alias("d0"), F.max("day").alias("d1")).where("d1 >= d0 + 720")
    folds = ends.withColumn("fold", F.explode(F.expr("sequence(0, cast((d1 - d0 - 720) div 180 as int))"))).withColumn("test_start", F.col("d0") + 720 + F.col("fold") * 180).select("fold", "test_start")
    m = days.join(F.broadcast(folds), F.col("day") < F.col("test_start") + 180)
    g = m.groupBy("fold", "test_start").agg(F.coalesce(F.sum(F.when(F.col("day") < F.col("test_start"), F.col("n"))), F.lit(0)).alias("train"), F.coalesce(F.sum(F.when(F.col("day") >= F.col("test_start"), F.col("n"))), F.lit(0)).alias("test"))
    return g.where("train >= 500")


BLOCKS = "b AS (SELECT fact, day, day + 30 AS ready, least((dense_rank() OVER (ORDER BY day) - 1) * 5 // (SELECT count(DISTINCT day) FROM facts), 4) AS block FROM facts), s AS (SELECT block, min(day) AS start FROM b GROUP BY block)"


def blocks(spark, d):
    """Days in five blocks of equal numbers of days; ranks are taken over days, not rows."""
    f = facts(spark, d).select("fact", "day", (F.col("day") + 30).alias("ready"))
    days = f.select("day").distinct()
    ranked = days.withColumn("r", F.row_number().over(Window.orderBy("day")) - 1)
    block = F.least(F.floor(F.col("r") * 5 / F.col("n")), F.lit(4)).cast("bigint")
    named = ranked.join(F.broadcast(days.agg(F.count(F.lit(1)).alias("n")))).select("day", block.alias("block"))
    return f.join(named, "day")


@query("M02_chronological_blocks", f"WITH {BLOCKS} SELECT s.block, s.start, count(*) FILTER (WHERE b.block < s.block AND b.ready < s.start) AS train, count(*) FILTER (WHERE b.block = s.block) AS test, count(*) FILTER (WHERE b.block < s.block AND b.ready >= s.start) AS held_back FROM s, b GROUP BY ALL")
def m02(spark, d):
    b = blocks(spark, d)
    s = b.groupBy("block").agg(F.min("day").alias("start")).select(F.col("block").alias("of"), "start")
    m = b.groupBy("block", "day", "ready").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(s), F.col("block") <= F.col("of"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    old = F.col("block") < F.col("of")
    return m.groupBy(F.col("of").alias("block_"), "start").agg(n(old & (F.col("ready") < F.col("start"))).alias("train"), n(F.col("block") == F.col("of")).alias("test"), n(old & (F.col("ready") >= F.col("start"))).alias("held_back")).withColumnRenamed("block_", "block")


@query("M03_frozen_tail", "WITH q AS (SELECT quantile_disc(day, 0.8) AS cut FROM facts) SELECT day >= cut AS tail, count(*) AS n, count(DISTINCT day) AS stamps, min(day) AS first_day FROM facts, q GROUP BY 1")
def m03(spark, d):
    f = facts(spark, d)
    days = f.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    cut = f.agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY day)").cast("bigint").alias("cut"))
    return days.join(F.broadcast(cut)).groupBy((F.col("day") >= F.col("cut")).alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("stamps"), F.min("day").alias("first_day"))


@query("M04_grouped_folds", "SELECT entity % 5 AS fold, count(*) AS n, count(DISTINCT entity) AS groups FROM facts GROUP BY 1")
def m04(spark, d):
    e = facts(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy((F.col("entity") % 5).alias("fold")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


@query("M05_weighted_logistic")
def m05(spark, d):
    o = _orders(spark, d).withColumn("w", S.decay(F.lit(11600) - F.col("day"), 900.0))
    p = Pipeline(stages=[StringIndexer(inputCol="class", outputCol="ci", handleInvalid="keep"), OneHotEncoder(inputCol="ci", outputCol="co"), VectorAssembler(inputCols=["form", "price", "co"], outputCol="x0"), StandardScaler(inputCol="x0", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, fitIntercept=False, standardization=False)])
    train, test = o.where("day < 11000"), o.where("day >= 11000")
    return _scored(p.fit(train), test).select("fact", "y", F.round("p", 6).alias("p"))


@query("M06_mirrored")
def m06(spark, d):
    """Samples and their mirrors after the split; a prediction is averaged with its mirror's complement."""
    s = steps(spark, d).select("grp", "step", F.col("qty").cast("double").alias("a"), F.col("disc").cast("double").alias("b"), F.col("win").cast("double").alias("y"))
    mirror = lambda df: df.select("grp", "step", F.col("b").alias("a"), F.col("a").alias("b"), (1 - F.col("y")).alias("y"))
    train, test = s.where("grp % 4 > 0"), s.where("grp % 4 = 0")
    model = _logistic(["a", "b"], fitIntercept=False).fit(train.unionByName(mirror(train)))
    p = _scored(model, test).select("grp", "step", "p").join(_scored(model, mirror(test)).select("grp", "step", (1 - F.col("p")).alias("q")), ["grp", "step"])
    return p.select("grp", "step", F.round((F.col("p") + F.col("q")) / 2, 6).alias("p"))


@query("M07_sample_weights", "SELECT fact, round(pow(2, -(11600 - day) / 365.0) * CASE WHEN class IN ('1-URGENT', '2-HIGH') THEN 1.5 ELSE 1 END / count(*) OVER (PARTITION BY entity), 8) AS w FROM facts")
def m07(spark, d):
    f = facts(spark, d)
    each = f.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    w = S.decay(F.lit(11600) - F.col("day"), 365.0) * F.when(F.col("class").isin("1-URGENT", "2-HIGH"), 1.5).otherwise(1.0) / F.col("n")
    return f.join(each, "entity").select("fact", F.round(w, 8).alias("w"))


@query("M08_boosted_isotonic")
def m08(spark, d):
    o = _orders(spark, d)
    x = VectorAssembler(inputCols=["form", "price"], outputCol="x")
    model = Pipeline(stages=[x, GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=7)]).fit(o.where("day < 10600"))
    raw = _scored(model, o.where("day >= 10600")).select("fact", "day", "y", F.col("p").alias("raw"))
    iso = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="p").fit(raw.where("day < 11000"))
    return iso.transform(raw.where("day >= 11000")).select("fact", "y", F.round("raw", 6).alias("raw"), F.round("p", 6).alias("p"))


@query("M09_platt")
def m09(spark, d):
    o = _orders(spark, d)
    raw = _scored(_logistic(["form", "price"]).fit(o.where("day < 10600")), o.where("day >= 10600")).select("fact", "day", "y", S.logit("p").alias("z"))
    platt = _logistic(["z"]).fit(raw.where("day < 11000"))
    return _scored(platt, raw.where("day >= 11000")).select("fact", "y", F.round("p", 6).alias("p"))


@query("M10_ridge")
def m10(spark, d):
    s = steps(spark, d).select("grp", "step", F.col("qty").cast("double"), F.col("disc").cast("double"), (F.col("cents") / 100).alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["qty", "disc"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", regParam=1.0, elasticNetParam=0.0)]).fit(s.where("grp % 4 > 0"))
    return model.transform(s.where("grp % 4 = 0")).agg(F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 2).alias("mae"), F.count(F.lit(1)).alias("n"))


@query("M11_areas")
def m11(spark, d):
    """Areas for each label from all its vectors' first two numbers; -1 where a label has too few."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    return C.areas(e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b")), 20, 8).select("vec_id", "label", "area")


@query("M12_entity_skill")
def m12(spark, d):
    """Skill of suppliers: effects of their own beside quantity and discount; they stay a table."""
    s = steps(spark, d).select(F.col("supp").cast("string").alias("entity"), "qty", "disc", F.col("win").cast("double").alias("y"))
    skill, _ = EF.entity_effects(s, "entity", ["qty", "disc"], "y", 0.05)
    return skill.select("entity", F.round("effect", 5).alias("skill"))


@query("M13_permutation_importance")
def m13(spark, d):
    """Loss after a feature's values are dealt anew by hash order within each day."""
    o = _orders(spark, d)
    model = _logistic(["form", "price"]).fit(o.where("day < 11000"))
    test = o.where("day >= 11000")
    loss = lambda df, name: _scored(model, df).agg(*A.metrics("p", "y")).select(F.lit(name).alias("feature"), F.round("log_loss", 6).alias("log_loss"))
    out = loss(test, "none")
    for c in ("form", "price"):
        month = F.floor(F.col("day") / 30).alias("m")
        rank = lambda seed: F.row_number().over(Window.partitionBy("m").orderBy(F.xxhash64("fact", F.lit(seed))))  # noqa: B023, E731
        left = test.withColumn("m", month).withColumn("r", rank(1))
        right = test.withColumn("m", month).withColumn("r", rank(2)).select("m", "r", F.col(c).alias("new"))
        out = out.unionByName(loss(left.join(right, ["m", "r"]).drop(c).withColumnRenamed("new", c), c))
    return out


@query("M14_ablation")
def m14(spark, d):
    o = _orders(spark, d)
    train, test = o.where("day < 11000"), o.where("day >= 11000")
    out = None
    for name, cols in (("form", ["form"]), ("form+price", ["form", "price"])):
        m = _scored(_logistic(cols).fit(train), test).agg(F.count(F.lit(1)).alias("n"), *A.metrics("p", "y")).select(F.lit(name).alias("variant"), "n", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))
        out = m if out is None else out.unionByName(m)
    return out


@query("M15_stacked")
def m15(spark, d):
    o = _orders(spark, d)
    base = [_logistic([c]).fit(o.where("day < 10400")) for c in ("form", "price")]
    z = o.where("day >= 10400")
    for i, m in enumerate(base):
        z = _scored(m, z).withColumn(f"z{i}", S.logit("p")).drop("p", "x0", "x", "rawPrediction", "probability", "prediction")
    stack = _logistic(["z0", "z1"]).fit(z.where("day < 11000"))
    return _scored(stack, z.where("day >= 11000")).select("fact", "y", F.round("p", 6).alias("p"))


@query("M16_score_upcoming")
def m16(spark, d):
    """Open facts scored by a model of the decided ones, with form as of their own day."""
    o = _orders(spark, d).join(facts(spark, d).select("fact", "status"), "fact")
    model = _logistic(["form", "price"]).fit(o.where("status <> 'P'"))
    return _scored(model, o.where("status = 'P'")).select("fact", F.round("p", 6).alias("p"))


@query("M17_multinomial")
def m17(spark, d):
    s = steps(spark, d).select("grp", F.col("qty").cast("double"), F.col("disc").cast("double"), F.col("line").cast("double"), "flag")
    p = Pipeline(stages=[StringIndexer(inputCol="flag", outputCol="y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=["qty", "disc", "line"], outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.01)])
    t = p.fit(s.where("grp % 4 > 0")).transform(s.where("grp % 4 = 0"))
    probs = vector_to_array("probability")
    rank = F.size(F.filter(probs, lambda x: x > F.get(probs, F.col("y").cast("int"))))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((rank == 0).cast("int")), 4).alias("top1"), F.round(F.avg((rank <= 1).cast("int")), 4).alias("top2"))


@query("M18_train_only_imputation", "WITH s AS (SELECT grp, step, CASE WHEN disc > 0 THEN CAST(disc AS DOUBLE) END AS x FROM steps), m AS (SELECT avg(x) AS a FROM s WHERE grp % 4 > 0) SELECT grp, step, round(coalesce(x, a), 6) AS x, x IS NULL AS missing FROM s, m WHERE grp % 4 = 0")
def m18(spark, d):
    s = steps(spark, d).select("grp", "step", F.when(F.col("disc") > 0, F.col("disc").cast("double")).alias("x"))
    model = Imputer(inputCols=["x"], outputCols=["filled"], strategy="mean").fit(s.where("grp % 4 > 0"))
    return model.transform(s.where("grp % 4 = 0")).select("grp", "step", F.round("filled", 6).alias("x"), F.col("x").isNull().alias("missing"))


@query("M19_surprise_features")
def m19(spark, d):
    """Residuals of a past-only model, fed back as each entity's mean of its last three."""
    o = _orders(spark, d)
    p = _scored(_logistic(["form", "price"]).fit(o.where("day < 10400")), o.where("day >= 10400")).withColumn("r", F.col("y") - F.col("p"))
    last = Window.partitionBy("entity").orderBy("day", "fact").rowsBetween(-3, -1)
    return p.select("fact", F.round(F.avg("r").over(last), 6).alias("surprise"))


def _contests(spark, d):
    """Facts as contests of two entities of one block of 25 of a pool."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("pool"))
    block = F.floor(F.col("entity") / 25)
    return facts(spark, d).join(c, "entity").select("fact", "day", "entity", "won", "pool", block.alias("block"), (block * 25 + (F.col("entity") + 7) % 25).alias("rival"))


@query("M20_elo_by_pool")
def m20(spark, d):
    """Elo within pools (nations); contests of one day are rated from the ratings before it.

    Rivals are of the same 25 entities, so that a pool's blocks of 25 are rated apart: the
    state of a pass is 25 ratings and one day's moves, however large a pool is."""

    def rate(state, day, entity, rival, won):
        last, rating, moves = state or (day, {}, {})
        if day != last:
            for e, m in moves.items():
                rating[e] = rating.get(e, 1500.0) + m
            moves = {}
        p = 1 / (1 + 10 ** ((rating.get(rival, 1500.0) - rating.get(entity, 1500.0)) / 400))
        move = 24 * (won - p)
        moves[entity] = moves.get(entity, 0.0) + move
        moves[rival] = moves.get(rival, 0.0) - move
        return (day, rating, moves), (p,)

    return W.ordered_pass(_contests(spark, d), ["pool", "block"], ["day", "fact"], ["day", "entity", "rival", "won"], {"p": "double"}, rate).select("fact", F.round("p", 6).alias("p"))


#: Rating points a unit of log odds; variance gained a day of rest; deviation of the unknown.
POINTS, DAILY, UNKNOWN = 400 / math.log(10), 20.0**2, 350.0


def rate_with_deviation(state, day, entity, rival, won):
    """Rating and deviation (Glickman's closed-form updates) of both sides of a contest; a
    deviation grows with the days of rest, up to that of an unknown.  Contests of one day
    see the ratings before it.  Gives (chance of entity, its deviation)."""
    last, book, news = state or (day, {}, {})
    if day != last:
        for who, (grade, pull) in news.items():
            r, variance, _ = book[who]
            variance = 1 / (1 / variance + grade)
            book[who] = (r + variance * pull, variance, last)
        news = {}
    for who in (entity, rival):
        r, variance, seen = book.get(who, (1500.0, UNKNOWN**2, day))
        book[who] = (r, min(UNKNOWN**2, variance + DAILY * (day - seen)), day)
    out = None
    for me, other, score in ((entity, rival, float(won)), (rival, entity, 1.0 - won)):
        g = 1 / math.sqrt(1 + 3 * book[other][1] / (math.pi * POINTS) ** 2)
        p = 1 / (1 + math.exp(-g * (book[me][0] - book[other][0]) / POINTS))
        grade, pull = news.get(me, (0.0, 0.0))
        news[me] = (grade + (g / POINTS) ** 2 * p * (1 - p), pull + g / POINTS * (score - p))
        out = out or (p, math.sqrt(book[me][1]))
    return (day, book, news), out


@query("M20_idle_deviation")
def m20_idle(spark, d):
    """Ratings whose deviation grows while an entity rests, in the pools and blocks of M20_elo_by_pool."""
    return W.ordered_pass(_contests(spark, d), ["pool", "block"], ["day", "fact"], ["day", "entity", "rival", "won"], {"p": "double", "deviation": "double"}, rate_with_deviation).select("fact", F.round("p", 6).alias("p"), F.round("deviation", 4).alias("deviation"))


def rate_without_series(state, day, entity, rival, won, series):
    """Chance of a contest from ratings that no result of its own series has moved.

    A series keeps the ratings from before its first day, and contests are kept since the oldest open
    series began: a later contest of a series replays those since then without the series' own.
    Series end with their month, so what is kept is a month's contests."""
    last, rating, today, log, opened = state or (day, {}, [], [], {})
    if day != last:
        rating = elo_day(rating, today)
        log.append((last, today))
        opened = {s: x for s, x in opened.items() if s[2] == day // 30}
        since = min((x[1] for x in opened.values()), default=day)
        log, today = [x for x in log if x[0] >= since], []
    now = rating
    if series in opened:
        now = opened[series][0]
        for then, contests in log:
            if then >= opened[series][1]:
                now = elo_day(now, [c for c in contests if c[3] != series])
    else:
        opened[series] = (dict(rating), day)
    today.append((entity, rival, won, series))
    return (day, rating, today, log, opened), (elo_chance(now, entity, rival),)


def elo_chance(rating, a, b):
    return 1 / (1 + 10 ** ((rating.get(b, 1500.0) - rating.get(a, 1500.0)) / 400))


def elo_day(rating, contests):
    """Ratings after a day's contests, all rated from the ratings before it."""
    after = dict(rating)
    for a, b, won, _ in contests:
        move = 24 * (won - elo_chance(rating, a, b))
        after[a], after[b] = after.get(a, 1500.0) + move, after.get(b, 1500.0) - move
    return after


@query("M20_without_own_series")
def m20_series(spark, d):
    """Elo in the pools and blocks of M20_elo_by_pool, where a month's contests of two entities are a series."""
    c = _contests(spark, d)
    c = c.withColumn("series", F.struct(F.least("entity", "rival").alias("a"), F.greatest("entity", "rival").alias("b"), F.floor(F.col("day") / 30).alias("month")))
    c = c.select("pool", "block", "day", "fact", "entity", "rival", "won", *[F.col(f"series.{x}").alias(f"s_{x}") for x in ("a", "b", "month")])
    step = lambda state, day, entity, rival, won, *series: rate_without_series(state, day, entity, rival, won, series)
    return W.ordered_pass(c, ["pool", "block"], ["day", "fact"], ["day", "entity", "rival", "won", "s_a", "s_b", "s_month"], {"p": "double"}, step).select("fact", F.round("p", 6).alias("p"))


#: Glicko-2's scale, the constraint of volatility's change, volatility and deviation of the unknown, days of a period.
SCALE, TAU, STEADY, WIDE, PERIOD = 173.7178, 0.5, 0.06, 350 / 173.7178, 30


def new_volatility(spread, v, delta, volatility):
    """The volatility that fits a period's surprise: the root of the published equation, found between two
    bounds that are halved."""
    centre = math.log(volatility**2)

    def slope(x):
        e = math.exp(x)
        return e * (delta**2 - spread**2 - v - e) / (2 * (spread**2 + v + e) ** 2) - (x - centre) / TAU**2

    low = high = centre
    while slope(low) < 0:
        low -= TAU
    while slope(high) > 0:
        high += TAU
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return math.exp((low + high) / 4)


def after_period(mean, spread, volatility, games):
    """(mean, spread, volatility) after a period's games (mean and spread of the other, score)."""
    info = pull = 0.0
    for other, wide, score in games:
        g = 1 / math.sqrt(1 + 3 * wide**2 / math.pi**2)
        chance = 1 / (1 + math.exp(-g * (mean - other)))
        info, pull = info + g**2 * chance * (1 - chance), pull + g * (score - chance)
    volatility = new_volatility(spread, 1 / info, pull / info, volatility)
    spread = 1 / math.sqrt(1 / (spread**2 + volatility**2) + info)
    return mean + spread**2 * pull, spread, volatility


def rate_with_volatility(state, day, entity, rival, won):
    """Chance and volatility before a contest; a day's contests are a period, and a spread grows with rest as
    the entity is volatile."""
    last, book, games = state or (day, {}, {})
    if day != last:
        for who, played in games.items():
            book[who] = (*after_period(*book[who][:3], played), last)
        games = {}
    for who in (entity, rival):
        mean, spread, volatility, seen = book.get(who, (0.0, WIDE, STEADY, day))
        book[who] = (mean, min(WIDE, math.sqrt(spread**2 + volatility**2 * (day - seen) / PERIOD)), volatility, day)
    (a, wide_a, volatility, _), (b, wide_b, _, _) = book[entity], book[rival]
    games.setdefault(entity, []).append((b, wide_b, float(won)))
    games.setdefault(rival, []).append((a, wide_a, 1.0 - won))
    g = 1 / math.sqrt(1 + 3 * (wide_a**2 + wide_b**2) / math.pi**2)
    return (day, book, games), (1 / (1 + math.exp(-g * (a - b))), volatility)


@query("M20_volatility")
def m20_volatility(spark, d):
    """Ratings with a volatility of each entity, in the pools and blocks of M20_elo_by_pool."""
    return W.ordered_pass(_contests(spark, d), ["pool", "block"], ["day", "fact"], ["day", "entity", "rival", "won"], {"p": "double", "volatility": "double"}, rate_with_volatility).select("fact", F.round("p", 6).alias("p"), F.round("volatility", 7).alias("volatility"))


@query("M21_scheme_tournament", "WITH c AS (SELECT unnest([10, 20, 30]) AS q, unnest([2, 4, 6]) AS x UNION ALL SELECT 25, 0), r AS (SELECT c.q, c.x, count(*) AS n, sum(CASE WHEN s.win THEN s.cents ELSE -s.cents END) AS net FROM c JOIN steps s ON s.qty >= c.q AND s.disc >= c.x GROUP BY ALL) SELECT arg_max(q, (net // 1000, -q)) AS q, arg_max(x, (net // 1000, -q)) AS x, max(net) AS net, count(*) AS schemes FROM r WHERE n >= 50")
def m21(spark, d):
    c = spark.createDataFrame([(10, 2), (20, 4), (30, 6), (25, 0)], "q int, x int")
    r = steps(spark, d).join(F.broadcast(c), (F.col("qty") >= F.col("q")) & (F.col("disc") >= F.col("x"))).groupBy("q", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("win"), F.col("cents")).otherwise(-F.col("cents"))).alias("net")).where("n >= 50")
    best = F.max_by(F.struct("q", "x"), F.struct(F.floor(F.col("net") / 1000), -F.col("q")))
    return r.agg(best.alias("b"), F.max("net").alias("net"), F.count(F.lit(1)).alias("schemes")).select("b.q", "b.x", "net", "schemes")


@query("M22_affine_fit", "WITH g AS (SELECT side, count(*) AS n, sum(qty) AS sx, sum(disc) AS sy, sum(qty * qty) AS sxx, sum(qty * disc) AS sxy FROM steps WHERE grp % 5 > 0 GROUP BY side), f AS (SELECT side, (n * sxy - sx * sy) * 1.0 / (n * sxx - sx * sx) AS b, sy * 1.0 / n - (n * sxy - sx * sy) * 1.0 / (n * sxx - sx * sx) * sx / n AS a FROM g) SELECT f.side, round(b, 6) AS slope, round(a, 6) AS base, round(avg(abs(s.disc - (a + b * s.qty))), 4) AS residual FROM f JOIN steps s ON f.side = s.side AND s.grp % 5 = 0 GROUP BY f.side, a, b")
def m22(spark, d):
    s = steps(spark, d)
    g = s.where("grp % 5 > 0").groupBy("side").agg(F.regr_slope("disc", "qty").alias("b"), F.regr_intercept("disc", "qty").alias("a"))
    return s.where("grp % 5 = 0").join(g, "side").groupBy("side", "a", "b").agg(F.round(F.avg(F.abs(F.col("disc") - (F.col("a") + F.col("b") * F.col("qty")))), 4).alias("residual")).select("side", F.round("b", 6).alias("slope"), F.round("a", 6).alias("base"), "residual")


@query("C30_exit_forecast")
def c30(spark, d):
    """Exit level of a session from a model that was frozen on earlier sessions."""
    t = tape(spark, d).withColumn("week", F.floor(F.col("us") / (7 * DAY)))
    s = t.groupBy("key", "week").agg(F.min_by("cents", "us").cast("double").alias("start"), F.avg("k").alias("k"), F.max_by("cents", "us").cast("double").alias("y"))
    first = s.agg(F.min("week")).first()[0]
    train, later = s.where(F.col("week") <= first + 1), s.where(F.col("week") > first + 1)
    model = Pipeline(stages=[VectorAssembler(inputCols=["start", "k"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", regParam=1.0)]).fit(train)
    path = scratch_path(spark, "forecaster")
    FZ.freeze(model, train, ["start", "k"], "week", path)
    return FZ.Frozen(spark, path).apply(later).select("key", "week", F.round("prediction", 2).alias("forecast"))


def _encodings(s, column: str, name: str):
    """column, {name}0, {name}1, ...: shrunken rates of wins of the rows outside each fold; 0.33 where there are none."""
    of = lambda k, c: F.sum(F.when(F.col("fold") != k, c).otherwise(0))
    rate = lambda k: A.shrunken(of(k, F.col("y")), of(k, F.lit(1)), 0.33, 5)
    return s.groupBy(column).agg(*[F.when(of(k, F.lit(1)) == 0, 0.33).otherwise(rate(k)).alias(f"{name}{k}") for k in range(FOLDS)])


def _fold_chance(f, k: int, columns: list[str], stats):
    """The chance, as a Column, of a model fitted on f's rows outside fold k.  Rows that are equal in label and features are
    one row with a weight, where that makes few of many."""
    at = {c: c if c == "q" else f"{c}{k}" for c in columns}
    z = [F.when(F.lit(stats[f"std_{x}_{k}"] > 0), (F.col(x) - stats[f"mean_{x}_{k}"]) / (stats[f"std_{x}_{k}"] or 1.0)).otherwise(0.0) for x in at.values()]
    rows = f.where(F.col("fold") != k).select("y", *at.values())
    if WEIGHED * stats[f"kinds_{'_'.join(columns)}_{k}"] < stats[f"n_{k}"]:
        rows = rows.groupBy("y", *at.values()).agg(F.count(F.lit(1)).cast("double").alias("w"))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    x = VectorAssembler(inputCols=columns, outputCol="x").transform(rows.select("y", "w", *[e.alias(c) for e, c in zip(z, columns, strict=True)]))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, standardization=False, maxIter=25).fit(x)
    margin = sum((e * float(w) for e, w in zip(z, model.coefficients, strict=True)), F.lit(float(model.intercept)))
    return 1 / (1 + F.exp(-margin))


#: Folds; rows for each distinct one from which on a fit takes distinct rows with weights.
FOLDS, WEIGHED = 3, 4


def out_of_fold(spark, d, variants: dict[str, list[str]], keep: tuple[str, ...] = ("grp", "step", "side", "flag"), adds: dict | None = None):
    """Steps with each variant's chance from models and encodings of the other folds: variant, `keep`, y, p.
    Features: q (size), sig (encoded part), supp_sig (encoded supplier).  adds: columns over steps, for `keep`.

    Every row is joined once with the encodings of all folds and written; fits read that table, and all chances are made in
    one pass over it."""
    coded = {c: of for c, of in (("sig", "part"), ("supp_sig", "supp")) if any(c in v for v in variants.values())}
    s = steps(spark, d).withColumns(adds or {}).select(*keep, *coded.values(), F.col("win").cast("double").alias("y"), F.pmod(F.xxhash64("grp"), F.lit(FOLDS)).alias("fold"), F.col("qty").cast("double").alias("q"))
    for c, of in coded.items():
        s = s.join(_encodings(s.select(of, "fold", "y"), of, c), of, "left").withColumns({f"{c}{k}": F.coalesce(f"{c}{k}", F.lit(0.33)) for k in range(FOLDS)}).drop(of)
    f = materialize(s, "fold-features")
    measures = []
    for k in range(FOLDS):
        train = lambda c: F.when(F.col("fold") != k, c)  # noqa: B023, E731
        measures.append(F.count(train(F.lit(1))).alias(f"n_{k}"))
        for x in ["q", *[f"{c}{k}" for c in coded]]:
            measures += [F.avg(train(F.col(x))).alias(f"mean_{x}_{k}"), F.stddev_samp(train(F.col(x))).alias(f"std_{x}_{k}")]
        for v in {tuple(v): None for v in variants.values()}:
            measures.append(F.approx_count_distinct(train(F.xxhash64("y", *[c if c == "q" else f"{c}{k}" for c in v]))).alias(f"kinds_{'_'.join(v)}_{k}"))
    stats = {name: x or 0 for name, x in f.agg(*measures).first().asDict().items()}
    chances = {name: [_fold_chance(f, k, columns, stats) for k in range(FOLDS)] for name, columns in variants.items()}
    p = lambda of: F.coalesce(*[F.when(F.col("fold") == k, of[k]) for k in range(FOLDS)])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("variant"), F.round(p(of), 4).alias("p")) for name, of in chances.items()]))
    return f.select(*keep, "y", each.alias("v")).select("v.variant", *keep, "y", "v.p")


@query("C32_signature_folds")
def c32(spark, d):
    """Out-of-fold predictions with an encoding learnt on the other folds, and AUC a side."""
    return A.auc(out_of_fold(spark, d, {"both": ["q", "sig"]}, ("side",)), ["side"], "p", "y").withColumn("auc", F.round("auc", 4))


#: What C32_ablations leaves out: the structure (encodings), the size, and one encoding at a time.
ABLATIONS = {"all": ["q", "sig", "supp_sig"], "no_structure": ["q"], "no_size": ["sig", "supp_sig"], "no_supplier": ["q", "sig"]}


@query("C32_ablations")
def c32_ablations(spark, d):
    """A row for each variant of features and stratum of steps (all, side, tier of the group's size): n and AUC out of fold."""
    load = {"load": F.sum("qty").over(Window.partitionBy("grp"))}
    tier = F.when(F.col("load") < 60, "small").when(F.col("load") < 140, "middle").otherwise("large")
    rows = out_of_fold(spark, d, ABLATIONS, ("grp", "side", "load"), load).where("grp IS NOT NULL")
    # Chances have four digits: strata and areas are made from counts at each.
    n = {"won": F.count_if(F.col("y") == 1), "lost": F.count_if(F.col("y") == 0), "n": F.count(F.lit(1))}
    at = rows.groupBy("variant", "side", tier.alias("tier"), "p").agg(*[c.alias(name) for name, c in n.items()])
    strata = F.array(*[F.struct(F.lit(name).alias("stratum"), value.alias("value")) for name, value in (("all", F.lit("all")), ("side", F.col("side")), ("tier", F.col("tier")))])
    by = ["variant", "stratum", "value"]
    each = at.withColumn("s", F.explode(strata)).groupBy("variant", "s.stratum", "s.value", "p").agg(*[F.sum(c).alias(c) for c in n])
    each = materialize(each, "fold-counts")
    return each.groupBy(*by).agg(F.sum("n").alias("n")).join(A.auc_of_counts(each, by, "p", "won", "lost").withColumn("auc", F.round("auc", 4)), by).select(*by, "n", "auc")


@query("U01_row_function")
def u01(spark, d):
    """True NFKD has no built-in: an Arrow function over whole columns."""
    import unicodedata

    @F.pandas_udf("string")
    def ascii_name(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().casefold())

    return table(spark, d, "documents").select("doc_id", F.length(ascii_name("text")).cast("long").alias("plain_chars"))


@query("U02_custom_aggregate", "SELECT supp, round(quantile_cont(qty, 0.5), 4) AS mid, max(qty) - min(qty) AS span FROM steps GROUP BY supp")
def u02(spark, d):
    return steps(spark, d).groupBy("supp").agg(F.round(F.percentile("qty", 0.5), 4).alias("mid"), (F.max("qty") - F.min("qty")).alias("span"))


@query("U03_group_function", "SELECT key, count(*) AS n, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS ups FROM (SELECT key, cents - lag(cents) OVER (PARTITION BY key ORDER BY us, seq) AS d FROM tape) GROUP BY key")
def u03(spark, d):
    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "seq"])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [len(pdf)], "ups": [int((pdf["cents"].diff() > 0).sum())]})

    return tape(spark, d).select("key", "us", "seq", "cents").groupBy("key").applyInPandas(whole, "key long, n long, ups long")


@query("U04_table_function", "SELECT grp, step, CAST(unnest(range(1, qty // 10 + 1)) AS BIGINT) AS level FROM steps WHERE step = 1 AND qty >= 10")
def u04(spark, d):
    s = steps(spark, d).where("step = 1 AND qty >= 10")
    return s.select("grp", "step", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("qty") / 10))).alias("level"))


@query("U05_pluggable_value", "SELECT grp, step, round(qty / 50.0 - disc / 10.0, 4) AS edge_a, round(0.5 - disc / 10.0, 4) AS edge_b FROM steps")
def u05(spark, d):
    """The fair value is a Column that the caller passes."""
    edge = lambda fair: F.round(fair - F.col("disc") / 10, 4)
    return steps(spark, d).select("grp", "step", edge(F.col("qty") / 50).alias("edge_a"), edge(F.lit(0.5)).alias("edge_b"))


@query("U07_injected_clock", "SELECT fact, 11000 - day AS age, 11000 - day BETWEEN 0 AND 365 AS recent FROM facts")
def u07(spark, d):
    """Now is an argument, as a literal column."""
    now = F.lit(11000).cast("long")
    return facts(spark, d).select("fact", (now - F.col("day")).alias("age"), (now - F.col("day")).between(0, 365).alias("recent"))
