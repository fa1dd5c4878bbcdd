"""Ratings, entity effects, frozen pipelines and walk-forward votes against plain forms."""

import json
import math
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.operators import effects, frozen
from tidemark.plans import models, registry


def _contests(seed, n=140):
    """day, entity, rival, won, series; a month's contests of two are a series."""
    r, out = random.Random(seed), []
    for _ in range(n):
        day, (a, b) = r.randrange(100), r.sample(range(6), 2)
        out.append((day, a, b, r.random() < 0.5, (min(a, b), max(a, b), day // 30)))
    return sorted(out)


def _passed(step, contests):
    state, out = None, []
    for c in contests:
        state, made = step(state, *c)
        out.append(made)
    return out


def test_own_series_is_left_out_of_ratings():
    """Every chance by a replay of all earlier days without the contest's series."""
    contests = _contests(1)
    got = [p for (p,) in _passed(models.rate_without_series, contests)]
    for (day, a, b, _, series), p in zip(contests, got):
        rating = {}
        for _, some in groupby([c for c in contests if c[0] < day and c[4] != series], key=lambda c: c[0]):
            before = dict(rating)
            for _, x, y, won, _ in some:
                move = 24 * (won - 1 / (1 + 10 ** ((before.get(y, 1500) - before.get(x, 1500)) / 400)))
                rating[x], rating[y] = rating.get(x, 1500) + move, rating.get(y, 1500) - move
        assert p == pytest.approx(1 / (1 + 10 ** ((rating.get(b, 1500) - rating.get(a, 1500)) / 400)), abs=1e-12)


def test_no_result_of_a_series_moves_its_later_contests():
    contests = _contests(2)
    turned = contests[40][4]
    other = [(d, a, b, won != (s == turned), s) for d, a, b, won, s in contests]
    for (d, a, b, won, s), (p,), (q,) in zip(contests, _passed(models.rate_without_series, contests), _passed(models.rate_without_series, other)):
        assert s != turned or p == q


def test_ratings_without_own_series_over_the_table(spark):
    got = {r["fact"]: r["p"] for r in registry.QUERIES["M20_without_own_series"](spark, "/root/testdata/sf0.001").collect()}
    with_own = {r["fact"]: r["p"] for r in registry.QUERIES["M20_elo_by_pool"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == with_own.keys() and all(0 < p < 1 for p in got.values())
    assert sum(got[k] == with_own[k] for k in got) > len(got) / 2


def test_volatility_of_the_published_example():
    """Three games of a player of 1500, deviation 200 and volatility 0.06."""
    games = [((r - 1500) / models.SCALE, d / models.SCALE, s) for r, d, s in ((1400, 30, 1.0), (1550, 100, 0.0), (1700, 300, 0.0))]
    mean, spread, volatility = models.after_period(0.0, 200 / models.SCALE, 0.06, games)
    assert (round(1500 + models.SCALE * mean, 2), round(models.SCALE * spread, 2), round(volatility, 5)) == (1464.05, 151.52, 0.06)
    assert volatility == pytest.approx(0.05999, abs=1e-5)


def test_volatility_grows_with_surprise_and_is_a_root():
    calm, wild = (models.new_volatility(0.5, 1.0, d, 0.06) for d in (0.1, 6.0))
    assert calm < 0.06 < wild
    for d, vol in ((0.1, calm), (6.0, wild)):
        x = math.log(vol**2)
        e = math.exp(x)
        assert abs(e * (d**2 - 0.25 - 1 - e) / (2 * (1.25 + e) ** 2) - (x - math.log(0.06**2)) / 0.25) < 1e-5


def test_volatility_over_contests():
    """Two contests of one day see the same ratings; a winner of upsets becomes volatile."""
    rows = [(0, 1, 2, True), (0, 1, 3, True)] + [(10 * k, 1, 2, True) for k in range(1, 9)] + [(90 + 10 * k, 1, 2, False) for k in range(6)]
    got = _passed(models.rate_with_volatility, rows)
    assert got[0] == got[1] == (0.5, models.STEADY) and got[9][0] > 0.8 and got[-1][1] > got[9][1]


def test_entity_effects_equal_the_dense_fit(spark):
    r = np.random.default_rng(1)
    skill = r.normal(size=12)
    rows = []
    for _ in range(1500):
        e, q, x = int(r.integers(0, 12) ** 2 // 12), float(r.normal(3, 2)), float(r.integers(0, 9))
        rows.append((f"e{e}", q, x, float(r.random() < 1 / (1 + math.exp(-(0.3 * q - 0.1 * x + skill[e]))))))
    df = spark.createDataFrame(rows, "entity string, q double, x double, y double")
    dense = Pipeline(stages=[StringIndexer(inputCol="entity", outputCol="i", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol="i", outputCol="o", dropLast=False), VectorAssembler(inputCols=["q", "x", "o"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol="y", regParam=0.05, maxIter=300, tol=1e-12)]).fit(df)
    found, common = effects.entity_effects(df.union(spark.createDataFrame([("e1", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], df.schema)), "entity", ["q", "x"], "y", 0.05)
    beta = dense.stages[-1].coefficients.toArray()
    assert common["intercept"] == pytest.approx(dense.stages[-1].intercept, abs=1e-4)
    assert [common["q"], common["x"]] == pytest.approx(beta[:2].tolist(), abs=1e-4)
    got = {x["entity"]: x["effect"] for x in found.collect()}
    assert got.keys() == set(dense.stages[0].labels)
    assert [got[n] for n in dense.stages[0].labels] == pytest.approx(beta[2:].tolist(), abs=1e-4)


def test_entity_effects_of_no_rows(spark):
    found, common = effects.entity_effects(spark.createDataFrame([], "e string, q double, y double"), "e", ["q"], "y", 0.1)
    assert found.count() == 0 and common == {"intercept": 0.0, "q": 0.0}


@pytest.fixture
def fitted(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 6).alias("week"), (F.col("id") * 1.5).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") * 2.0 + 1).alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", regParam=0.1)]).fit(rows.where("week < 3"))
    frozen.freeze(model, rows.where("week < 3"), ["a", "b"], "week", f"{tmp_path}/frozen")
    return rows, model, f"{tmp_path}/frozen"


def test_a_frozen_model_scores_as_it_did(spark, fitted):
    rows, model, path = fitted
    again = frozen.Frozen(spark.newSession(), path)
    later = rows.where("week >= 3")
    score = lambda df: sorted((r["a"], r["prediction"]) for r in df.collect())
    assert score(again.apply(later)) == score(model.transform(later))
    again.check_fit(rows.where("week < 3").repartition(5))


def test_a_frozen_model_is_not_fitted_or_used_on_other_rows(spark, fitted):
    rows, _, path = fitted
    again = frozen.Frozen(spark, path)
    with pytest.raises(Exception, match="time that the model was fitted on"):
        again.apply(rows).collect()
    with pytest.raises(ValueError, match="columns that are not those of the fit: a$"):
        again.apply(rows.withColumn("a", F.col("a").cast("float")))
    with pytest.raises(ValueError, match="fit: b$"):
        again.apply(rows.drop("b"))
    with pytest.raises(ValueError, match="acceptance"):
        again.check_fit(rows)
    with pytest.raises(ValueError, match="not the rows of the fit"):
        again.check_fit(rows.where("week < 3").withColumn("a", F.col("a") + 1))
    with pytest.raises(Exception, match="(?i)exist"):
        frozen.freeze(again.model, rows, ["a", "b"], "week", path)


def test_a_tampered_manifest_or_model_stops(spark, fitted, tmp_path):
    rows, _, path = fitted
    row = spark.read.schema("fields string, seal string").json(f"{path}/manifest").first()
    fields = json.loads(row["fields"]) | {"until": 9}
    spark.createDataFrame([(json.dumps(fields, sort_keys=True), row["seal"])], "fields string, seal string").write.mode("overwrite").json(f"{path}/manifest")
    with pytest.raises(ValueError, match="not as it was sealed"):
        frozen.Frozen(spark, path)
    other = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", regParam=0.2)]).fit(rows.where("week < 3"))
    frozen.freeze(other, rows.where("week < 3"), ["a", "b"], "week", f"{tmp_path}/second")
    other.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([tuple(row)], "fields string, seal string").write.mode("overwrite").json(f"{path}/manifest")
    with pytest.raises(ValueError, match="not the one of its manifest"):
        frozen.Frozen(spark, path)


def test_votes_come_from_strictly_earlier_groups(spark):
    """Each day's model by least squares over all earlier steps, one fit a day."""
    from tidemark.sources.tables import facts, steps

    sf = "/root/testdata/sf0.001"
    got = {r["grp"]: r for r in registry.QUERIES["C22_head_to_head"](spark, sf).collect()}
    day = {r["fact"]: r["day"] for r in facts(spark, sf).collect()}
    rows = [(day[r["grp"]], r["grp"], r["qty"], r["disc"], int(r["win"])) for r in steps(spark, sf).collect() if r["grp"] in day]
    x = np.array([(1.0, r[2], r[3]) for r in rows])
    y, d, g = (np.array([r[k] for r in rows]) for k in (4, 0, 1))
    assert len(got) > 500
    for grp in sorted(got)[::40]:
        early, here = d < day[grp], g == grp
        beta = np.linalg.lstsq(x[early], y[early], rcond=None)[0]
        p = x[here] @ beta - y[early].mean()
        assert (got[grp]["steps"], got[grp]["votes"]) == (here.sum(), (p > 0).sum()) or np.abs(p).min() < 1e-9
        assert got[grp]["predicted"] == (2 * got[grp]["votes"] > here.sum()) and got[grp]["actual"] == bool(y[here].mean() > y[early].mean())
