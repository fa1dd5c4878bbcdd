"""Queries that fit models: held against numpy fits of the same objective, or what must hold of their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.plans import models, registry
from tidemark.sources.tables import steps, tape

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def logistic(x, y, weight=None, reg=0.01, intercept=True):
    """Newton's method for the mean weighted loss and reg / 2 times the squared coefficients; the intercept is free."""
    w = np.ones(len(y)) if weight is None else weight
    w = w / w.sum()
    x = np.column_stack([x, np.ones(len(y))]) if intercept else x
    pull = np.full(x.shape[1], reg)
    if intercept:
        pull[-1] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (w * (y - p)) - pull * beta)
    return beta


def scaled(train, *more, mean=True):
    """Columns less the training rows' mean, over their sample deviation."""
    m, s = (train.mean(0) if mean else 0), train.std(0, ddof=1)
    return [(x - m) / s for x in (train, *more)]


def chance(x, beta):
    return 1 / (1 + np.exp(-(x @ beta[: x.shape[1]] + (beta[x.shape[1]] if len(beta) > x.shape[1] else 0))))


@pytest.fixture(scope="module")
def orders(spark):
    return models._orders(spark, SF).orderBy("fact").toPandas()


def split(orders, cut, columns):
    train, test = orders[orders.day < cut], orders[orders.day >= cut]
    a, b = scaled(train[columns].to_numpy(float), test[columns].to_numpy(float))
    return train, test, a, b


def test_weighted_logistic(spark, orders):
    o = orders
    names = sorted(o["class"].unique(), key=lambda c: (-(o[o.day < 11000]["class"] == c).sum(), c))
    x = np.column_stack([o.form, o.price, *[(o["class"] == c).astype(float) for c in names]])
    old = (o.day < 11000).to_numpy()
    a, b = scaled(x[old], x[~old], mean=False)
    beta = logistic(a, o.y[old].to_numpy(), 0.5 ** ((11600 - o.day[old]) / 900).to_numpy(), intercept=False)
    got = {r["fact"]: r["p"] for r in run(spark, "M05_weighted_logistic")}
    assert [got[f] for f in o.fact[~old]] == pytest.approx(chance(b, beta).tolist(), abs=2e-3)


def test_mirrored_chances_add_up(spark):
    s = steps(spark, SF).select("grp", "step", F.col("qty").cast("double"), F.col("disc").cast("double"), F.col("win").cast("double").alias("y")).orderBy("grp", "step").toPandas()
    x, y, old = s[["qty", "disc"]].to_numpy(), s.y.to_numpy(), (s.grp % 4 > 0).to_numpy()
    both, one, two = scaled(np.concatenate([x[old], x[old][:, ::-1]]), x[~old], x[~old][:, ::-1])
    beta = logistic(both, np.concatenate([y[old], 1 - y[old]]), intercept=False)
    got = {(r["grp"], r["step"]): r["p"] for r in run(spark, "M06_mirrored")}
    want = (chance(one, beta) + 1 - chance(two, beta)) / 2
    assert [got[k] for k in zip(s.grp[~old], s.step[~old])] == pytest.approx(want.tolist(), abs=2e-3)


def test_boosted_isotonic_is_monotone_and_calibrated(spark, orders):
    got = sorted((r["raw"], r["p"]) for r in run(spark, "M08_boosted_isotonic"))
    assert len(got) == (orders.day >= 11000).sum() and all(b[1] >= a[1] for a, b in zip(got, got[1:])) and all(0 <= p <= 1 for _, p in got)


def test_platt_scaling(spark, orders):
    train, test, a, b = split(orders, 10600, ["form", "price"])
    p = chance(b, logistic(a, train.y.to_numpy()))
    z, mid = np.log(p / (1 - p))[:, None], (test.day < 11000).to_numpy()
    c, e = scaled(z[mid], z[~mid])
    want = chance(e, logistic(c, test.y[mid].to_numpy()))
    got = {r["fact"]: r["p"] for r in run(spark, "M09_platt")}
    assert [got[f] for f in test.fact[~mid]] == pytest.approx(want.tolist(), abs=3e-3)


def test_ridge(spark):
    s = steps(spark, SF).select("grp", "qty", "disc", "cents").toPandas()
    x, y, old = s[["qty", "disc"]].to_numpy(float), s.cents.to_numpy() / 100, (s.grp % 4 > 0).to_numpy()
    a, b = scaled(x[old], x[~old])
    spread = y[old].std(ddof=1)  # the penalty is on standardized columns and response
    beta = np.linalg.solve(a.T @ a / len(a) + np.eye(2) / spread, a.T @ (y[old] - y[old].mean()) / len(a))
    (got,) = run(spark, "M10_ridge")
    assert got["n"] == (~old).sum() and got["mae"] == pytest.approx(np.abs(y[~old] - (b @ beta + y[old].mean())).mean(), rel=2e-3)


def test_permutation_and_ablation(spark, orders):
    train, test, a, b = split(orders, 11000, ["form", "price"])
    loss = lambda p: -np.mean(np.where(test.y == 1, np.log(p), np.log(1 - p)))
    whole = chance(b, logistic(a, train.y.to_numpy()))
    form = chance(b[:, :1], logistic(a[:, :1], train.y.to_numpy()))
    dealt = {r["feature"]: r["log_loss"] for r in run(spark, "M13_permutation_importance")}
    assert dealt.keys() == {"none", "form", "price"} and dealt["none"] == pytest.approx(loss(whole), abs=2e-3)
    kept = {r["variant"]: r for r in run(spark, "M14_ablation")}
    assert kept["form"]["log_loss"] == pytest.approx(loss(form), abs=2e-3) and kept["form+price"]["log_loss"] == pytest.approx(dealt["none"], abs=1e-6)
    assert kept["form"]["brier"] == pytest.approx(np.mean((form - test.y) ** 2), abs=1e-3) and kept["form"]["n"] == len(test)


def test_stacked_and_upcoming(spark, orders):
    train, test, a, b = split(orders, 10400, ["form", "price"])
    z = np.column_stack([np.log(p / (1 - p)) for p in (chance(b[:, [k]], logistic(a[:, [k]], train.y.to_numpy())) for k in (0, 1))])
    mid = (test.day < 11000).to_numpy()
    c, e = scaled(z[mid], z[~mid])
    got = {r["fact"]: r["p"] for r in run(spark, "M15_stacked")}
    assert [got[f] for f in test.fact[~mid]] == pytest.approx(chance(e, logistic(c, test.y[mid].to_numpy())).tolist(), abs=5e-3)
    status = {r["o_orderkey"]: r["o_orderstatus"] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()}
    open_ = np.array([status[f] == "P" for f in orders.fact])
    x = orders[["form", "price"]].to_numpy(float)
    c, e = scaled(x[~open_], x[open_])
    got = {r["fact"]: r["p"] for r in run(spark, "M16_score_upcoming")}
    assert got.keys() == set(orders.fact[open_])
    assert [got[f] for f in orders.fact[open_]] == pytest.approx(chance(e, logistic(c, orders.y[~open_].to_numpy())).tolist(), abs=2e-3)


def test_multinomial_beats_chance(spark):
    (got,) = run(spark, "M17_multinomial")
    flags = steps(spark, SF).where("grp % 4 = 0").groupBy("flag").count().collect()
    assert got["n"] == sum(r["count"] for r in flags) and got["top1"] >= 0.9 * max(r["count"] for r in flags) / got["n"] and got["top1"] < got["top2"] <= 1


def test_surprise_is_the_mean_of_the_last_three_residuals(spark, orders):
    train, test, a, b = split(orders, 10400, ["form", "price"])
    got = {r["fact"]: r["surprise"] for r in run(spark, "M19_surprise_features")}
    test = test.assign(r=test.y.to_numpy() - chance(b, logistic(a, train.y.to_numpy()))).sort_values(["entity", "day", "fact"])
    want = test.groupby("entity").r.transform(lambda r: r.shift().rolling(3, min_periods=1).mean())
    for fact, w in zip(test.fact, want):
        assert (got[fact] is None) == bool(np.isnan(w)) and (got[fact] is None or got[fact] == pytest.approx(w, abs=3e-3))


def test_out_of_fold_areas(spark):
    got = {r["side"]: r["auc"] for r in run(spark, "C32_signature_folds")}
    assert got.keys() == {r["side"] for r in steps(spark, SF).select("side").distinct().collect()} and all(0.3 < a < 0.7 for a in got.values())


def test_ablations_by_stratum(spark):
    """n and the share of ordered pairs, ties half, of every variant and stratum."""
    rows = models.out_of_fold(spark, SF, models.ABLATIONS).toPandas()
    load = steps(spark, SF).groupBy("grp").agg(F.sum("qty").alias("load")).toPandas().set_index("grp").load
    rows["tier"] = ["small" if load[g] < 60 else "middle" if load[g] < 140 else "large" for g in rows.grp]
    rows["all"] = "all"
    got = {(r["variant"], r["stratum"], r["value"]): (r["n"], r["auc"]) for r in run(spark, "C32_ablations")}
    want = {}
    for stratum in ("all", "side", "tier"):
        for (variant, value), part in rows.groupby(["variant", stratum]):
            a, b = part.p[part.y == 1].to_numpy(), part.p[part.y == 0].to_numpy()
            rank = np.searchsorted(np.sort(b), a, "left") / 2 + np.searchsorted(np.sort(b), a, "right") / 2
            want[variant, stratum, value] = (len(part), rank.mean() / len(b))
    assert got.keys() == want.keys() and {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert [got[k][1] for k in want] == pytest.approx([a for _, a in want.values()], abs=1e-4)


def test_folds_read_the_input_once_and_weights_change_nothing(spark, monkeypatch):
    """Chances come from the written features, not from the input again for each model; fits on distinct rows with weights are
    those on all rows."""
    chances = []
    for weighed in (0, 10**9):
        monkeypatch.setattr(models, "WEIGHED", weighed)
        got = models.out_of_fold(spark, SF, {"all": ["q", "sig", "supp_sig"]})
        assert "lineitem" not in got._jdf.queryExecution().toString()
        chances.append({(r["grp"], r["step"]): r["p"] for r in got.collect()})
    assert chances[0].keys() == chances[1].keys() and max(abs(chances[0][k] - chances[1][k]) for k in chances[0]) < 2e-4


def test_scoring_stream_equals_the_model_on_the_table(spark):
    model = models.fit_tick_model(spark, SF)
    t = tape(spark, SF).withColumns({"x1": F.col("cents") / 100, "x2": F.col("k").cast("double")}).dropna(subset=["x1", "x2"])
    want = {r["seq"]: r["p"] for r in models._scored(model, t).select("seq", "p").collect()}
    got = {r["seq"]: r["p"] for r in run(spark, "T14_continuous_scoring")}
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx([*want.values()], abs=2e-6)


def test_bootstrap_interval_holds_the_mean_and_narrows(spark):
    r = np.random.default_rng(1)
    wide = [(1, c, float(r.normal(c % 2, 1))) for c in range(8) for _ in range(5)]
    many = [(2, c, float(r.normal(c % 2, 1))) for c in range(200) for _ in range(5)]
    got = {x["g"]: x.asDict() for x in A.cluster_bootstrap(spark.createDataFrame(wide + many, "g int, c int, v double"), ["g"], "c", "v", draws=300).collect()}
    low, high = "low", "high"
    for g, rows in ((1, wide), (2, many)):
        assert got[g][low] < np.mean([x[2] for x in rows]) < got[g][high]
    assert got[2][high] - got[2][low] < (got[1][high] - got[1][low]) / 2
    (a21,) = run(spark, "A21_paired_increment_ci")
    assert a21[low] <= a21[high]


def test_row_function(spark):
    import unicodedata

    plain = lambda t: len(unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().casefold())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, run(spark, "U01_row_function"))) == sorted((r["doc_id"], None if r["text"] is None else plain(r["text"])) for r in docs)
