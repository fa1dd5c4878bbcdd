"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U, which holds toxic text too) train
a linear classifier on words and word beginnings.  With the class prior p the risk
is p * E_P[loss(f, 1)] + max(0, E_U[loss(f, 0)] - p * E_P[loss(f, 0)]): what toxic text in U
adds to the second term is taken off, and where that falls below zero the step goes
the other way, so the classifier can't win by overfitting P.

Scale: at most POSITIVES + UNLABELLED texts, drawn by hash, are used for the fit; which
features count is worked out by Spark over them, and at most FEATURES weights are
learnt with numpy.  Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Texts that a fit uses at most (a few more, as they are drawn by hash), and features it keeps.
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 2000
#: Texts of P in which a feature must be, and how far above its rate in U, in standard errors.
LEAST, ERRORS = 3, 4.0
#: Steps, those of them with the logistic loss, first step size (the last is a tenth) and weight decay.
STEPS, WARM, RATE, DECAY = 300, 200, 0.05, 2e-5
THRESHOLD = 0.3
#: Words whose features a worker keeps in mind.
MAX_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word, and its first four and five letters where it has more."""
    return ["=" + word, *(word[:n] for n in (4, 5) if len(word) > n)]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class ToxicityModel:
    names: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from text to score, with a bounded memory of words."""
        at, kept = {f: i for i, f in enumerate(self.names)}, {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in words(text):
                got = kept.get(w)
                if got is None:
                    if len(kept) >= MAX_WORDS:
                        kept.clear()
                    got = kept[w] = tuple(at[f] for f in features(w) if f in at)
                found.update(got)
            z = self.bias + float(self.weights[sorted(found)].sum()) if found else self.bias
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def train(texts: list[np.ndarray], positive: np.ndarray, prior: float, size: int, steps: int = STEPS, warm: int = WARM) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, averaged over the last third
    of the steps, as the risk's corner at zero keeps them moving; texts: feature numbers of each.

    The first two thirds of the steps take the logistic loss, whose slope does not vanish on P texts
    that start out far on the wrong side; the rest the bounded sigmoid loss, by which a sure P
    text can't outweigh all of U."""
    col = np.concatenate(texts) if texts else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    p, u = positive, ~positive
    mean_w, mean_b = np.zeros(size), 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(texts))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # Losses of label 0, and the slopes of both labels' losses.
        zero, up, down = (np.logaddexp(0, z), s, s - 1) if t <= warm else (s, s * (1 - s), s * (s - 1))
        rest = zero[u].mean() - prior * zero[p].mean()
        g = np.zeros(len(texts))
        if rest >= 0:
            g[p], g[u] = prior * (down - up)[p] / p.sum(), up[u] / u.sum()
        else:  # back from where the corrected risk of label 0 is negative
            g[p], g[u] = prior * up[p] / p.sum(), -up[u] / u.sum()
        gw, gb = np.bincount(col, g[row], size) + DECAY * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        rate = RATE * (1 - 0.9 * t / steps)
        w = w - rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b = b - rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
        if t > steps - steps // 3:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (steps // 3), float(mean_b / (steps // 3))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """Learn from rows whose id isn't held out; None without a toxic example.

    labels: ids and label_col (1: toxic; 0; null: unknown).  Only the 1s and, for the
    class prior, their share are used; of rows that repeat an id the largest label counts.
    Repeated rows of docs count as often as they come; empty tables give None."""
    ours = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("toxic"))
    known = ours.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not known["p"]:
        return None
    prior = float(min(0.9, known["p"] / known["n"]))
    draw = lambda key, seed, most, n: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10**9)) < int(min(1.0, most / max(n, 1)) * 1e9)
    # At most about POSITIVES ids: a broadcast of bounded size, so no text is shuffled.
    chosen = F.broadcast(ours.where((F.col("toxic") == 1) & draw(F.col("_id"), 1, POSITIVES, known["p"])).select("_id"))
    base = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    total = base.count()
    sample = base.where(draw(F.col("_id"), 2, UNLABELLED, total)).select("text", F.lit(False).alias("p"))
    sample = base.join(chosen, "_id", "left_semi").select("text", F.lit(True).alias("p")).unionByName(sample)

    def named(batches):
        for batch in batches:
            found = [sorted({f for w in words(t.as_py()) for f in features(w)}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["f", "p"])

    each = sample.mapInArrow(named, "f array<string>, p boolean")
    sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return None
    by = each.select(F.explode("f").alias("f"), "p").groupBy("f").agg(F.count_if("p").alias("np"), F.count_if(~F.col("p")).alias("nu"))
    # How many standard errors the feature's rate in P is above that in U: chance alone gives
    # few that pass, however small the sample, so plain words don't take part.
    rate = (F.col("np") + F.col("nu")) / (sizes[True] + sizes[False])
    error = F.sqrt(rate * (1 - rate) * (1 / sizes[True] + 1 / sizes[False]))
    above = F.try_divide(F.col("np") / sizes[True] - F.col("nu") / sizes[False], error)
    kept = [r["f"] for r in by.where((F.col("np") >= LEAST) & (above >= ERRORS)).orderBy(above.desc(), "f").limit(FEATURES).collect()]
    if not kept:
        return None
    at = {f: i for i, f in enumerate(kept)}

    def numbered(batches):
        for batch in batches:
            found = [sorted({at[f] for w in words(t.as_py()) for f in features(w) if f in at}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["f", "p"])

    rows = sorted((bool(r["p"]), list(r["f"])) for r in sample.mapInArrow(numbered, "f array<int>, p boolean").collect())
    weights, bias = train([np.array(f, np.int64) for _, f in rows], np.array([p for p, _ in rows]), prior, len(kept))
    return ToxicityModel(tuple(kept), weights, bias)


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts are scored
    by the bias alone, and without a model every score is 0.  Repeated rows come out as often
    as they go in; a null id is not held out; an empty table gives no rows; other columns
    are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words and weights

    def run(batches):
        of = shared.value.scorer() if shared.value else lambda _: 0.0
        for batch in batches:
            got = np.array([of(t.as_py()) for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; null and empty
    texts as score has them, repeated rows as often as they come, all without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        of = shared.value.scorer() if shared.value else lambda _: 0.0
        return pd.Series([of(t) < threshold for t in texts], index=texts.index, dtype=bool)

    return docs.where(clean(F.col(text_col)))
