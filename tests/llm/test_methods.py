"""What the methods promise beneath their results: kernel ridge regression, the corrected risk, ORC's inner parts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lang_id, token_orc, toxicity
from tidemark.llm.common import scratch_path
from tidemark.llm.queries import tokenizer_path


def test_nystrom_with_all_rows_is_kernel_ridge_regression():
    """Scores by the dual form, from a kernel matrix of shared n-grams over all rows."""
    r = np.random.default_rng(0)
    draw = lambda low, n: np.unique(r.integers(low, low + 90, n)).astype(np.int32)
    texts = [draw(40 * (k % 3), 25 + k % 9) for k in range(45)]
    labels = [("aa", "bb", "cc")[k % 3] for k in range(45)]
    model = lang_id.train(texts, labels, landmarks=3 * len(texts))
    new = [draw(40 * (k % 3), 30) for k in range(20)]
    kernel = lambda a, b: np.array([[len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    whole, n = kernel(texts, texts), len(texts)
    mid = np.eye(n) - 1 / n
    target = np.where(np.array(labels)[:, None] == np.array(["aa", "bb", "cc"]), 1.0, -1.0)
    weight = np.full(n, 3 / n)
    mean = (weight[:, None] * target).sum(0) / weight.sum()
    dual = np.linalg.solve(weight[:, None] * (mid @ whole @ mid) + lang_id.RIDGE * 3 / 100 * np.eye(n), weight[:, None] * (target - mean))
    # A text outside the model's n-grams is shorter to the kernel by the root of its own number of n-grams only.
    want = ((kernel(new, texts) - whole.mean(0)) @ mid) @ dual + mean
    got = model.kernel(new) @ model.coefficients + model.bias
    assert got == pytest.approx(want, abs=2e-3)


def test_language_ties_and_long_texts(spark):
    """Of equal scores the language that comes first by name; a text of a million letters is one text."""
    model = lang_id.train([np.array([1, 2], np.int32), np.array([1, 2], np.int32)], ["b", "a"])
    assert model.predict([np.array([1, 2], np.int32)])[0] == ["a"]
    rows = [(i, ("the house and the street " if i % 2 else "das Haus und die Straße ") * 5, "en" if i % 2 else "de") for i in range(40)] + [(100, "das Haus und die Straße " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.predict(docs, lang_id.fit(docs)).collect()}
    assert got[100] == "de" and got[1] == "en"


def risk(w, b, texts, positive, prior, loss):
    z = np.array([b + w[t].sum() for t in texts])
    zero, one = loss(z), loss(-z)
    return prior * one[positive].mean() + max(0.0, zero[~positive].mean() - prior * zero[positive].mean()) + toxicity.DECAY / 2 * (w @ w)


def sample(seed, n=400, features=12):
    r = np.random.default_rng(seed)
    toxic = r.random(n) < 0.25
    texts = [np.flatnonzero(r.random(features) < np.where(np.arange(features) < 4, 0.7 if t else 0.2, 0.4)) for t in toxic]
    return texts, toxic & (r.random(n) < 0.5)


def test_training_finds_the_least_corrected_risk():
    """Against descent along finite differences of the risk, with the logistic loss throughout."""
    texts, positive = sample(1)
    loss = lambda z: np.logaddexp(0, z)
    w, b = toxicity.train(texts, positive, 0.25, 12, steps=900, warm=900)
    x = np.append(w, b)
    value = lambda x: risk(x[:-1], x[-1], texts, positive, 0.25, loss)
    y, least = np.zeros(13), value(np.zeros(13))
    for k in range(600):  # smaller steps in the end, for the corner where the risk of label 0 is zero
        y = y - (1 - k / 601) * np.array([(value(y + e) - value(y - e)) / 2e-5 for e in 1e-5 * np.eye(13)])
        least = min(least, value(y))
    assert value(x) < least + 5e-3 < value(np.zeros(13))


def test_the_risk_of_unlabelled_texts_does_not_go_below_zero():
    """Few texts and many features: without the correction the risk would fall without end."""
    r = np.random.default_rng(2)
    texts = [np.array([k, 60 + k % 3]) for k in range(60)]
    positive = np.arange(60) % 2 == 0
    w, b = toxicity.train(texts, positive, 0.3, 63)
    loss = lambda z: 1 / (1 + np.exp(-z))
    z = np.array([b + w[t].sum() for t in texts])
    assert loss(z)[~positive].mean() - 0.3 * loss(z)[positive].mean() > -0.1 and np.isfinite(w).all() and r is not None


def test_toxicity_of_very_long_texts(spark):
    rows = [(i, "vile nasty words here" if i % 4 == 0 else f"calm and plain text number {'abcdefgh'[i % 8]}") for i in range(200)] + [(1000, "calm plain " * 100_000 + "vile nasty"), (1001, "calm " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 2)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got[1000] > got[1001] and got[4] > 0.3 and got[4] > got[1]


def test_orc_stripes_row_indexes_bloom_filters_and_encodings(spark):
    """As the files' own footers tell them."""
    path = scratch_path(spark, "orc")
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"), F.repeat(F.lit("more "), 40)).alias("text"))
    token_orc.write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"), partitions=2)
    jvm = spark.sparkContext._jvm
    folder, seen = path.removeprefix("file:"), 0
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".orc")):
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        rows = reader.rows()
        for stripe in reader.getStripes():
            seen += stripe.getNumberOfRows()
            footer = rows.readStripeFooter(stripe)
            streams = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
            kinds = [c.getKind().toString() for c in footer.getColumnsList()]
            # Columns: 0 the row, 1 doc_id, 2 ids, 3 their elements, 4 n_tokens.
            assert {("ROW_INDEX", c) for c in range(5)} <= streams and ("BLOOM_FILTER_UTF8", 1) in streams
            assert not any(k == "BLOOM_FILTER_UTF8" and c in (3, 4) for k, c in streams)
            assert kinds[1:] == ["DIRECT_V2"] * 4  # run-length encoding of the second version
        rows.close()
    assert seen == 5000
    assert token_orc.read_tokens(spark, path, [7, 4321]).count() == 2
