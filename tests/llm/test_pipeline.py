"""The pipeline's stages take effect and odd rows pass."""

import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """sf0.001 with planted copies, odd rows and an extra column."""
    src, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{src}/documents.parquet")
    clean = docs.where("length(text) > 600 AND lang = 'en'").orderBy("doc_id").limit(3)
    copy = clean.withColumns({"doc_id": F.col("doc_id") + 100000, "text": F.concat(F.lit(" "), "text")})
    near = clean.withColumns({"doc_id": F.col("doc_id") + 200000, "text": F.concat("text", F.lit(" tail of few words"))})
    odd = spark.createDataFrame([(300001, None, None, None, None), (300002, "", "en", "s", 0), (300003, "12 34", None, None, 5)], docs.schema)
    every = docs.unionByName(copy).unionByName(near).unionByName(odd).unionByName(docs.limit(2)).withColumn("sequence_id", F.lit(1))
    every.write.parquet(f"{out}/documents.parquet")
    shutil.copy(f"{src}/labels.parquet", f"{out}/labels.parquet") if os.path.isfile(f"{src}/labels.parquet") else shutil.copytree(f"{src}/labels.parquet", f"{out}/labels.parquet")
    return out


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, small), f"test-{name}")
        if k < 4:
            assert docs.columns == columns
            kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {300001, 300002, 300003} & kept["language"]
    assert kept["toxicity"] >= kept["language"] >= kept["exact_dedup"] >= kept["ngram_join"]
    copies = {i for i in kept["language"] if 100000 <= i < 200000}
    # A copy with more white space has more code points: it stays, the shorter one goes.
    assert copies and all((i - 100000) not in kept["exact_dedup"] for i in copies if i in kept["exact_dedup"])
    groups = [[i for i in (j, j + 100000, j + 200000) if i in kept["ngram_join"]] for j in {i % 100000 for i in copies}]
    assert all(len(g) <= 1 for g in groups)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == kept["ngram_join"]


def test_run_on_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


WORDS = [f"w{i}" for i in range(400)]


def texts(n):
    """Texts of 60 words of their own."""
    return [" ".join(f"{w}x{k}" for w in WORDS[:60]) for k in range(n)]


def test_near_copies_of_repeated_and_null_ids(spark):
    """Every text keeps one row, whatever ids its rows have."""
    a, b, c, d, e = texts(5)
    docs = [(1, a), (5, a + " more"), (5, b), (6, b + " more"), (9, c), (9, c.split(" ", 1)[1]), (None, d), (2, d + " more"), (None, e), (None, e + " more"), (7, None), (7, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "component": F.lit("c"), "component_id": F.lit(2)})
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    kept = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str)
    assert len(kept) == 8 and {(1, a), (5, b), (2, d + " more"), (7, None), (7, ""), (None, None)} <= set(kept)
    assert len({(9, c), (9, c.split(" ", 1)[1])} & set(kept)) == 1 and len({(None, e), (None, e + " more")} & set(kept)) == 1


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("repeat", [False, True])
def test_near_copies_agree_with_brute_force(spark, repeat):
    r = random.Random(5)
    docs = []
    for k, text in enumerate(texts(12)):
        words = text.split()
        for _ in range(r.randrange(1, 5)):
            some = [w for w in words if r.random() > 0.02] + ["tail"] * r.randrange(3)
            docs.append((r.randrange(8) if repeat else len(docs), " ".join(some)))
    got = [(x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()]
    sets, label = [shingle_set(t) for _, t in docs], list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    for part in set(label):
        ours = [d for d, m in zip(docs, label) if m == part]
        kept = [d for d in ours if d in got]
        assert len(kept) == 1 and kept[0][0] == min(i for i, _ in ours)
    assert len(got) == len(set(label)) < len(docs)


def test_exact_and_packing_stages_agree_with_brute_force(spark):
    docs = [(3, "a b"), (1, "ab"), (2, "a  b "), (2, "other"), (2, "other"), (4, None), (5, " \n"), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = corpus_pipeline.drop_exact_copies(spark, df, "")
    assert sorted([tuple(r) for r in kept.collect()], key=str) == sorted([(2, "a  b "), (2, "other"), (5, " \n"), (None, "x")], key=str)
    packed = corpus_pipeline.pack(spark, df.where("doc_id IS NOT NULL").dropDuplicates(), "").collect()
    ids = Tokenizer.from_file(corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    want = sum(len(ids.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in set(docs) if i is not None)
    assert sum(r["length"] for r in packed) == want
