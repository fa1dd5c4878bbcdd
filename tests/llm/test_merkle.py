"""The manifest against a recursive form in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, more=0):
    values = (d["doc_id"], d["source"], d["lang"], None if d["n_chars"] is None else d["n_chars"] + more, d["text"])
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """The top, and for each node its siblings and place, level by level."""
    paths, rows = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for i in run:
                for r in rows[i]:
                    paths[r].append((i - run[0], [nodes[j] for j in run if j != i]))
        nodes, rows = [H(*[nodes[i] for i in run]) for run in runs], [[r for i in run for r in rows[i]] for run in runs]
    return nodes[0], paths


def brute(docs, fanout):
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted([d for d in docs if d["lang"] == lang], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d))) for lang in langs]
    trees = [tree([leaf(d) for d in g], fanout) for g in groups]
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for group, (top, paths), path in zip(groups, trees, above, strict=True):
        for d, own in zip(group, paths, strict=True):
            proof = own + path
            at = leaf(d, d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0)
            for k, others in proof:
                at = H(*others[:k], at, *others[k:])
            out.append((d["doc_id"], leaf(d), top, root, H(*[x for _, others in proof for x in others]), at, at == root))
    return sorted(out, key=str)


def rows_of(docs):
    odd = [(None, None, None, None, None), (None, "x", None, "s", 1), (3, "twice", "en", "s", 5), (3, "twice", "en", "s", 5), (3, "", "en", "", 0), (10**12, "😀é" * 20000, "é", None, None), (8, "z", "z", "s", 1), (9, "z", "￿", "s", 1), (11, "z", "😀", "s", 1)]
    return docs + odd


@pytest.mark.parametrize(("n", "fanout", "levels"), [(70, 2, 2), (41, 3, 1), (64, 2, 9), (1, 2, 3)])
def test_manifest_agrees_with_recursion(spark, n, fanout, levels):
    rows = rows_of([(i * 7 % 1009, f"text {i}", ["en", "en", "fr", None][i % 4], f"s{i % 3}", i if i % 5 else None) for i in range(n)])
    docs = spark.createDataFrame(rows, DOCS).withColumns({"g": F.lit(1), "rank": F.lit(2), "digest": F.lit("d"), "_row": F.lit(3), "PAGE": F.lit(1)}).repartition(3)
    got = merkle.manifest(docs, fanout, levels).withColumn("p", merkle.proof_digest(F.col("proof"))).select("doc_id", "leaf", "subroot", "root", "p", "folded_root", "verified")
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows], fanout)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert {r[6] for r in want} == {True, False} or n == 1


def test_one_row_and_no_row(spark):
    one = merkle.manifest(spark.createDataFrame([(5, "a", None, None, None)], DOCS)).collect()
    assert len(one) == 1 and one[0]["proof"] == [] and one[0]["leaf"] == one[0]["root"] and one[0]["verified"]
    none = merkle.manifest(spark.createDataFrame([], DOCS), derive=lambda df: df.withColumn("p", merkle.proof_digest(F.col("proof"))))
    assert none.count() == 0 and "p" in none.columns


def test_many_equal_rows_are_leaves_of_their_own(spark):
    """A third of all rows is one row: its pages repeat, their requests still part."""
    rows = [(1, "same", "en", "s", 4)] * 40 + [(i, f"t{i}", "en", "s", 4) for i in range(2, 82)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), 2, 2).collect()
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows], 2)
    assert len(got) == 120 and {r["root"] for r in got} == {want[0][3]}
    assert sorted((r["doc_id"], merkle.fold(r["leaf"], [s.asDict() for s in r["proof"]])) for r in got) == sorted((r[0], r["root"]) for r in ({0: w[0], "root": w[3]} for w in want))
