"""Corpus operators on small frames: brute force, round trips and odd rows.

Odd rows are nulls in any column, empty and long texts, ties, repeated rows, empty
tables and extra columns whose names clash with the operators' own.
"""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, exact_dedup, html_text, lang_id, ngram_join, packing, range_join, token_orc, toxicity, url_filter
from tidemark.llm.common import scratch_path
from tidemark.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", "   \n", "Hello world", "Hello  world", "hello world", "a b c d e f g h", "don't stop <|endoftext|> now", "éÉ ñandú Ünder 中文 😀", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).withColumns({"rid": F.lit(1), "keys": F.lit("k"), "bucket": F.lit(2), "start": F.lit(9), "length": F.lit(3), "names": F.lit("n"), "id": F.lit(0), "held_out": F.lit(True), "score": F.lit(0.1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_byte_ids_of_long_white_space():
    """The faster encoder gives up on these; ids are those of the library."""
    from tidemark.llm.byte_tokens import encoder

    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b"):
        assert encoder(BYTE)(text) == ids_of(BYTE, text)


# Packing


def test_packing_places_every_id_once(docs):
    got = packing.pack_documents(docs, BYTE, with_ids=True).toPandas()
    for i, text in enumerate(TEXTS):
        want = [*ids_of(BYTE, text), 0]
        parts = got[got.doc_id == i].sort_values("start")
        assert [x for p in parts.ids for x in p] == want and (parts.doc_tokens == len(want)).all()
        assert list(parts.start) == [0, *np.cumsum(parts.length)[:-1]]
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts.ids] == list(parts.ids_crc32)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 1024


def test_packing_plan_is_tight_and_covers_the_histogram():
    r = random.Random(0)
    hist = {n: r.randrange(1, 50) for n in range(1, 1025)}
    plan = packing.shortest_pack_first(hist)
    fill = collections.Counter()
    for length, rank, k, seq, offset in plan:
        for j in range(k):
            assert fill[seq + j] == offset
            fill[seq + j] += length
    assert collections.Counter({n: sum(p[2] for p in plan if p[0] == n) for n in hist}) == collections.Counter(hist)
    assert max(fill.values()) <= 1024 and sum(fill.values()) / (1024 * len(fill)) > 0.97
    assert len(plan) < 8 * len(hist)


def test_packing_repeated_rows_and_empty_table(docs, empty):
    twice = packing.pack_documents(docs.unionByName(docs), BYTE)
    assert twice.count() == 2 * packing.pack_documents(docs, BYTE).count()
    assert packing.pack_documents(empty, BYTE).count() == 0
    row = packing.assemble(packing.pack_documents(docs, BYTE, with_ids=True)).where(F.size("ids") != F.col("used"))
    assert row.isEmpty()


# URL filter


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://a.com/", "https://Example.com/en/x?q#f", "https://www.example.com/en/", "http://x.www.example.com/en/a", "http://notexample.com/en/", "http://a.net/fr/", "http://net/es/z", "http://a.net/de/", "http://a.com?x=/en/", "http://u@b.example.com:80/en/"]
    pages = spark.createDataFrame([(i, u, "other") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(h + p, v) for h, p, v in url_filter.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[i] == (host, path, rule, verdict)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key LIKE '%7'")
    cascade = url_filter.build_cascade(listed, universe.unionByName(universe))
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key")) != F.col("key").like("%7")).isEmpty()
    many = spark.range(200_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 10 == 3).alias("in"))
    large = url_filter.build_cascade(many.where("in"), many)
    assert many.where(large.contains(F.col("key")) != F.col("in")).isEmpty() and len(large.levels) > 1
    assert universe.where(url_filter.build_cascade(listed.limit(0), universe).contains(F.col("key"))).isEmpty()


# BPE


def test_bpe_equals_the_library(docs):
    lib = Tokenizer.from_file(WORD)
    ids = bpe.encode(docs, WORD)
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    text = {r["doc_id"]: r["text"] for r in bpe.decode(ids, WORD).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == ids_of(WORD, t)
        assert text[i] == lib.decode(got[i], skip_special_tokens=False)
    for r in bpe.digests(docs, WORD).collect():
        want = hashlib.sha256(" ".join(map(str, got[r["doc_id"]])).encode()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert (r["ids_sha256"], r["decoded_sha256"]) == want and r["n_tokens"] == len(got[r["doc_id"]])


def test_bpe_random_words():
    lib, r = Tokenizer.from_file(WORD), random.Random(2)
    encode = bpe._encoded(WORD, lambda ids, _: ids)
    for _ in range(3000):
        t = "".join(r.choice("aeiouthrsn'd19 éß中😀Σİ!?.\n\x85") for _ in range(r.randrange(1, 14)))
        assert [i for w in encode(t) for i in w] == lib.encode(t, add_special_tokens=False).ids, t


# N-gram join


def _components(texts, percent=80):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, label = [grams(t) for t in texts], list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def _near_texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", " \t", "one", "One", "a b c d", "A B C D", "a b c d e"]
    shared = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.randrange(8, 120))]
        if r.random() < 0.5:
            base = shared + base
        for _ in range(n // 6):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = _near_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"id": F.lit(1), "token": F.lit(2), "hub": F.lit(3)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(*_components(texts), strict=True))


@pytest.mark.parametrize(("docs_", "bucket", "salt"), [(3, 2000, 50_000), (5, 3, 50_000), (4, 1, 2)])
def test_ngram_join_through_every_kind_of_round(spark, monkeypatch, docs_, bucket, salt):
    """Blocks, chains of long buckets and salts: small bounds, the same components."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs_)
    monkeypatch.setattr(ngram_join, "META_DOCS", docs_)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt)
    texts = _near_texts(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts)[1]


def test_ngram_join_repeated_rows_and_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words stand here now and then"), (2, "other words stand here now and then"), (None, "a b c d e f g"), (None, "alone"), (7, "x " * 200_000), (8, "x")]
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(True, 5, 3, 5), (True, 5, 3, 5), (True, 5, 3, 2), (True, 2, 3, 2), (False, 0, 3, 5), (False, 0, 1, None), (True, 7, 1, 7), (True, 8, 1, 8)], key=str)


@pytest.mark.parametrize("size", [7, 1 << 22])
def test_ngram_shingles_of_many_texts_at_once(monkeypatch, size):
    """Cut anywhere, texts have the values they have alone, one for each different run of words."""
    monkeypatch.setattr(ngram_join, "TEXT_BYTES", size)
    texts = [*_near_texts(4)[:50], "", None, " ", "a", " A b\x0b", "\ta b c d e f ", "\u00df \u00c4 x \x1c y z q", "x " * 50, "W" * 65 + " q w " + "w" * 65 + " r s", "y" * 300_000 + " b c d e f " + "Y" * 300_000, "z" * 300_001]
    column = pa.array(["head", *texts], pa.string()).slice(1)
    got, named = list(ngram_join.shingled(column)), {}
    assert len(got) == len(texts)
    for values, text in zip(got, texts, strict=True):
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        runs = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        assert len(runs) == len(values) and (values[1:] > values[:-1]).all()
        assert next(ngram_join.shingled(pa.array([text], pa.string()))).tolist() == values.tolist()
        named[frozenset(runs)] = values.tobytes()
    assert len(set(named.values())) == len(named)


@pytest.mark.parametrize(("rare", "pairs"), [(16, 5), (2, 1000), (10**9, 1000)])
def test_ngram_overlaps_by_pairs_and_by_matrix(monkeypatch, rare, pairs):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    r = np.random.default_rng(1)
    sets = [np.unique(np.r_[r.integers(0, 9, 4), r.integers(0, 400, r.integers(0, 30))]) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (ngram_join.overlaps(sets) == want)[~np.eye(70, dtype=bool)].all() and (ngram_join.overlaps(sets, 20) == want[:20, 20:]).all()


def test_ngram_overlaps_and_forest():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 50, r.integers(0, 40))) for _ in range(20)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(20, dtype=bool)
    assert (ngram_join.overlaps(sets) == want)[apart].all() and (ngram_join.overlaps(sets, 7) == want[:7, 7:]).all()
    a, b = ngram_join.forest(np.array([5, 3, 9, 8]), np.array([3, 1, 8, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 1, 3: 1, 9: 8}


def test_ngram_join_empty_table(empty):
    assert ngram_join.similarity_components(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}
    assert got == want


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>only", "only"),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>x</a></nav><article><h1>T &amp; t</h1><p>One  two<br>three<p>four <b>bo</b>ld</article><footer>&copy;</footer></body>", "T & t One two three four bold"),
        ("<body><div class='ad'>Buy, now, this, long, long advert text with commas</div><div id=main><p>A paragraph, with commas, and enough words to score here.</p><p>And another, long enough, to be the article's text.</p></div><div class=comments><p>A reader's comment, quite long, with commas, and words.</p></div></body>", "A paragraph, with commas, and enough words to score here. And another, long enough, to be the article's text."),
        ("<article>x<script>if (a < b) '</p>'</script>y<!-- <p>no</p> --><form>q</form><aside>z</aside></article>", "xy"),
        ("<div><a href=x>menu</a></div><main><p>&#233;&lt;b&gt; &nbsp; end</p></main>", "é<b> end"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_html_query_shape(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x</p>" * 20000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert len(got) == 3 and sorted(r["n_chars"] for r in got) == [0, 0, 39999]
    assert html_text.extract(pages.limit(0)).count() == 0


LONG, SHORT = "<p>" + "a, b, c, d, e, f " + "long " * 116 + "</p>", "<p>One, two, three " + "tail " * 57 + "</p>"


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        (f"<div><section>{LONG * 2}</section><h2>Head</h2><section>{SHORT}</section></div>", ["Head", "tail"], []),
        (f"<div><section>{LONG * 20}</section><h2>Head</h2><section>{SHORT}</section></div>", ["Head", "tail"], []),
        (f"<div><section>{LONG}</section><ul><li>item</ul><table><tr><td>cell</table><blockquote>said</blockquote><pre>code</pre></div>", ["item", "cell", "said", "code"], []),
        (f"<body><ul><li><a href=/>menu</a></ul><div>{LONG}<h2>Sources</h2><ul><li><a href=/a>source</a></ul></div><ul><li><a href=/>more</a></ul></body>", ["Sources", "source"], ["menu", "more"]),
        (f"<body><div>{LONG}<ul class=share><li><a href=/>send</a></ul></div></body>", ["long"], ["send"]),
    ],
)
def test_split_articles_are_whole(page, kept, gone):
    words = set(html_text.main_text(page).split())
    assert words.issuperset(kept) and not words & set(gone)


def test_html_is_linear_on_broken_markup():
    from time import perf_counter

    for page in ("<div>" * 200_000 + "</p>" * 200_000 + "text", "<dl><dt><dl>" + "<div>" * 50_000 + "<dt>x</dt>" * 50_000):
        begun = perf_counter()
        html_text.main_text(page)
        assert perf_counter() - begun < 20


# Exact dedup


def _exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_equals_brute_force(spark, bits):
    texts = [*TEXTS, "Hello wor ld", "Helloworld", "ab" * 40, "ab" * 41, "ab " * 40, " x", "x", "abc" * 7, "abc" * 6 + "abd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"name": F.lit(1), "norm": F.lit("n"), "rid": F.lit(2)})
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df, block_chars=4 if bits == 2 else 1024, bucket_bits=bits).collect()}
    for i, (keep, size) in _exact(list(enumerate(texts))).items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", texts[i] or "")
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, size, i == keep)
        assert got[i]["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_repeated_rows_null_ids_empty(spark, empty):
    rows = [(1, "a"), (1, "a"), (2, " a"), (None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (64, 1):  # every row is a document, also where blocks share buckets
        got = exact_dedup.exact_dedup(df, block_chars=1, bucket_bits=bits).collect()
        assert len(got) == 5 and {r["keep_id"] for r in got if r["group_size"] == 4} == {2} and sum(r["group_size"] == 4 for r in got) == 4
    assert sorted((r["doc_id"] or -1, r["text"]) for r in exact_dedup.keep_one(df).collect()) == [(-1, "b"), (2, " a")]
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_range_join_with_default_parameters(spark):
    """Labels large enough for pivots, replicas and blocks, links planted across them."""
    r = np.random.default_rng(7)
    base = r.normal(size=(1100, 8))
    x = np.concatenate([base + r.normal(scale=0.12, size=base.shape) for _ in range(4)] + [base[:300], r.normal(size=(400, 8))]).astype(np.float32)
    label = np.where(np.arange(len(x)) % 12 == 11, 2, 1)
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    pivots = range_join.draw_pivots(range_join.unit_vectors(range_join.classes_of(df := spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label")), range_join.CELL_ROWS, (2 - 2 * 0.93) ** 0.5)
    assert len(pivots) == 2
    got = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in range_join.near_duplicates(df).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    m = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(m, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(m, low, len(x)).min(1))
        if (new == low).all():
            break
        low = new
    assert m.sum() > 5000 and [got[i] for i in range(len(x))] == list(zip(m.sum(1).tolist(), low.tolist(), strict=True))


# ORC


def test_token_files_round_trip(spark, docs):
    path = scratch_path(spark, "orc-test")
    token_orc.write_tokens(docs, path, BYTE, partitions=3)
    got, start = {r["doc_id"]: r for r in token_orc.token_offsets(spark, path).collect()}, 0
    for i, t in enumerate(TEXTS):
        ids = [*ids_of(BYTE, t), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [list(r["ids"]) for r in token_orc.read_tokens(spark, path, [3]).collect()] == [[*ids_of(BYTE, TEXTS[3]), 2]]
    plan = token_orc.read_tokens(spark, path, [3])._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id" in plan or "EqualTo(doc_id" in plan or "doc_id = 3" in plan
    local = path.replace("file:", "", 1)
    import glob

    files = sorted(glob.glob(f"{local}/part-*.orc"))
    assert files and all(orc.ORCFile(f).nrows > 0 for f in files)


def test_token_files_of_empty_table(spark, empty):
    path = scratch_path(spark, "orc-empty")
    token_orc.write_tokens(empty, path, BYTE)
    assert token_orc.token_offsets(spark, path).count() == 0


def test_repeated_rows_and_null_ids_stay(spark, empty):
    """Operators that give a row for each document: ids, files, language and toxicity."""
    rows = [(None, "a a"), (None, "a a"), (1, "b"), (1, "b"), (1, "c d e"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("i"), "n_tokens": F.lit("n"), "file": F.lit("f"), "row": F.lit(1), "base": F.lit(2), "grams": F.lit(3), "_id": F.lit(4), "p": F.lit(5), "lang": F.lit("en")})
    key = lambda found: sorted((r["doc_id"] or -1) for r in found)
    ids = [-1, -1, 1, 1, 1, 2]
    got = bpe.digests(df, WORD).collect()
    assert key(got) == ids and sorted(r["n_tokens"] for r in got) == sorted(len(ids_of(WORD, t)) for _, t in rows)
    assert bpe.digests(empty, WORD).count() == bpe.encode(empty, WORD).count() == 0
    path = scratch_path(spark, "orc-odd")
    token_orc.write_tokens(df, path, BYTE, partitions=2)
    got = sorted(token_orc.token_offsets(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    model = lang_id.fit(df)
    assert key(lang_id.predict(df, model).collect()) == ids and lang_id.keep_known(df, model).columns == df.columns
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert key(toxicity.score(df, model).collect()) == ids and toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.fit(empty, labels) is None and toxicity.fit(df, labels.limit(0)) is None


# Classifiers


def _languages(spark, n=240):
    r = random.Random(4)
    stems = {"aa": ["bado", "lumi", "sera", "tano", "miru"], "bb": ["krst", "vlch", "prze", "chrz", "dnes"], "cc": ["øyen", "fjær", "gård", "slår", "brød"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(stems))
        rows.append((i, " ".join(r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(r.randrange(3, 40))), lang))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "123 !!", "cc"), (n + 3, "lumi sera", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy_and_odd_texts(spark, empty):
    df = _languages(spark)
    model = lang_id.fit(df)
    got = lang_id.predict(df, model).join(df.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert set(got[got.held_out].doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    real = got[got.held_out & got.text.fillna("").str.contains("[a-zø]") & got.lang.notna()]
    assert (real.lang == real.lang_pred).mean() > 0.97
    odd = got[got.doc_id.isin([240, 241, 242])]
    assert set(odd.lang_pred) == {"und"} and (odd.score == 0).all()
    assert got.score.between(0, 1).all()
    assert lang_id.fit(empty) is None and lang_id.predict(df, None).where("lang_pred <> 'und'").isEmpty()
    assert set(lang_id.keep_known(df, model).columns) == set(df.columns)


def test_numerals_are_no_letters():
    assert all(len(lang_id.ngrams(t)) == 0 for t in ("²", "½", "Ⅷ", "①", "12 ²½Ⅷ① 34", None, ""))
    assert (lang_id.ngrams("x² y") == lang_id.ngrams("x y")).all()


def test_language_kernel_is_the_share_of_common_ngrams():
    a, b = lang_id.ngrams("abc abd"), lang_id.ngrams("abc xyz")
    model = lang_id.train([a, b], ["x", "y"], 4)
    k = model.kernel([a, b])
    assert np.allclose(k[0, 1], len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)), atol=1e-6) and np.allclose(np.diag(k), 1, atol=1e-6)


def test_toxicity_fit_finds_texts_that_start_on_the_wrong_side():
    """Toxic texts full of features that plain texts have more often: the slope must not vanish."""
    r = np.random.default_rng(1)
    positive = np.arange(4000) % 4 == 0
    toxic = positive | (r.random(4000) < 0.1)
    texts = [np.concatenate([r.choice(np.arange(10, 300), 60, replace=False), r.choice(10, 2, replace=False) if x else np.empty(0, np.int64)]) for x in toxic]
    w, b = toxicity.train(texts, positive, 0.1, 300)
    found = np.array([1 / (1 + np.exp(-b - w[t].sum())) >= toxicity.THRESHOLD for t in texts])
    assert found[toxic].mean() > 0.95 and found[~toxic].mean() < 0.01


def _toxic(spark, n=600):
    r = random.Random(5)
    words, bad = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)], ["zorgil", "zorgan", "zorgets", "plumpo"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        t = [r.choice(words) for _ in range(r.randrange(20, 60))] + ([r.choice(bad) for _ in range(3)] if toxic else [])
        r.shuffle(t)
        rows.append((i, " ".join(t)))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
        elif r.random() < 0.1:
            labels.append((i, None))
    truth = {i: int(any(w in bad for w in t.split())) for i, t in rows}
    rows += [(n, None), (n + 1, ""), (n + 2, "!!!")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_toxicity_held_out(spark, empty):
    df, labels, truth = _toxic(spark)
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(got[600 + i]["predicted"] == 0 for i in range(3))
    assert toxicity.fit(df, labels.where("toxic = 0")) is None
    assert toxicity.score(df, None).where("score > 0").isEmpty() and toxicity.score(empty, model).count() == 0
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() < df.count()


# Range join


def _vectors(spark):
    r = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        for c in range(12):
            base = r.normal(size=8)
            for _ in range(6):
                rows.append((len(rows), [float(x) for x in base + r.normal(size=8) * r.choice([0.02, 0.12])], label))
    rows += [(len(rows) + i, v, 0) for i, v in enumerate([None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0, None] + [0.0] * 6, [float("inf")] * 8, [], rows[0][1], rows[0][1], [2 * x for x in rows[0][1]], [1.0] * 4])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"unit": F.lit(1), "copies": F.lit(2), "cell": F.lit(3)})


@pytest.mark.parametrize("cell_rows", [4000, 12])
def test_range_join_equals_brute_force(spark, cell_rows):
    rows, df = _vectors(spark)
    got = {r["vec_id"]: r for r in range_join.near_duplicates(df, cell_rows=cell_rows, block_rows=7).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in rows}
    link = {i: {j for j in ok if j != i and i in ok and label[i] is not None and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.93} for i, _, _ in rows}
    for i in link:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(link[i]), min(seen), min(seen) == i)
    assert range_join.near_duplicates(df.limit(0)).count() == 0


def test_range_join_of_repeated_ids(spark):
    """A row out for each row in, from its own vector and label."""
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.999, 0.01]
    rows = [(5, a, 1), (5, b, 1), (7, a, 1), (5, a, 2), (9, c, 2), (5, b, 2), (5, b, 2), (None, a, 3), (None, a, 3), (4, c, 3), (5, None, 1), (6, [0.0, 0.0], None)]
    got = range_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cid": F.lit(1), "v": F.lit("v")})).collect()
    want = [(5, 1, 5), (5, 0, 5), (7, 1, 5), (5, 1, 5), (9, 1, 5), (5, 1, 5), (5, 1, 5), (None, 2, 4), (None, 2, 4), (4, 2, 4), (5, 0, 5), (6, 0, 6)]
    assert sorted(map(tuple, ((r["vec_id"], r["n_links"], r["component_id"]) for r in got)), key=str) == sorted(want, key=str)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
