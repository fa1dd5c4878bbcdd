"""One query for each corpus operator, and the pipeline, with DuckDB SQL where SQL can express it.

Each query runs its operator over the whole intended table and keeps integer ids and
digests; the operators themselves return texts, ids and files.
"""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, exact_dedup, html_text, lang_id, merkle, ngram_join, packing, range_join, token_orc, toxicity, url_filter
from .common import read_table, scratch_path


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: in the folder TIDEMARK_TOKENIZERS names, else the installed ones."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS verdict
      FROM q JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s) GROUP BY page_id)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(read_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm
"""


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_orc.token_offsets(spark, path)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.fit(docs))


def op9_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = lambda found: found.withColumn("proof_sha256", merkle.proof_digest(F.col("proof"))).drop("proof")
    return merkle.manifest(read_table(spark, sf_dir, "documents"), derive=digests)


OP11_SQL = """
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS n0,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS n1,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc FROM documents),
d AS (SELECT doc_id, lang, sha256(head || n0 || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || n1 || tail) ELSE sha256(head || n0 || tail) END AS found FROM f),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) AS n FROM d GROUP BY lang),
r AS (SELECT d.*, g.g, g.n, row_number() OVER (PARTITION BY g.g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
up AS (SELECT 0 AS lvl, g, rank, leaf AS digest, n FROM r
       UNION ALL SELECT lvl + 1, g, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lvl, g, rank // 2, n),
tops AS (SELECT g, digest FROM up WHERE n = 1),
over AS (SELECT 0 AS lvl, g AS rank, digest, (SELECT count(*) FROM tops) AS n FROM tops
         UNION ALL SELECT lvl + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (n + 1) // 2 FROM over WHERE n > 1 GROUP BY lvl, rank // 2, n),
walk AS (SELECT g AS top, rank AS bottom, 0 AS lvl, g, rank, found AS folded, '' AS proof, n, FALSE AS high FROM r
         UNION ALL
         SELECT w.top, w.bottom, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END, w.g, CASE WHEN w.n > 1 THEN w.rank // 2 ELSE w.g END,
                CASE WHEN w.n = 1 THEN w.folded WHEN w.rank % 2 = 0 THEN sha256(w.folded || coalesce(s.digest, t.digest, '')) ELSE sha256(coalesce(s.digest, t.digest) || w.folded) END,
                CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || coalesce(s.digest, t.digest, '') END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE (SELECT count(*) FROM tops) END, w.high OR w.n = 1
         FROM walk w LEFT JOIN up s ON NOT w.high AND w.n > 1 AND s.lvl = w.lvl AND s.g = w.g AND s.rank = xor(w.rank, 1)
              LEFT JOIN over t ON w.high AND w.n > 1 AND t.lvl = w.lvl AND t.rank = xor(w.rank, 1)
         WHERE w.n > 1 OR NOT w.high)
SELECT r.doc_id, r.leaf, tops.digest AS subroot, o.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = o.digest AS verified
FROM r JOIN tops USING (g) JOIN walk w ON w.top = r.g AND w.bottom = r.rank AND w.high AND w.n = 1 JOIN over o ON o.n = 1
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_text": op5_html_text,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_orc": op7_token_orc,
    "op8_language": op8_language,
    "op9_range_join": op9_range_join,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_nearest": op12_nearest,
    "op13_conversations": op13_conversations,
}
ORACLES = {"op2_url_filter": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op11_merkle": OP11_SQL}
