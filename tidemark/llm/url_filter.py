"""URL filter by a Bloom filter cascade (built-in functions only).

Level 1 is a Bloom filter of the listed keys.  Run over the corpus's complete key
universe it admits some unlisted keys; level 2 encodes those, level 3 the listed
keys that level 2 admits, and so on until a level admits nothing wrong.  Over that
universe membership is then exact, and judging a url is arithmetic on a few words
of bits: no join, no lookup table.

Scale: the universe is scanned once for the levels' sizes and once for the false
positives of level 1; only those (about 1.4 for each listed key, whatever the
universe) are gathered further.  The filters take about 1.44 * log2(unlisted keys /
listed keys) bits for a listed key; their size is checked against MAX_WORDS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 64 bits in one level at most (8 MB); a longer list is to be split by host.
MAX_WORDS = 1 << 20
#: (host, path, verdict)
DEFAULT_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    seed: int

    def admits(self, key: Column) -> Column:
        # One literal, which the optimizer reads once: an array of literals is slow to plan.
        bits, table = 64 * len(self.words), F.from_json(F.lit(str(list(self.words))), "array<bigint>")
        test = lambda at: F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
        return F.forall(F.array(*_places(key, self.hashes, bits, self.seed)), test)


def _places(key: Column, hashes: int, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits)) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: exact there; elsewhere a Bloom filter's answer."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.admits(key), answer).otherwise(F.lit(n % 2 == 1))
        return answer


def _fit(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes = max(1, min(16, round(-math.log2(rate))))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    if words > MAX_WORDS:
        raise ValueError(f"{n} keys need {words} words in one Bloom filter; {MAX_WORDS} are allowed")
    at = keys.select(F.explode(F.array(*_places(F.col("key"), hashes, 64 * words, seed))).alias("at"))
    word = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    found = {r["word"]: r["bits"] for r in word.collect()}  # at most MAX_WORDS rows
    return Level(tuple(found.get(i, 0) for i in range(words)), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
    """listed, universe: column key.  Listed keys outside the universe do no harm;
    null keys count for nothing; an empty list gives a cascade that admits nothing."""
    listed = materialize(listed.where("key IS NOT NULL").distinct(), "listed")
    n = listed.count()
    if not n:
        return Cascade(())
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, n * math.sqrt(2) / max(total, 1))
    levels = [_fit(listed, n, rate, 0)]
    # The false positives of level 1, made distinct before they are compared with the list.
    wrong = universe.where(levels[0].admits(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
    wrong = materialize(wrong, "wrong")
    ours, other = listed, wrong
    while (m := other.count()) and len(levels) < max_levels:
        levels.append(_fit(other, m, 0.5, len(levels)))
        ours, other = other, ours.where(levels[-1].admits(F.col("key")))
        other = materialize(other, f"wrong{len(levels)}")
    if m:
        raise ValueError(f"{m} keys are still admitted wrongly after {max_levels} levels")
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or end, A-Z lower-cased) and path (then up
    to ? # or end); both empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)://(.*)", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _candidates(rules) -> Column:
    """Keys that could be rules for a url, longest first: host suffixes on label borders
    with the path's first characters, for the label counts and path lengths that rules have."""
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    each = [
        F.when((F.length("path") >= n) & (F.col("host") != ""), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k in labels
        for n in lengths
    ]
    keys = F.array_distinct(F.array_compact(F.array(*each)))
    return F.transform(F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))), lambda x: x["key"])


def filter_urls(pages: DataFrame, rules=DEFAULT_RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict added.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path
    starts with the rule's; the longest wins.  No rule: default.  Columns of pages
    with those names are replaced.  Nulls, odd urls and empty tables are fine; repeated rows come
    out as often as they go in; of a very long url only its candidates, at most one for each length of a rule, are keys."""
    if not all(h and p.startswith("/") for h, p, _ in rules):
        raise ValueError("a rule needs a host and a path that starts with /")
    spark = pages.sparkSession
    base = pages.drop("host", "path", "rule", "verdict", "_candidates")
    host, path = url_parts(F.col(url_col))
    parts = base.withColumns({"host": host, "path": path}).withColumn("_candidates", _candidates(rules))
    universe = parts.select(F.explode("_candidates").alias("key"))
    schema = "key string"
    cascade = {v: build_cascade(spark.createDataFrame([(h + p,) for h, p, x in rules if x == v], schema), universe) for v in ("block", "allow")}
    hits = {v: F.filter("_candidates", c.contains) for v, c in cascade.items()}
    best = {v: F.get(x, F.lit(0)) for v, x in hits.items()}
    longer = F.length(F.coalesce(best["block"], F.lit(""))) > F.length(F.coalesce(best["allow"], F.lit("")))
    rule = F.when(longer, best["block"]).otherwise(best["allow"])
    verdict = F.when(rule.isNull(), F.lit(default)).when(longer, F.lit("block")).otherwise(F.lit("allow"))
    return parts.withColumns({"rule": rule, "verdict": verdict}).drop("_candidates")
