"""Queries E01 to E22: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import facts, steps, table, tape
from .registry import query


@query("E01_plain_names", "SELECT DISTINCT p_name AS name, regexp_replace(trim(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' (team|gaming|esports|club)$', '') AS plain, lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS letters FROM part")
def e01(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name"), S.plain_name("p_name").alias("plain"), S.letters("p_name").alias("letters")).distinct()


@query("E02_name_similarity", "WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS a, p_type AS t FROM part) SELECT a, t, CASE WHEN lower(a) = lower(t) THEN 2 WHEN least(length(a), length(t)) >= 4 AND (contains(lower(a), lower(t)) OR contains(lower(t), lower(a))) THEN 1 ELSE 0 END AS score, CAST(levenshtein(lower(a), lower(t)) AS INT) AS distance FROM n")
def e02(spark, d):
    n = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("a"), F.col("p_type").alias("t")).distinct()
    return n.select("a", "t", S.name_score(F.lower("a"), F.lower("t")).alias("score"), F.levenshtein(F.lower("a"), F.lower("t")).alias("distance"))


@query("E03_path_keys", r"SELECT page_id, lower(regexp_replace(replace(regexp_extract(url, '^[^?#]*'), '/', '\'), '\\+', '/', 'g')) AS key FROM pages")
def e03(spark, d):
    slashed = F.translate(F.regexp_extract("url", "^[^?#]*", 0), "/", "\\")
    return table(spark, d, "pages").select("page_id", S.path_key(slashed).alias("key"))


@query("E04_regex_fields", "SELECT page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, CASE WHEN url LIKE '%utm_%' THEN 'feed' WHEN url LIKE '%page=%' THEN 'paged' WHEN regexp_matches(url, '[.]html$') THEN 'file' ELSE 'plain' END AS form FROM pages")
def e04(spark, d):
    u = F.col("url")
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("bigint")
    form = F.when(u.contains("utm_"), "feed").when(u.contains("page="), "paged").when(u.rlike("[.]html$"), "file").otherwise("plain")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"), number.alias("number"), form.alias("form"))


@query("E05_set_keys", "WITH g AS (SELECT grp, list(CAST(part AS VARCHAR)) AS m FROM steps GROUP BY grp) SELECT grp, CASE WHEN len(m) = 4 AND len(list_distinct(m)) = 4 THEN array_to_string(list_sort(m), ',') END AS key FROM g")
def e05(spark, d):
    g = steps(spark, d).groupBy("grp").agg(F.array_join(F.collect_list(F.col("part").cast("string")), ", ").alias("m"))
    return g.select("grp", S.set_key("m", 4).alias("key"))


@query("E06_buckets", "SELECT CASE WHEN cents < 1000 THEN 'tiny' WHEN cents < 5000 THEN 'low' WHEN cents < 10000 THEN 'mid' ELSE 'high' END AS size, CASE WHEN k < 33 THEN 'a' WHEN k < 66 THEN 'b' ELSE 'c' END AS band, count(*) AS n FROM tape GROUP BY ALL")
def e06(spark, d):
    return tape(spark, d).groupBy(S.bucket("cents", [1000, 5000, 10000], ["tiny", "low", "mid", "high"]).alias("size"), S.bucket("k", [33, 66], ["a", "b", "c"]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("E07_era", "SELECT fact, CASE WHEN day >= 11000 THEN 'third' WHEN day >= 10400 THEN 'second' WHEN day >= 9700 THEN 'first' ELSE 'before' END AS era FROM facts")
def e07(spark, d):
    return facts(spark, d).select("fact", S.bucket("day", [9700, 10400, 11000], ["before", "first", "second", "third"]).alias("era"))


@query("E08_content_hash", """SELECT grp, step, sha256('{"cents":' || cents || ',"part":' || part || ',"qty":' || qty || '}') AS key FROM steps""")
def e08(spark, d):
    return steps(spark, d).select("grp", "step", S.content_key("qty", "part", "cents").alias("key"))


@query("E09_book_scalars", "SELECT grp, step, (qty + disc) / 2.0 AS mid, qty - disc AS spread, round((disc * supp + qty * part) / nullif(part + supp, 0), 6) AS micro, round((part - supp) * 1.0 / nullif(part + supp, 0), 6) AS obi FROM steps")
def e09(spark, d):
    q, x = F.col("qty"), F.col("disc")
    return steps(spark, d).select("grp", "step", ((q + x) / 2).alias("mid"), (q - x).alias("spread"), F.round(S.microprice("disc", "qty", "part", "supp"), 6).alias("micro"), F.round(S.imbalance("part", "supp"), 6).alias("obi"))


@query("E10_walk_book", """
WITH l AS (SELECT grp, step, cents / 100.0 AS price, qty AS size, coalesce(sum(qty) OVER (PARTITION BY grp ORDER BY cents, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM steps)
SELECT grp, CASE WHEN sum(size) >= 60 THEN round(sum(price * greatest(0, least(size, 60 - taken))), 2) END AS cost FROM l GROUP BY grp""")
def e10(spark, d):
    levels = F.array_sort(F.collect_list(F.struct((F.col("cents") / 100).alias("price"), "step", F.col("qty").alias("size"))))
    return steps(spark, d).groupBy("grp").agg(levels.alias("levels")).select("grp", F.round(S.walk_book("levels", F.lit(60)), 2).alias("cost"))


@query("E11_fees", "SELECT seq, round(0.02 * (k / 100.0) * (1 - k / 100.0), 6) AS fee, round(cents - 0.001 * cents - (CASE WHEN k % 5 = 0 THEN NULL ELSE 0.0005 END) * cents, 4) AS net FROM tape")
def e11(spark, d):
    rate = F.when(F.col("k") % 5 == 0, None).otherwise(0.0005)
    return tape(spark, d).select("seq", F.round(S.fee(F.col("k") / 100, 0.02), 6).alias("fee"), F.round(F.col("cents") - 0.001 * F.col("cents") - rate * F.col("cents"), 4).alias("net"))


@query("E12_odds", "SELECT grp, step, round((1.0 / (qty + 1)) / (1.0 / (qty + 1) + 1.0 / (disc + 1)), 6) AS share, round(1 / (1 + pow(10, (part - supp) / 400.0)), 6) AS elo, round(1 / (1 + exp(-(qty - 25) / 10.0)), 6) AS sig, round(ln((qty / 51.0) / (1 - qty / 51.0)), 6) AS logit FROM steps")
def e12(spark, d):
    return steps(spark, d).select("grp", "step", F.round(S.de_vig(F.col("qty") + 1.0, F.col("disc") + 1.0), 6).alias("share"), F.round(S.elo_expected("supp", "part"), 6).alias("elo"), F.round(S.sigmoid((F.col("qty") - 25) / 10), 6).alias("sig"), F.round(S.logit(F.col("qty") / 51), 6).alias("logit"))


@query("E13_geometry", "SELECT vec_id, round(sqrt(pow(embedding[1], 2) + pow(embedding[2], 2)), 4) AS norm2, CAST(floor(embedding[1] * 10) AS BIGINT) AS cell_x, CAST(floor(embedding[2] * 10) AS BIGINT) AS cell_y, embedding[3] > 0 AND embedding[3] >= cos(radians(45)) * sqrt(pow(embedding[3], 2) + pow(embedding[4], 2)) AS facing FROM embeddings WHERE embedding IS NOT NULL")
def e13(spark, d):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyuv")])
    return e.select("vec_id", F.round(F.hypot("x", "y"), 4).alias("norm2"), F.floor(F.col("x") * 10).alias("cell_x"), F.floor(F.col("y") * 10).alias("cell_y"), S.facing(F.lit(0.0), F.lit(0.0), F.lit(0.0), "u", "v").alias("facing"))


@query("E14_transforms", "SELECT seq, round(pow(2, -k / 30.0), 6) AS w, round(ln(1 + cents), 6) AS l, round(sqrt(cents), 4) AS r, least(greatest(cents, 100), 20000) AS clipped, round(ln((k + 1.0) / 51), 6) AS ratio FROM tape")
def e14(spark, d):
    c, k = F.col("cents"), F.col("k")
    return tape(spark, d).select("seq", F.round(S.decay("k", 30.0), 6).alias("w"), F.round(F.log1p("cents"), 6).alias("l"), F.round(F.sqrt("cents"), 4).alias("r"), F.least(F.greatest(c, F.lit(100)), F.lit(20000)).alias("clipped"), F.round(F.log((k + 1.0) / 51), 6).alias("ratio"))


@query("E15_orientation", "SELECT grp, step, CASE WHEN side = 'F' THEN disc ELSE qty END AS own, CASE WHEN side = 'F' THEN qty ELSE disc END AS other, CASE WHEN side = 'F' THEN disc - qty ELSE qty - disc END AS gap FROM steps")
def e15(spark, d):
    swap = F.col("side") == "F"
    own, other = S.oriented(swap, "qty", "disc"), S.oriented(swap, "disc", "qty")
    return steps(spark, d).select("grp", "step", own.alias("own"), other.alias("other"), (own - other).alias("gap"))


@query("E16_epoch_units", "SELECT seq, CASE seq % 4 WHEN 0 THEN us // 1000000 * 1000000 WHEN 1 THEN us // 100000 * 100000 WHEN 2 THEN us // 1000 * 1000 ELSE us END AS at FROM tape")
def e16(spark, d):
    us = F.col("us")
    raw = F.when(F.col("seq") % 4 == 0, F.floor(us / 10**6)).when(F.col("seq") % 4 == 1, F.floor(us / 10**5)).when(F.col("seq") % 4 == 2, F.floor(us / 1000)).otherwise(us)
    return tape(spark, d).select("seq", S.epoch_micros(raw).alias("at"))


@query("E17_array_predicates", "SELECT grp, bool_or(part % 10 = 7) AS any_7, bool_and(qty > 5) AS all_big, list_contains(list(supp), 7) AS has_7 FROM steps GROUP BY grp")
def e17(spark, d):
    g = steps(spark, d).groupBy("grp").agg(F.collect_list("part").alias("p"), F.collect_list("qty").alias("q"), F.collect_list("supp").alias("s"))
    return g.select("grp", F.exists("p", lambda x: x % 10 == 7).alias("any_7"), F.forall("q", lambda x: x > 5).alias("all_big"), F.array_contains("s", 7).alias("has_7"))


@query("E18_taxonomy", "SELECT seq, CASE WHEN k IS NULL OR cents IS NULL THEN 'insufficient' WHEN k < 10 THEN 'thin_book' WHEN kind = 'purchase' AND cents > 5000 THEN 'aggressive_flow' WHEN k > 80 THEN 'broad_repricing' ELSE 'other' END AS shock FROM tape")
def e18(spark, d):
    k, c = F.col("k"), F.col("cents")
    return tape(spark, d).select("seq", F.when(k.isNull() | c.isNull(), "insufficient").when(k < 10, "thin_book").when((F.col("kind") == "purchase") & (c > 5000), "aggressive_flow").when(k > 80, "broad_repricing").otherwise("other").alias("shock"))


@query("E19_fair_value", "SELECT grp, step, round(1 / (1 + exp(-(0.3 * coalesce(nullif(qty, 50) - 25, 0) / 10.0 + 0.5 * (disc - 5) / 5.0 + CASE WHEN step = 1 THEN 0.2 ELSE 0 END))), 6) AS fair FROM steps")
def e19(spark, d):
    x = 0.3 * F.coalesce(F.nullif("qty", F.lit(50)) - 25, F.lit(0)) / 10 + 0.5 * (F.col("disc") - 5) / 5 + F.when(F.col("step") == 1, 0.2).otherwise(0.0)
    return steps(spark, d).select("grp", "step", F.round(S.sigmoid(x), 6).alias("fair"))


@query("E20_encodings", "SELECT grp, step, CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS flag_code, round(qty * 1.0 / nullif(qty + disc, 0), 6) AS share, nullif(disc, 0) IS NOT NULL AS present FROM steps")
def e20(spark, d):
    code = F.when(F.col("flag") == "R", 1).when(F.col("flag") == "A", 0).otherwise(-1)
    return steps(spark, d).select("grp", "step", code.alias("flag_code"), F.round(F.try_divide(F.col("qty"), F.col("qty") + F.col("disc")), 6).alias("share"), F.nullif("disc", F.lit(0)).isNotNull().alias("present"))


@query("E21_date_parts", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(count(*) AS BIGINT) AS n, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) + 1 AS span FROM orders GROUP BY ALL")
def e21(spark, d):
    o = table(spark, d, "orders")
    days = F.size(F.sequence(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate")), F.expr("interval 1 day"))).cast("bigint")
    return o.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.quarter("o_orderdate").cast("bigint").alias("q")).agg(F.count(F.lit(1)).alias("n"), days.alias("span"))


@query("E22_json_fields", "SELECT k, count(*) AS n, sum(CASE WHEN k >= 50 THEN 1 ELSE 0 END) AS big FROM tape GROUP BY k")
def e22(spark, d):
    e = table(spark, d, "events").select(F.from_json("props", "k INT, missing STRING").alias("j"))
    return e.groupBy(F.col("j.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("j.k") >= 50, 1).otherwise(0)).alias("big"))
