"""Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and their plain forms (fixed values, for western European names).
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def letters(x) -> Column:
    """ASCII letters of a name, in lower case."""
    return F.lower(F.regexp_replace(_c(x), "[^A-Za-z]", ""))


def name_score(a, b) -> Column:
    """2: equal names; 1: one is part of the other and has four letters at least; else 0."""
    a, b = _c(a), _c(b)
    part = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return F.when(a == b, 2).when(part, 1).otherwise(0)


def plain_name(x) -> Column:
    """Accents off, lower case, & as and, other signs as single spaces, common endings off."""
    flat = F.lower(F.translate(_c(x), *ACCENTS))
    words = F.trim(F.regexp_replace(F.regexp_replace(flat, "&", " and "), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, " (team|gaming|esports|club)$", "")


def path_key(x) -> Column:
    """Backslashes as slashes, repeated slashes as one, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(x), r"\\", "/"), "/+", "/"))


def set_key(x, size: int) -> Column:
    """Sorted members of a comma-separated list of numbers; null unless it has `size` distinct ones."""
    members = F.transform(F.split(_c(x), ","), lambda m: F.trim(m))
    good = (F.size(F.array_distinct(members)) == size) & (F.size(members) == size) & F.forall(members, lambda m: m.rlike("^[0-9]+$"))
    return F.when(good, F.array_join(F.array_sort(members), ","))


def bucket(x, cuts: list[float], names: list[str]) -> Column:
    """names[i] for the first cut that x is below; the last name from the last cut on."""
    x, out = _c(x), None
    for cut, name in zip(cuts, names, strict=False):
        out = F.when(x < cut, name) if out is None else out.when(x < cut, name)
    return F.when(x.isNotNull(), out.otherwise(names[-1]))


def epoch_micros(x) -> Column:
    """Microseconds of an epoch number in seconds, deciseconds, milliseconds or microseconds, by its size."""
    x = _c(x)
    return F.when(x < 10**10, x * 10**6).when(x < 10**11, x * 10**5).when(x < 10**14, x * 1000).otherwise(x)


def content_key(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def microprice(bid, ask, bid_size, ask_size) -> Column:
    b, a, n, m = map(_c, (bid, ask, bid_size, ask_size))
    return F.try_divide(b * m + a * n, n + m)


def imbalance(bid_size, ask_size) -> Column:
    n, m = _c(bid_size), _c(ask_size)
    return F.try_divide(n - m, n + m)


def walk_book(levels, wanted) -> Column:
    """Cost of taking `wanted` from sorted levels (price, size); null if they don't hold enough."""
    start = F.struct(F.lit(0.0).alias("cost"), _c(wanted).cast("double").alias("left"))
    step = lambda a, x: F.struct((a["cost"] + x["price"] * F.least(a["left"], x["size"])).alias("cost"), (a["left"] - F.least(a["left"], x["size"])).alias("left"))
    return F.aggregate(levels, start, step, lambda a: F.when(a["left"] <= 0, a["cost"]))


def fee(price, rate: float) -> Column:
    p = _c(price)
    return rate * p * (1 - p)


def de_vig(a, b) -> Column:
    """Share of the first of two inverse odds."""
    return (1 / _c(a)) / (1 / _c(a) + 1 / _c(b))


def elo_expected(a, b) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (_c(b) - _c(a)) / 400))


def logit(p) -> Column:
    p = F.least(F.greatest(_c(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def facing(x1, y1, yaw, x2, y2, cone: float = 45.0) -> Column:
    """Whether (x2, y2) is within the cone around the yaw (degrees) at (x1, y1)."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    along = dx * F.cos(F.radians(_c(yaw))) + dy * F.sin(F.radians(_c(yaw)))
    return (along > 0) & (along >= math.cos(math.radians(cone)) * F.hypot(dx, dy))


def decay(age, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -_c(age) / half_life)


def oriented(swap, own: str, other: str) -> Column:
    return F.when(_c(swap), F.col(other)).otherwise(F.col(own))
