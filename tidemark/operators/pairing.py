"""Changes of binned prices, mirrored ones as one, and one-to-one pairing of events with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .asof import asof


def price_jumps(mids: DataFrame, by: list[str], outcome: str, bin_: str, mid: str, least: float) -> DataFrame:
    """Changes of at least `least` between an outcome's bins that follow each other: by, bin, outcomes, delta,
    positive_outcome.

    Where a bin has one change up and one down of two outcomes of the same market (by), they mirror each other and are
    one row: outcomes is 2, delta the change up, positive_outcome whose it is.  Any other change is a row of its own, with
    outcomes 1 and, if it is up, its outcome as the positive one."""
    order = Window.partitionBy(*by, outcome).orderBy(bin_)
    moved = mids.withColumn("_d", F.col(mid) - F.lag(mid).over(order)).where(F.abs("_d") >= least)
    one = F.struct(F.col("_d").alias("d"), F.col(outcome).alias("o"))
    # Sums of a bin and a market: how many went up and down, and which; a market has few outcomes, rows beyond two stay rows.
    each = moved.groupBy(*by, bin_).agg(F.count_if(F.col("_d") > 0).alias("ups"), F.count_if(F.col("_d") < 0).alias("downs"), F.collect_list(one).alias("all"))
    mirrored = (F.col("ups") == 1) & (F.col("downs") == 1)
    up = F.filter("all", lambda x: x["d"] > 0)
    row = lambda n, d, o: F.struct(F.lit(n).cast("long").alias("outcomes"), d.alias("delta"), o.alias("positive_outcome"))
    rows = F.when(mirrored, F.transform(up, lambda x: row(2, x["d"], x["o"]))).otherwise(F.transform("all", lambda x: row(1, x["d"], F.when(x["d"] > 0, x["o"]))))
    return each.select(*by, bin_, F.explode(rows).alias("x")).select(*by, bin_, "x.*")


def _nearest(these: DataFrame, those: DataFrame, by: list[str], width: int) -> DataFrame:
    """by, t, n of these with the t and n of those nearest in time (of two as near, the earlier one)."""
    back = asof(these, those, by, "t", ["n"], "n", tolerance=width, prefix="b_")
    both = asof(back, those, by, "t", ["n"], "n", direction="forward", tolerance=width, prefix="a_")
    before = F.col("a_t").isNull() | (F.col("t") - F.col("b_t") <= F.col("a_t") - F.col("t"))
    first = F.col("b_t").isNotNull() & before
    pick = lambda c: F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"o_{c}")
    return both.select(*by, "t", "n", pick("t"), pick("n")).where("o_t IS NOT NULL")


def pair_one_to_one(left: DataFrame, right: DataFrame, by: list[str], on: str, order: str, width: int) -> DataFrame:
    """Pairs of left and right rows of the same `by`, at most `width` apart, each row in one pair at most: by,
    left_t, left_n, right_t, right_n (values of on and order).

    The closest pair of all goes first, then the closest of the rest, and so on; of two as close, the one with the earlier
    left row, then the earlier right row; of rows of one instant, the first by order.  What a
    pair must agree on (a market, the side that a price moved to) belongs in `by`.

    Done in rounds: rows that are each other's nearest are pairs, for no closer pair could take either;
    what is left goes into the next round.  A round is four as-of joins and never makes candidate pairs, however dense
    a key is.  Rounds go on while there are pairs: the closest pair of what is left is always one."""
    of = lambda df: df.select(*by, F.col(on).alias("t"), F.col(order).alias("n")).where(F.col(on).isNotNull())
    rest_l, rest_r, found, k = materialize(of(left), "pair-left"), materialize(of(right), "pair-right"), None, 0
    same = ["t", "n"]
    while True:
        # One row an instant: the others wait.
        ls, rs = (df.groupBy(*by, "t").agg(F.min("n").alias("n")) for df in (rest_l, rest_r))
        to_right = _nearest(ls, rs, by, width).select(*by, F.col("t").alias("left_t"), F.col("n").alias("left_n"), F.col("o_t").alias("right_t"), F.col("o_n").alias("right_n"))
        to_left = _nearest(rs, ls, by, width).select(*by, F.col("o_t").alias("left_t"), F.col("o_n").alias("left_n"), F.col("t").alias("right_t"), F.col("n").alias("right_n"))
        pairs = materialize(to_right.join(to_left, to_right.columns), f"pairs{k}")
        if pairs.isEmpty():
            return found if found is not None else pairs
        found, k = pairs if found is None else found.unionByName(pairs), k + 1
        gone = lambda side: pairs.select(*by, F.col(f"{side}_t").alias("t"), F.col(f"{side}_n").alias("n"))  # noqa: B023, E731
        rest_l = materialize(rest_l.join(gone("left"), [*by, *same], "left_anti"), f"pair-left{k}")
        rest_r = materialize(rest_r.join(gone("right"), [*by, *same], "left_anti"), f"pair-right{k}")
