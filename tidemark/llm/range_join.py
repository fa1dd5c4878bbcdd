"""Embedding near-duplicates by an exact metric range join.

Cosine >= c of unit vectors is distance <= r with r^2 = 2 - 2c, and distance obeys the
triangle inequality.  Pivots drawn from a label's vectors partition it: a vector's home
is the cell of its nearest pivot.  A partner can only be in another cell if the border
between the two is near: for a partner y at home with pivot q, d(x,q) <= d(x,p) + 2r, and,
sharper, (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= r.  A vector is replicated to those
cells of lower number, so every pair meets in exactly one cell, and cells join on their
own, in blocks, as matrix products in double precision.

Scale: equal vectors are joined as one with a weight.  A label gets more pivots the more
vectors it has, down to small labels, as long as the cells that a sample of its vectors
goes to are few (CELL_COPIES on average), two at least; so what is sent to cells grows
with the input.  Large cells are cut into blocks of BLOCK_ROWS, and a task gets two blocks,
so neither a hot label nor a hot vector lands in one task.  Tasks return counts and a
spanning forest of their links, never the links.  The number of pivots is bounded
(LABEL_PIVOTS, MAX_PIVOTS); it decides speed only.  Where vectors are spread evenly over
many dimensions the bounds prune little, labels keep few pivots, and the work is that of
comparing a label's vectors with each other in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize
from .components import components

COSINE = 0.93
#: Vectors of one cell aimed at; rows of a block; pivots of one label and of all.
CELL_ROWS, BLOCK_ROWS, LABEL_PIVOTS, MAX_PIVOTS = 40, 1000, 256, 4096
#: Cells that a vector may go to on average where a label has more than two pivots.
CELL_COPIES = 2.0
#: Vectors of a label drawn to try pivots on, about.
SAMPLE = 64
#: Rounding must never prune: added to the bound.
SLACK = 1e-6


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Distinct usable vectors: cid (a number of its own), vec_id (smallest), copies, label, v."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(F.array_max(F.transform("v", F.abs)) > 0)
    # Equal vectors are one; the sum over all is map-side combined.
    one = rows.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    return one.select(F.monotonically_increasing_id().alias("cid"), "vec_id", "copies", "label", "v")


def unit_vectors(classes: DataFrame) -> DataFrame:
    """cid, copies, label, dim, unit (array<double>) of written classes."""
    raw = classes.select("cid", "copies", "label", F.size("v").alias("dim"), F.col("v").alias("unit"))
    return raw.mapInArrow(_scaled, raw.schema)


def _scaled(batches):
    """The last column's vectors, none of them empty or zero, divided by their lengths."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        x, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        starts = ends - sizes
        x = x / np.repeat(np.maximum.reduceat(np.abs(x), starts), sizes)  # so that no square overflows
        x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), sizes)
        unit = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x, pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], unit], batch.schema.names)


def draw_pivots(units: DataFrame, cell_rows: int, radius: float) -> dict:
    """(label, dim) -> pivots (k x dim), for labels of more than one cell's rows."""
    counts = units.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).orderBy(F.desc("n"), "label", "dim").limit(MAX_PIVOTS // 2)
    large = counts.collect()  # at most MAX_PIVOTS / 2 rows
    wanted = [min(LABEL_PIVOTS, math.ceil(r["n"] / cell_rows)) for r in large]
    shrink = min(1.0, MAX_PIVOTS / max(1, sum(wanted)))
    wanted = [max(2, int(k * shrink)) for k in wanted]
    if not large:
        return {}
    rates = units.sparkSession.createDataFrame([(r["label"], r["dim"], int(min(1.0, max(SAMPLE, 2.0 * k) / r["n"]) * 1e9)) for r, k in zip(large, wanted, strict=True)], units.select("label", "dim").withColumn("_rate", F.lit(0).cast("long")).schema)
    key = F.pmod(F.xxhash64("unit", F.lit(9)), F.lit(10**9))
    # Some max(SAMPLE * labels, 2 * MAX_PIVOTS) rows.
    drawn = units.join(F.broadcast(rates), ["label", "dim"]).where(key < F.col("_rate")).select("label", "dim", key.alias("key"), "unit").collect()
    samples: dict = {}
    for r in drawn:
        samples.setdefault((r["label"], r["dim"]), []).append((r["key"], r["unit"]))
    out = {}
    for r, k in zip(large, wanted, strict=True):
        ours = np.array([u for _, u in sorted(samples.get((r["label"], r["dim"]), []))])
        if len(ours) > 1:
            out[r["label"], r["dim"]] = few_cells(ours, min(k, len(ours)), radius)
    return out


def few_cells(sample: np.ndarray, k: int, radius: float) -> np.ndarray:
    """k vectors of the sample that lie far apart, or half as many and so on, as pivots under
    which the others go to no more than CELL_COPIES cells on average; two at least."""
    order, reach = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(order) < k:  # the next pivot is the vector that is farthest from those there are
        order.append(int(reach.argmax()))
        reach = np.minimum(reach, ((sample - sample[order[-1]]) ** 2).sum(1))
    cells = lambda k: np.mean([len(c) for c in homes(np.delete(sample, order[:k], 0), sample[order[:k]], radius)] or [1])
    while k > 2 and cells(k) > CELL_COPIES:
        k = max(2, k // 2)
    return sample[order[:k]]


def homes(x: np.ndarray, pivots: np.ndarray, radius: float) -> list[np.ndarray]:
    """For each row of x the cells it goes to: its home first, then lower cells in reach."""
    d2 = np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T)
    between = np.sqrt(np.maximum(1e-30, ((pivots[:, None] - pivots) ** 2).sum(2)))
    home = d2.argmin(1)
    own = d2[np.arange(len(x)), home][:, None]
    near = (np.sqrt(d2) <= np.sqrt(own) + 2 * radius + SLACK) & ((d2 - own) / (2 * between[home]) <= radius + SLACK)
    near &= np.arange(len(pivots)) < home[:, None]
    return [np.concatenate([[h], np.flatnonzero(row)]) for h, row in zip(home, near, strict=True)]


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def spread(units: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """One row for each vector and cell: cid, copies, label, dim, unit, cell, native."""
    shared = units.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors at most

    def run(batches):
        for batch in batches:
            groups: dict = {}
            for i, key in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                groups.setdefault(key, []).append(i)
            take, cell, native = [], [], []
            for key, rows in groups.items():
                p = shared.value.get(key)
                cells = homes(_matrix(batch.column(4).take(pa.array(rows))), p, radius) if p is not None else [np.zeros(1, int)] * len(rows)
                for i, c in zip(rows, cells, strict=True):
                    take += [i] * len(c)
                    cell += c.tolist()
                    native += [True] + [False] * (len(c) - 1)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(native, pa.bool_())], [*batch.schema.names, "cell", "native"])

    return units.mapInArrow(run, _with(units, "cell int, native boolean"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + more


def _links(a: dict, b: dict | None, cosine: float):
    """Counts and spanning edges of the links inside a (b None) or between a and b."""
    same = b is None
    b = a if same else b
    m = a["unit"] @ b["unit"].T >= cosine
    if same:
        np.fill_diagonal(m, False)
    n_a = m @ b["copies"]
    n_b = None if same else m.T @ a["copies"]
    # Labels run over the links until every vertex has its part's smallest id.
    top = np.iinfo(np.int64).max
    la, lb = a["cid"].copy(), b["cid"].copy()
    busy_a, busy_b = m.any(1), m.any(0)
    sub, ia, ib = m[np.ix_(busy_a, busy_b)], np.flatnonzero(busy_a), np.flatnonzero(busy_b)
    while len(ia):
        na = np.minimum(la[ia], np.where(sub, lb[ib], top).min(1))
        if same:
            lb = la
        nb = np.minimum(lb[ib], np.where(sub, na[:, None], top).min(0))
        if (na == la[ia]).all() and (nb == lb[ib]).all():
            break
        la[ia], lb[ib] = na, nb
        if same:
            la = lb = np.minimum(la, lb)
    return n_a, n_b, la, lb


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a vector: cid, n_links (other vectors linked with it), component_id
    (smallest cid that links reach, its own included), kept (cid is component_id).

    Only vectors of equal, non-null label and equal length are compared.  Vectors that
    are null, empty, all zero or have null or non-finite components link with nothing.
    Every row is a vector: rows that repeat an id, with the same vector or another, get a row each,
    from their own vector and label.  Rows without an id link and are counted; a component of
    such rows alone has a null id.  Empty tables give no rows; other columns are not looked at."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be in (0, 1]")
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        return materialize(_joined(vectors, cosine, radius, id_col, vector_col, label_col, cell_rows, block_rows, scratch), "joined")


def _joined(vectors: DataFrame, cosine: float, radius: float, id_col: str, vector_col: str, label_col: str, cell_rows: int, block_rows: int, scratch: Scratch) -> DataFrame:
    classes = scratch.write(classes_of(vectors, id_col, vector_col, label_col), "classes")
    units = unit_vectors(classes)
    pivots = draw_pivots(units, cell_rows, radius)
    cells = scratch.write(spread(units, pivots, radius), "cells")
    sizes = cells.groupBy("label", "dim", "cell", "native").agg(F.count(F.lit(1)).alias("n")).groupBy("label", "dim", "cell").agg(F.coalesce(F.sum(F.when(F.col("native"), F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("native"), F.col("n"))), F.lit(0)).alias("r"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block_rows)).cast("int")
    dealt = cells.join(sizes.where("n > 0").select("label", "dim", "cell", blocks("n").alias("nb"), blocks("r").alias("rb")), ["label", "dim", "cell"])
    at = F.pmod(F.xxhash64("cid", F.lit(5)), F.when(F.col("native"), F.col("nb")).otherwise(F.col("rb"))).cast("int")
    dealt = dealt.withColumn("at", at)
    # A task is a pair of blocks (x, y): natives x <= y, or natives x with replicas nb + y.
    span = lambda to: F.when(to > 0, F.sequence(F.lit(0), to - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.concat(
        F.transform(span(F.col("nb")), lambda i: F.struct(F.least("at", i).alias("x"), F.greatest("at", i).alias("y"), (F.col("at") <= i).alias("left"))),
        F.transform(span(F.col("rb")), lambda i: F.struct(F.col("at").alias("x"), (F.col("nb") + i).alias("y"), F.lit(True).alias("left"))),
    )
    theirs = F.transform(span(F.col("nb")), lambda i: F.struct(i.alias("x"), (F.col("nb") + F.col("at")).alias("y"), F.lit(False).alias("left")))
    tasks = dealt.withColumn("t", F.explode(F.when(F.col("native"), mine).otherwise(theirs))).select("label", "dim", "cell", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.left").alias("left"), "cid", "copies", "unit")

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        side = lambda mask: {"cid": table.column("cid").to_numpy()[mask], "copies": table.column("copies").to_numpy()[mask], "unit": _matrix(table.column("unit").combine_chunks())[mask]}
        a = side(left)
        if table.column("x")[0].as_py() == table.column("y")[0].as_py():
            n_a, _, la, _ = _links(a, None, cosine)
            ids, n, low = a["cid"], n_a, la
        else:
            b = side(~left)
            n_a, n_b, la, lb = _links(a, b, cosine)
            ids, n, low = np.concatenate([a["cid"], b["cid"]]), np.concatenate([n_a, n_b]), np.concatenate([la, lb])
        hit = n > 0
        return pa.table({"cid": ids[hit], "n": n[hit].astype(np.int64), "low": low[hit]})

    found = scratch.write(tasks.groupBy("label", "dim", "cell", "x", "y").applyInArrow(join, "cid long, n long, low long"), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n_other"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")), "vectors", scratch=scratch).select(F.col("vertex").alias("cid"), "component")
    known = classes.join(counts, "cid", "left").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    low = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = known.join(low, "component").select("label", "v", (F.coalesce("n_other", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # Back from classes to rows, by label and vector; ids play no part in it.
    v = F.col(vector_col).cast("array<double>")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    out = every.join(known, ["label", "v"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
