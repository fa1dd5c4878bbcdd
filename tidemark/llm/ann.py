"""Approximate nearest neighbours by largest inner product, over learned partitions.

On a bounded sample the neighbour graph (largest inner products) is cut into parts of equal
size: parts are halved along their main direction, then vertices move to the part where
most of their neighbours are, while it has room.  A small network, with one hidden layer,
learns from the sample which parts a vector and its neighbours are in.  Every row of the
table goes to its most probable part; a query goes to the most probable parts that
together hold a share of the probability, and is compared with all rows there in double
precision.  The share is the smallest at which sample vectors that the network has not
seen find ``recall`` of their neighbours within the sample; neighbours in
the whole table are nearer, so recall there is higher.  Where vectors are spread evenly, neighbours are
spread over parts and a query goes to most of them.

Scale: only the sample (SAMPLE_ROWS at most) and the network reach the driver, both of a fixed size.
Small parts share a shelf of some BLOCK_ROWS rows, large ones are cut into blocks of that size, and queries come
in blocks of QUERY_ROWS, so neither a hot vector nor a full part is one task's work, and no part
has a cap.  A query visits a shelf once, with its parts there, and leaves with its
best rows alone; the best of those are found by a ranking window that cuts before it shuffles.
The number of parts grows with the table up to MAX_PARTS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Rows of a sample, at most; parts, at most, and rows of a part aimed at; neighbours in the graph.
SAMPLE_ROWS, MAX_PARTS, PART_ROWS, GRAPH = 16_384, 256, 500, 10
#: Rows of the sample that the share of probability is set on, and what they must find.
TRIALS, RECALL = 512, 0.94
#: Rows of a block, and queries of a block.
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
HIDDEN, EPOCHS, SEED = 96, 40, 7
NEAREST = 20
#: Scores of a matrix product may differ in the last digits by place; what is this near is scored anew.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>), dim of vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row of x, itself not among them."""
    near = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 256):
        scores = x[i : i + 256] @ x.T
        scores[np.arange(len(scores)), np.arange(i, i + len(scores))] = -np.inf
        near[i : i + 256] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 10) -> np.ndarray:
    """The part of each row: parts of equal size within a twentieth that cut few edges of the graph."""
    part = np.zeros(len(x), np.int64)
    _halve(x, np.arange(len(x)), 0, parts, part)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()], 1), np.stack([near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])], 1)])
    room = int(np.ceil(1.05 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (both[:, 0], part[both[:, 1]]), 1.0)
        gain = votes - votes[np.arange(len(x)), part][:, None]
        target, sizes, moved = gain.argmax(1), np.bincount(part, minlength=parts), 0
        best = gain[np.arange(len(x)), target]
        for i in np.argsort(-best, kind="stable"):
            if best[i] <= 0:
                break
            if sizes[target[i]] < room:
                sizes[part[i]] -= 1
                sizes[target[i]] += 1
                part[i], moved = target[i], moved + 1
        if not moved:
            break
    return part


def _halve(x: np.ndarray, rows: np.ndarray, first: int, parts: int, part: np.ndarray) -> None:
    if parts == 1:
        part[rows] = first
        return
    centred = x[rows] - x[rows].mean(0)
    main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    order, left = rows[np.argsort(centred @ main, kind="stable")], parts // 2
    cut = len(rows) * left // parts
    _halve(x, order[:cut], first, left, part)
    _halve(x, order[cut:], first + left, parts - left, part)


class Router:
    """A network from a vector's direction to the probabilities of parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED):
        """target: for each row the shares of parts among itself and its neighbours."""
        r = np.random.default_rng(seed)
        sizes = [(x.shape[1], hidden), (hidden, target.shape[1])]
        self.w = [p for a, b in sizes for p in (r.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            order = r.permutation(len(x))
            for i in range(0, len(x), 128):
                rows, step = order[i : i + 128], step + 1
                h = np.maximum(0, x[rows] @ self.w[0] + self.w[1])
                d = (_softmax(h @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                dh = (d @ self.w[2].T) * (h > 0)
                for k, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(0, x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probes(p: np.ndarray, share: float) -> np.ndarray:
    """Whether a query goes to a part: the most probable ones that together hold the share."""
    order = np.argsort(-p, axis=1, kind="stable")
    held = np.take_along_axis(p, order, 1).cumsum(1)
    go = np.concatenate([np.ones((len(p), 1), bool), held[:, :-1] < share], 1)
    out = np.zeros_like(go)
    np.put_along_axis(out, order, go, 1)
    return out


class Index:
    """What learns and routes: one part where the sample is too small for more."""

    def __init__(self, sample: np.ndarray, parts: int, nearest: int = NEAREST, recall: float = RECALL):
        self.dim, self.share, self.router = (sample.shape[1] if len(sample) else 0), 1.0, None
        trials = min(TRIALS, len(sample) // 8)
        fit, trial = sample[trials:], sample[:trials]
        self.parts = max(1, min(parts, len(fit) // 32))
        if self.parts == 1:
            return
        x, near = units(fit), graph(fit, min(GRAPH, len(fit) - 1))
        part = balanced_parts(x, near, self.parts)
        target = np.zeros((len(x), self.parts))
        target[np.arange(len(x)), part] = 1.0
        np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1.0)
        self.router = Router(x, target / target.sum(1, keepdims=True))
        home, chance = self.home(fit), self.router.parts(units(trial))
        wanted = np.argpartition(-(trial @ fit.T), min(nearest, len(fit) - 1), axis=1)[:, :nearest]
        for share in np.concatenate([np.arange(0.3, 0.99, 0.02), 1 - 0.01 * 0.7 ** np.arange(30)]):
            self.share = float(share)
            if np.take_along_axis(probes(chance, share), home[wanted], 1).mean() >= recall:
                return
        self.share = 2.0  # every part

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.router.parts(units(x)).argmax(1) if self.router else np.zeros(len(x), np.int64)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return probes(self.router.parts(units(x)), self.share) if self.router else np.ones((len(x), 1), bool)


def learn(rows: DataFrame, nearest: int = NEAREST) -> Index:
    """An index for the most frequent length of vectors, from SAMPLE_ROWS of them at most."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return Index(np.zeros((0, 1)), 1, nearest)
    dim, n = sizes[0]
    parts = int(min(MAX_PARTS, max(1, n // PART_ROWS)))
    wanted = min(SAMPLE_ROWS, max(2048, 64 * parts))
    key = F.pmod(F.xxhash64("vec_id", "v", "uid"), F.lit(10**9))
    drawn = rows.where((F.col("dim") == dim) & (key < int(min(1.0, 1.2 * wanted / n) * 1e9))).select(key.alias("key"), "v").orderBy("key").limit(wanted).toArrow()
    return Index(_matrix(drawn.column("v").combine_chunks()), parts, nearest)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def routed(rows: DataFrame, index: Index, query: bool) -> DataFrame:
    """rows with ``part``, the most probable one, or, of queries, with ``parts``, all they go to.
    Vectors of another length than the index's have a part of their own for each length."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # a network of a fixed size

    def run(batches):
        index = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ours, part = np.flatnonzero(dims == index.dim), -dims.astype(np.int64)
            parts = [[p] for p in part.tolist()]
            if len(ours):
                x = _matrix(batch.column("v").take(pa.array(ours)))
                if query:
                    for i, go in zip(ours.tolist(), index.routes(x), strict=True):
                        parts[i] = np.flatnonzero(go).tolist()
                else:
                    part[ours] = index.home(x)
            added = pa.array(parts, pa.list_(pa.int64())) if query else pa.array(part, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, "parts" if query else "part"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, uid long, " + ("parts array<long>" if query else "part long"))


def best(q: np.ndarray, q_uid: np.ndarray, q_parts: list, x: np.ndarray, ids: np.ndarray, uid: np.ndarray, part: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the nearest rows of x that are in its parts, but itself: places in q, in x, scores.
    Rows of x are in order of part."""
    names, begin = np.unique(part, return_index=True)
    end = np.append(begin[1:], len(part))
    goes = np.array([np.isin(names, p) for p in q_parts])
    at_q, at_x, out = [], [], []
    for i in range(0, len(q), 64):
        scores = np.full((len(q[i : i + 64]), len(x)), -np.inf)
        for k in range(len(names)):
            some = np.flatnonzero(goes[i : i + 64, k])
            scores[some, begin[k] : end[k]] = q[i + some] @ x[begin[k] : end[k]].T
        scores[q_uid[i : i + 64, None] == uid] = -np.inf
        k = min(nearest, len(x))
        least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
        reach = SLACK * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
        for row, s in enumerate(scores):
            near = np.flatnonzero((s >= least[row] - reach[row]) & (s > -np.inf))
            exact = (x[near] * q[i + row]).sum(1)
            order = np.lexsort((ids[near], -exact))[:nearest]
            at_q.append(np.full(len(order), i + row))
            at_x.append(near[order])
            out.append(exact[order])
    return np.concatenate(at_q), np.concatenate(at_x), np.concatenate(out)


def search(vectors: DataFrame, every: int = 20, nearest: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The nearest rows of each row whose id ``every`` divides: query_id, rank (from 1), vec_id, score.

    Vectors that are null, empty, all zero or hold null or non-finite components take no
    part.  Vectors are compared with those of their own length.  Every row counts, rows that repeat an id or a vector too: a
    query is never its own row, but a repeated row of it may be found, and each repeated row is a query of its own.
    Ties go to the smaller id; rows without an id are found, after others of the same score, and ask nothing.  Empty
    tables give no rows; other columns are not looked at."""
    spark = vectors.sparkSession
    with Scratch(spark, "ann") as scratch:
        rows = scratch.write(usable(vectors, id_col, vector_col).withColumn("uid", F.monotonically_increasing_id()), "rows")
        index = learn(rows, nearest)
        homes = scratch.write(routed(rows, index, query=False), "homes")
        asked = routed(rows.where(F.col("vec_id") % every == 0), index, query=True)
        # Statistics of parts, MAX_PARTS and the other lengths: those that begin in the same block_rows rows share a shelf.
        sizes = homes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        length = F.when(F.col("part") < 0, F.col("part")).otherwise(F.lit(0))  # no shelf has vectors of two lengths
        plan = scratch.write(sizes.select("part", F.struct(length.alias("length"), F.floor(before / block_rows).alias("block")).alias("shelf"), F.ceil(F.col("n") / block_rows).cast("int").alias("nb")), "plan")
        visits = asked.withColumn("part", F.explode("parts")).join(plan, "part").groupBy("uid", "shelf").agg(F.any_value("vec_id").alias("vec_id"), F.any_value("v").alias("v"), F.collect_set("part").alias("parts"), F.max("nb").alias("nb"))
        visits = scratch.write(visits, "visits")
        askers = scratch.write(visits.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("nq")), "askers")
        place = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n)).cast("int")
        span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = homes.join(plan, "part").join(askers, "shelf").withColumn("b", place("nb", 3)).withColumn("q", span("nq")).select("shelf", "b", "q", "vec_id", "v", "uid", "part")
        right = visits.join(askers, "shelf").withColumn("q", place("nq", 4)).withColumn("b", span("nb")).select("shelf", "b", "q", "vec_id", "v", "uid", "parts")

        def compare(there: pa.Table, queries: pa.Table) -> pa.Table:
            if not len(there) or not len(queries):
                return FOUND.empty_table()
            there = there.sort_by("part")
            ids = there.column("vec_id").combine_chunks()
            low = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            at_q, at_x, score = best(_matrix(queries.column("v")), queries.column("uid").to_numpy(), queries.column("parts").to_pylist(), _matrix(there.column("v")), low, there.column("uid").to_numpy(), there.column("part").to_numpy(), nearest)
            return pa.table([queries.column("vec_id").take(pa.array(at_q)), queries.column("uid").take(pa.array(at_q)), ids.take(pa.array(at_x)), pa.array(score, pa.float64())], schema=FOUND)

        met = left.groupBy("shelf", "b", "q").cogroup(right.groupBy("shelf", "b", "q")).applyInArrow(compare, "query_id long, uid long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        return materialize(met.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score"), "nearest")


FOUND = pa.schema([("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
