"""Merkle dataset manifest: a content-addressed DAG of digests, and proofs by descent.

A leaf is the digest of a row's fields, a node the digest of its children's digests, joined.
Leaves of a group (a language) ascend by id and form a tree of a given fan-out; the groups'
subroots form a tree of the same kind, whose top is the root of the data set.

The DAG is stored as records, digest to children.  Records of ``levels`` levels below one node make
a page, and a page is found by the digest of its top node.  A leaf's request
starts at the root and follows the digits of its rank, the most significant first: each
digit selects a child, the children not selected are collected as one path segment, and at
a page's lower edge the request goes on to the page of the digest it has reached.  The
segments, reversed, are the proof from leaf to root.

Scale: texts are hashed once, inside Spark's own code, and never travel.  Ranks come from a
range sort of narrow rows: the place of a row within its partition plus the rows of its
group in earlier partitions, so a hot group is many tasks' work.  Pages have ``fanout ** levels``
nodes at most and are the unit of work.  Requests that have not parted yet travel as one:
above the leaves there is one request a page, so no join has a hot digest but where whole
pages repeat, and such requests are dealt again before they are expanded.  The number of
joins is the number of page levels (three for 10^8 leaves of one group), each written to
the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Children of a node; levels of a page.
FANOUT, LEVELS = 2, 9
#: Rows of a task that ranks.
TASK_ROWS = 50_000


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf_column(*fields: F.Column) -> F.Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def tampered(doc_id: F.Column) -> F.Column:
    """Whether 7 divides the crc32 of the id in decimal (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def placed(rows: DataFrame, group: str | None, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """rows sorted over partitions by group and order, with their place ``_at``, and the spans
    that groups have in partitions: _g (the group), _part, _base, _here.

    A row's rank in its group is _at + _base: its place in its partition less that of the group's
    first row there, plus the group's rows in earlier partitions.  order must tell any two
    rows apart where they should not have to meet in one task."""
    keys = ([group] if group else []) + order
    parts = max(8, -(-rows.count() // TASK_ROWS))
    out = scratch.write(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    spans = out.groupBy((F.col(group) if group else F.lit(0)).alias("_g"), part_of("_at").alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_here"))
    before = F.coalesce(F.sum("_here").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out, scratch.write(spans.select("_g", "_part", (before - F.col("_first")).alias("_base"), "_here"), f"{name}-spans")


def part_of(at: str) -> F.Column:
    """The partition of a place that monotonically_increasing_id gave."""
    return F.shiftright(at, 33)


def page_of(digests: list[str], fanout: int, height: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """The top digest of a page and its records (digest, children), for so many levels."""
    records: dict[str, list[str]] = {}
    for _ in range(height):
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        digests = [digest("".join(run)) for run in runs]
        records.update(zip(digests, runs, strict=True))
    return digests[0], list(records.items())


def height_of(nodes: int, fanout: int) -> int:
    """Levels above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof array<struct<at:int,others:array<string>>>, folded_root string, verified boolean"
PAGE = "g long, page long, digest string, height int, children map<string,array<string>>"
REQUEST = "g long, page long, digest string, path array<struct<at:int,others:array<string>>>"


def build(nodes: DataFrame, fanout: int, levels: int, most: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Pages of trees over nodes (g, rank, digest, n: nodes of g), one table a page level,
    the lowest first, and their tops (g, digest).  most: the largest n."""
    span, pages, tops = fanout**levels, [], None

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        height = min(levels, height_of(table.column("n")[0].as_py(), fanout))
        top, records = page_of(table.column("digest").to_pylist(), fanout, height)
        rank = table.column("rank")[0].as_py() // span
        row = {"g": [table.column("g")[0].as_py()], "page": [rank], "digest": [top], "height": [height], "children": [records]}
        return pa.table(row, schema=pa.schema([("g", pa.int64()), ("page", pa.int64()), ("digest", pa.string()), ("height", pa.int32()), ("children", pa.map_(pa.string(), pa.list_(pa.string())))]))

    while True:
        made = nodes.select("g", "rank", "digest", "n", F.expr(f"rank div {span}").alias("page")).groupBy("g", "page").applyInArrow(make, PAGE)
        # n of a group outlives the page level, by the number of its pages.
        pages.append(scratch.write(made, f"{name}{len(pages)}"))
        sizes = pages[-1].groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        above = pages[-1].select("g", F.col("page").alias("rank"), "digest").join(sizes, "g")
        done = above.where("n = 1").select("g", "digest")
        tops = done if tops is None else tops.unionByName(done)
        most = -(-most // span)
        if most <= 1:
            return pages, tops
        nodes = above.where("n > 1")


def descend(page_children: list, top: str, rank: int, height: int, fanout: int) -> tuple[str, list[dict]]:
    """Follow the digits of a rank from a page's top: the digest reached, and the segments met."""
    segments = []
    for level in range(height - 1, -1, -1):
        digit = rank // fanout**level % fanout
        run = page_children[top]
        segments.append({"at": digit, "others": run[:digit] + run[digit + 1 :]})
        top = run[digit]
    return top, segments


def edge(children: dict, top: str, height: int, fanout: int) -> list[int]:
    """Ranks of the nodes at a page's lower edge."""
    ranks = [(0, top)]
    for _ in range(height):
        ranks = [(r * fanout + i, d) for r, node in ranks for i, d in enumerate(children[node])]
    return [r for r, _ in ranks]


def lower_requests(requests: DataFrame, pages: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The requests that reach the next page level: each is joined with the page of its digest and
    expanded to one request for each node at that page's lower edge."""
    span = fanout**levels
    unique = pages.groupBy("digest").agg(F.max("height").alias("height"), F.any_value("children").alias("children"))
    met = requests.join(unique, "digest").select("g", "page", "digest", "path", "height", "children")
    met = met.repartition("g", "page")  # equal pages are one key above, and are dealt out here

    def run(batches):
        for batch in batches:
            out = {"g": [], "page": [], "digest": [], "path": []}
            for r in batch.to_pylist():
                children = dict(r["children"])
                for rank in edge(children, r["digest"], r["height"], fanout):
                    reached, segments = descend(children, r["digest"], rank, r["height"], fanout)
                    for k, v in (("g", r["g"]), ("page", r["page"] * span + rank), ("digest", reached), ("path", r["path"] + segments)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=REQUEST_ARROW)

    return met.mapInArrow(run, REQUEST)


REQUEST_ARROW = pa.schema([("g", pa.int64()), ("page", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])))])


def fold(leaf: str, proof: list[dict]) -> str:
    """The root that a leaf and its proof (segments from leaf to root) give."""
    for s in proof:
        leaf = digest("".join([*s["others"][: s["at"]], leaf, *s["others"][s["at"] :]]))
    return leaf


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof (segments from leaf to root: at,
    others), folded_root (what the proof and the row as it is after tampering give), verified.
    derive is applied to these rows before they are written, for callers that need less.

    Every row is a leaf, repeated rows too.  Null languages are a group of their own, the first;
    null ids come first in their group; rows that repeat an id come in the order of their
    leaves, equal leaves in any order, as their proofs verify alike whichever takes which rank.  Empty and very long texts are
    values like others.  A table without rows gives no rows.  Columns other than doc_id,
    source, lang, n_chars and text are not looked at."""
    if fanout < 2 or levels < 1:
        raise ValueError("a node has two children or more, and a page one level or more")
    spark = docs.sparkSession
    with Scratch(spark, "merkle") as scratch:
        doc_id, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
        whole = lambda chars: leaf_column(doc_id, F.col("source"), F.col("lang"), chars, F.col("text"))
        leaves = docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), whole(n).alias("digest"), F.when(tampered(doc_id) & n.isNotNull(), whole(n + 1)).alias("found"), F.monotonically_increasing_id().alias("_row"))
        leaves = scratch.write(leaves, "leaves")
        sorted_leaves, spans = placed(leaves, "lang", ["doc_id", "digest", "_row"], scratch, "sorted")
        langs, lang_spans = placed(spans.groupBy(F.col("_g").alias("lang")).agg(F.sum("_here").alias("n")), None, ["lang"], scratch, "langs")
        groups = scratch.write(langs.join(lang_spans, part_of("_at") == F.col("_part")).select("lang", "n", (F.col("_at") + F.col("_base")).alias("g")), "groups")
        bounds = groups.agg(F.max("n"), F.count(F.lit(1))).first()  # two numbers
        if not bounds[1]:
            found = spark.createDataFrame([], MANIFEST)
            return derive(found) if derive else found
        spans = spans.join(groups.select(F.col("lang").alias("_lang"), "n", "g"), F.col("_g").eqNullSafe(F.col("_lang"))).drop("_lang")
        named = sorted_leaves.join(spans, (part_of("_at") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_g")))
        nodes = scratch.write(named.select("g", (F.col("_at") + F.col("_base")).alias("rank"), "n", "doc_id", "digest", "found"), "nodes")
        pages, subroots = build(nodes, fanout, levels, bounds[0], scratch, "pages")
        subroots = scratch.write(subroots, "subroots")
        top_pages, roots = build(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), "digest", F.lit(bounds[1]).cast("long").alias("n")), fanout, levels, bounds[1], scratch, "tops")
        root = roots.first()["digest"]

        # One request at the root; it parts at each page's lower edge.
        requests = spark.createDataFrame([(0, 0, root, [])], REQUEST)
        for k in range(len(top_pages) - 1, -1, -1):
            requests = scratch.write(lower_requests(requests, top_pages[k], fanout, levels), f"toward-tops{k}")
        # Here one a language, with its rank as page: on to the page at the top of its own tree.
        waiting = requests.select(F.col("page").alias("g"), F.lit(0).cast("long").alias("page"), "digest", "path")
        depth = groups.select("g", F.expr("CASE " + " ".join(f"WHEN n <= {fanout ** (levels * (k + 1))} THEN {k}" for k in range(len(pages))) + f" ELSE {len(pages)} END").alias("depth"))
        waiting = scratch.write(waiting.join(depth, "g").select("g", "page", "digest", "path", "depth"), "waiting")
        current = None
        for k in range(len(pages) - 1, -1, -1):
            starts = waiting.where(F.col("depth") == k).drop("depth")
            current = starts if current is None else current.unionByName(starts)
            if k:
                current = scratch.write(lower_requests(current, pages[k], fanout, levels), f"toward{k}")
        unique = pages[0].groupBy("digest").agg(F.max("height").alias("height"), F.any_value("children").alias("children"))
        last = current.join(unique, "digest").join(subroots.select("g", F.col("digest").alias("subroot")), "g")
        span = fanout**levels
        asked = nodes.select("g", F.expr(f"rank div {span}").alias("page"), "rank", "doc_id", "digest", "found")
        last = last.select("g", "page", "digest", "path", "height", "children", "subroot")

        def answer(ours: pa.Table, page: pa.Table) -> pa.Table:
            (p,) = page.to_pylist()
            children, out = dict(p["children"]), []
            for r in ours.to_pylist():
                reached, segments = descend(children, p["digest"], r["rank"] % span, p["height"], fanout)
                if reached != r["digest"]:
                    raise ValueError(f"the records lead rank {r['rank']} to another leaf")
                proof = (p["path"] + segments)[::-1]
                folded = fold(r["found"] or r["digest"], proof)
                out.append({"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": p["subroot"], "root": root, "proof": proof, "folded_root": folded, "verified": folded == root})
            return pa.Table.from_pylist(out, schema=ANSWER)

        found = asked.groupBy("g", "page").cogroup(last.groupBy("g", "page")).applyInArrow(answer, MANIFEST)
        return materialize(derive(found) if derive else found, "manifest")


ANSWER = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root")], ("proof", REQUEST_ARROW.field("path").type), ("folded_root", pa.string()), ("verified", pa.bool_())])


def proof_digest(proof: F.Column) -> F.Column:
    """sha256 of a proof's digests, level by level from the leaf on, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(proof, lambda s: s["others"]))).cast("binary"), 256)
