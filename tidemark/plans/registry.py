"""All registered queries and their DuckDB equivalents.

A query is a function of (spark, sf_dir), registered with @query under the inventory's id.
Oracle SQL may use the names tape, facts and steps, which are put in front of it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "J27_event_study"

VIEWS = {
    "tape": "SELECT user_id AS key, ts, epoch_us(ts) AS us, event_id AS seq, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents, value, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) AS k FROM events",
    "facts": "SELECT o_orderkey AS fact, o_custkey AS entity, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, o_orderstatus = 'F' AS won, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS class FROM orders",
    "steps": "SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS step, l_returnflag = 'R' AS win, l_linestatus AS side, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc, l_partkey AS part, l_suppkey AS supp, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, CAST(l_linenumber AS BIGINT) AS line FROM lineitem",
}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; sql is its DuckDB equivalent, None where SQL can't express it."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            views = ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items())
            body = sql.strip()
            recursive = body.upper().startswith("WITH RECURSIVE")
            rest = body[len("WITH RECURSIVE" if recursive else "WITH") :].strip() if body.upper().startswith("WITH") else None
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{views}" + (f", {rest}" if rest else f" {body}")
        return f

    return add


for _part in ("joins", "windows", "aggregates", "checks", "scalars", "sources", "composites", "streams", "models"):
    importlib.import_module(f"tidemark.plans.{_part}")
