"""Every registered query against its DuckDB equivalent on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 3) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
        assert len(rows) == len(want)
        close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 0.0011
        bad = [(a, b) for a, b in zip(rows, want, strict=True) if not all(map(close, a, b))]
        assert not bad, bad[:3]


def test_stream_book_equals_its_batch_twin(spark):
    a, b = registry.QUERIES["T05_book_stream"](spark, SF), registry.QUERIES["T05_book_batch"](spark, SF)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
