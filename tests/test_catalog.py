"""Every registered query against the SQL that goes with it, on whole tables."""

import math
import os

import duckdb
import pytest

from ragloom.plans import registry

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()

registry.load_all()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIRECTORY}/{name}.parquet'")
    return connection


def _ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, DIRECTORY)
    columns = sorted(frame.columns)
    ours = _ordered([tuple(row[c] for c in columns) for row in frame.collect()])
    if name not in registry.ORACLES:
        assert ours
        return
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = _ordered([tuple(row[names.index(c)] for c in columns) for row in result.fetchall()])
    assert len(ours) == len(theirs)
    assert all(_same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))
