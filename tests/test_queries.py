"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tandemlake.plans import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def norm(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_matches_sql(spark, database, name):
    found = queries.QUERIES[name](spark, DATA)
    result = database.sql(oracles.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(result.columns)
    want = result.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert norm(tuple(r) for r in found.select(*columns).collect()) == norm(want)


def test_registry():
    held = entry_point.queries()
    assert set(oracles.ORACLE_SQL) <= set(queries.QUERIES) <= set(held)
    assert set(entry_point.oracle_sql()) <= set(held)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_families_of_the_smallest_scale(spark):
    """Families, by identities of all pairs of monomers without length classes."""
    from tandemlake.operators.alignment import identities
    from tandemlake.plans import views

    rows = views.monomers(spark, DATA).collect()
    pairs = [(a, b) for k, a in enumerate(rows) for b in rows[:k]]
    pairs.sort(key=lambda p: (len(p[0].seq), len(p[1].seq)))
    x, y = [], []
    for k in range(0, len(pairs), 256):
        left, right = [a.seq for a, _ in pairs[k : k + 256]], [b.seq for _, b in pairs[k : k + 256]]
        x.extend(identities(left, right, 0.8)[0]), y.extend(identities(right, left, 0.8)[0])
    group = {r.seq_idx: r.seq_idx for r in rows}
    for (a, b), p, q in zip(pairs, x, y, strict=True):
        if min(p, q) + 1e-12 >= 0.8:
            low, high = sorted((group[a.seq_idx], group[b.seq_idx]))
            group = {k: low if v == high else v for k, v in group.items()}
    assert {r.seq_idx: r.family for r in queries.QUERIES["sequence_families"](spark, DATA).collect()} == group
