"""Every registered query of the core against the SQL that it must equal, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestrata import queries as core

core.load()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_equals_sql(spark, sf_dir, duck, name):
    df = core.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    assert name in core.ORACLES
    result = duck.execute(core.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(repr([_plain(r[i]) for i in place]) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Errors of eight users, each of which points to the ones before and after it: walks of more than a million rows."""
    path = str(tmp_path_factory.mktemp("crowd"))
    e = spark.range(72_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id % 8 AS user_id", "'error' AS event_type", "1D AS value", "'{}' AS props")
    e.write.parquet(f"{path}/events.parquet")
    return path


WALKS = {"dialect_walk": "rec_paths", "dialect_walk_reverse": "rec_paths_reverse", "rec_paths_sql": "rec_paths"}


@pytest.mark.parametrize("name", sorted(WALKS))
def test_walks_have_no_row_limit(spark, crowd, name):
    digest = lambda df: df.selectExpr("count(*)", "sum(CAST(xxhash64(node, depth, path, is_cycle) AS decimal(38, 0)))").first()
    got = digest(core.QUERIES[name](spark, crowd))
    # 15 from each node, 1 + 2 + 4 + 4 + 4, but for the ends of chains
    assert 1_000_000 < got[0] < 15 * 72_000
    assert got == digest(core.QUERIES[WALKS[name]](spark, crowd))
