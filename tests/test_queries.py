"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from rastervec.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def sql():
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return base


def norm(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, name):
    assert norm(QUERIES[name](spark, SF).toPandas()) == norm(sql.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
