"""Every registered query against its SQL on the supplied tables."""

import math

import duckdb
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows_of(records):
    return sorted(([(k, plain(v)) for k, v in sorted(r.items())] for r in records), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = [r.asDict(recursive=True) for r in catalogue.queries()[name](spark, DATA).collect()]
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert want, "the SQL finds nothing to compare"
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).collect()
