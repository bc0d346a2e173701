"""Runs a query's SQL in DuckDB over a folder of Parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(rows, sql, sf_dir):
    """Spark rows against DuckDB's, order aside, columns by name."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    got = [r.asDict(recursive=True) for r in rows]
    assert len(got) == len(want), (len(got), len(want))
    if got:
        assert sorted(got[0]) == sorted(names), (sorted(got[0]), sorted(names))
    key = lambda r: [(k, str(type(v)) if v is None else "", _plain(v)) for k, v in sorted(r.items())]
    a, b = sorted(map(key, got), key=str), sorted(map(key, want), key=str)
    for x, y in zip(a, b, strict=True):
        assert x == y, (x, y)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [_plain(x) for x in v] if isinstance(v, list) else v
