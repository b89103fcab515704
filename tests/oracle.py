"""Holds a query's rows against DuckDB's."""

import math
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value as both engines give it; floats to nine digits."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    assert not isinstance(v, Decimal), "a decimal never hashes like a double"
    return v


def rows_of(records, names: list[str]) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in records)


def same(df, sql: str, sf_dir: str = SF) -> int:
    """Asserts equal columns and rows; gives their number."""
    cursor = connection(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows_of(df.collect(), df.columns), rows_of(cursor.fetchall(), names)
    assert mine == theirs
    return len(mine)
