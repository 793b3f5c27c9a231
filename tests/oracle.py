"""Compare a Spark query with its SQL on DuckDB."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def same(spark_df, con, sql: str) -> None:
    q = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(q.columns)
    assert rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows_of(q.columns, q.fetchall())
