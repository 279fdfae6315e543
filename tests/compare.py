"""Holds a registered query against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(v[i] for i in order) for v in values], key=repr)


def differences(spark, con, folder: str, query, sql: str) -> list:
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows([c[0] for c in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return [mine[0], theirs[0]]
    if len(mine[1]) != len(theirs[1]):
        return [len(mine[1]), len(theirs[1]), *list(set(mine[1]) ^ set(theirs[1]))[:4]]
    return [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b][:3]
