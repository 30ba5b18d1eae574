"""Compare a query with its SQL in DuckDB: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.5f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def check(df, con, sql):
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]

    def close(a, b):
        try:
            return a == b or abs(float(a) - float(b)) <= 2e-5 * max(1, abs(float(b)))
        except ValueError:
            return False

    bad = [(a, b) for a, b in bad if not all(close(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]
