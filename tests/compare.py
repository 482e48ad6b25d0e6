"""A query's rows against DuckDB's, columns by name, rows in any order."""

from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([_plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([_plain(r[i]) for i in order] for r in data)


def against_oracle(df, sql, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())
