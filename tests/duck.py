"""Comparison of a Spark result with DuckDB's answer over the same tables."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(str([_plain(v) for v in r]) for r in df.select(*names).collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[str]]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(str([_plain(r[i]) for i in order]) for r in got.fetchall())


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value
