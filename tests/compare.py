"""A query against its SQL on DuckDB, as multisets of rows."""

from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return x


def bag(rows, names):
    order = sorted(names)
    return Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)


def duck(sql: str, sf: str, **frames):
    con = duckdb.connect()
    con.execute("set threads = 8")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, frame in frames.items():
        con.execute(f"drop view if exists {name}")
        con.register(name, frame)
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(df, sql: str, sf: str) -> None:
    names, rows = duck(sql, sf)
    assert sorted(df.columns) == sorted(names)
    mine, theirs = bag(df.collect(), df.columns), bag(rows, names)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
