"""Rows of a Spark query against those of DuckDB SQL: names, kinds and values."""

import datetime
import decimal
import math

import duckdb

from sparkloft.sources.tables import TABLES


def plain(x):
    """A value that equals only values of its own kind."""
    if x is None:
        return ("null",)
    if isinstance(x, bool):
        return ("bool", x)
    if isinstance(x, int):
        return ("int", x)
    if isinstance(x, float):
        return ("float", "nan" if math.isnan(x) else f"{x + 0.0:.9g}")
    if isinstance(x, decimal.Decimal):
        return ("decimal", str(x.normalize()))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return ("time", str(x))
    if isinstance(x, (list, tuple)):
        return ("list", *map(plain, x))
    return (type(x).__name__, str(x))


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(df, sql: str, sf_dir: str) -> int:
    """The number of rows; fails if they differ."""
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall())
    got = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, wrong[:3]
    return len(got)
