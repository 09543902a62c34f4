"""Comparison of a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

SF = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def plain(value):
    """A value both engines agree on: floats by nine significant digits, times without a zone, lists as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def spark_rows(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    rows = Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    con.close()
    return [names[k] for k in order], rows


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, want = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = spark_rows(df)
    assert sum(got.values()) == sum(want.values())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
