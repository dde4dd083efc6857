"""Runs a catalogue query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        f = float(value)
        return None if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "tolist"):
        return norm(value.tolist())
    return value


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(norm(r[c]) for c in cols) for r in df.collect()]


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], rows, types


def key(row):
    """Order by the exact values first, so near-equal doubles cannot swap rows."""
    exact = tuple((v is None, str(v)) for v in row if not isinstance(v, float))
    return exact + tuple((False, f"{v:+.8e}") for v in row if isinstance(v, float))


def compare(df, sql: str, sf_dir: str) -> tuple[bool, str]:
    scols, srows = spark_rows(df)
    dcols, drows, types = duck_rows(sql, sf_dir)
    if scols != dcols:
        return False, f"columns {scols} != {dcols}"
    if len(srows) != len(drows):
        return False, f"rows {len(srows)} != {len(drows)}"
    s, d = sorted(srows, key=key), sorted(drows, key=key)
    for a, b in zip(s, d):
        if a != b:
            for x, y in zip(a, b):
                if x != y and not (isinstance(x, float) and isinstance(y, float)
                                   and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)):
                    return False, f"spark {a}\n duck {b}"
    kinds = {n: t for n, t in df.dtypes}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    bad = [(c, kinds[c], types[c]) for c in scols
           if kinds[c] in pairs and pairs[kinds[c]] != types[c]
           and not types[c].startswith("STRING")]
    return True, f"{len(s)} rows" + (f" TYPES {bad}" if bad else "")
