"""Side-by-side check of a Spark query and its SQL twin on the same Parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: _cell(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_cell(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([_cell(r[i]) for i in order]) for r in rows))


def kind(t: str) -> str:
    t = t.lower()
    for prefix, k in (
        ("array", "list"), ("struct", "struct"), ("bigint", "int"), ("int", "int"), ("smallint", "int"),
        ("hugeint", "hugeint"), ("double", "float"), ("float", "float"), ("decimal", "decimal"),
        ("varchar", "string"), ("string", "string"), ("bool", "bool"), ("timestamp", "timestamp"), ("date", "date"),
    ):
        if t.endswith("[]"):
            return "list"
        if t.startswith(prefix):
            return k
    return t


def difference(df, con, text: str) -> str | None:
    """None when schema kinds and all rows agree, else a short description."""
    rel = con.sql(text)
    want_kinds = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    got_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    if want_kinds != got_kinds:
        return f"schema: spark {got_kinds} sql {want_kinds}"
    want = _rows(rel.columns, rel.fetchall())
    got = _rows(df.columns, df.collect())
    if len(want) != len(got):
        return f"rows: spark {len(got)} sql {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"values: spark {a[:400]} sql {b[:400]} (and maybe more)"
    return None
