"""Compare a Spark result with its DuckDB oracle, value by value."""

from __future__ import annotations

import datetime
import decimal
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, decimal.Decimal)):
        return str(int(value)) if int(value) == value else str(float(value))
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def kind(name):
    name = name.lower()
    if name.startswith(("decimal", "hugeint")):
        return "decimal"
    return {"bigint": "long", "integer": "int", "varchar": "string"}.get(name, name)


def check(spark, con, query, sql, folder):
    df = query(spark, folder)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    types = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    have = {f.name: kind(f.dataType.typeName() if not f.dataType.typeName().startswith("decimal") else "decimal") for f in df.schema}
    differing = {n: (have[n], types[n]) for n in names if have[n] != types[n]}
    if got != want:
        mine, theirs = set(got), set(want)
        extra = [r for r in got if r not in theirs][:3]
        lost = [r for r in want if r not in mine][:3]
        raise AssertionError(f"{len(got)} rows vs {len(want)}\n only spark: {extra}\n only oracle: {lost}")
    return len(got), differing
