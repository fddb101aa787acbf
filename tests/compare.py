"""Run a registered query on Spark and its SQL on DuckDB and compare rows, names and types."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    return str(value)


def normalized(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both agree, else a short description of the first difference."""
    found = con.sql(sql)
    theirs, their_types = list(found.columns), [str(t) for t in found.types]
    ours = df.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} vs {sorted(theirs)}"
    kinds = dict(zip(theirs, their_types))
    odd = [f"{n}: {t} vs {kinds[n]}" for n, t in df.dtypes if TYPE_NAMES.get(t, t) != kinds[n]]
    a, b = normalized(ours, df.collect()), normalized(theirs, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} vs {y} in {sorted(ours)}; {sum(p != q for p, q in zip(a, b))} rows differ"
    return f"types: {odd}" if odd else None
