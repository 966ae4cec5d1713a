"""Compare a Spark result with a DuckDB result: columns by name, rows as a bag."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


_KIND = {
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "hugeint", "DOUBLE": "float", "VARCHAR": "string", "DATE": "date",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp",
    "bigint": "int", "int": "int", "double": "float", "string": "string", "date": "date", "boolean": "boolean",
    "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between both results; empty when they agree."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    types = dict(con.execute("DESCRIBE " + sql).fetchall() and [(r[0], r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()])
    problems = []
    if sorted(columns) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(columns)}"]
    for name, kind in spark_df.dtypes:
        if _KIND.get(kind, kind) != _KIND.get(types[name], types[name]):
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    ours = _bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = _bag(columns, rows)
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        problems.append(
            f"rows {sum(ours.values())} vs {sum(theirs.values())}; only here {list(extra)[:2]}; only oracle {list(missing)[:2]}"
        )
    return problems
