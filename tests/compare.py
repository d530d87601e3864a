"""Side-by-side comparison of Spark results and single-node SQL results."""

from __future__ import annotations

import glob
import math
import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return value


def spark_table(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(_plain(row[n]) for n in names) for row in df.collect()]
    return names, sorted(rows, key=repr)


def sql_table(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(row[i]) for i in order) for row in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names, ours = spark_table(df)
    other_names, theirs = sql_table(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if repr(a) != repr(b):
            return f"{a} != {b}"
    return None
