"""Run queries against their DuckDB counterparts: ``python -m tests.oracle [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """A message when the results differ, else None."""
    cols, got = table([tuple(x) for x in df.collect()], df.columns)
    cur = con.execute(sql)
    want_cols, want = table(cur.fetchall(), [d[0] for d in cur.description])
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            note = compare(df, con, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as e:  # report every query
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:40s} {time.time() - start:6.2f}s {'ok' if note is None else note}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
