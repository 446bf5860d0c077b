"""Compare each query that has DuckDB SQL with it, row for row, and print the time each took.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a query's result; empty if nothing does."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}"]
    return [f"{g} against {w}" for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]


def main() -> None:
    import __spark_entry__ as contract

    from tiercurve.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    for name in sys.argv[2:] or oracles:
        start = time.time()
        df = queries[name](spark, sf_dir)
        wrong = differences(df, con, oracles[name])
        state = "ok" if not wrong else f"{len(wrong)} DIFFER: {wrong[:2]}"
        print(f"{name:34s} {time.time() - start:6.2f}s {df.count() if wrong else ''} {state}", flush=True)


if __name__ == "__main__":
    main()
