"""Run registered queries and compare them with their DuckDB statements.

Usage: python tests/compare.py [folder] [name ...]   (name may be a prefix ending in *)
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck_tables(folder: str) -> duckdb.DuckDBPyConnection:
    from sheafwork.plans.registry import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> tuple[str, float]:
    """'ok', 'rows N' without a statement, or a description of the difference."""
    import __spark_entry__ as entry

    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return (f"rows {len(got)}" if got else "EMPTY"), took
    cur = con.execute(sql)
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", took
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return (f"ok {len(a)}" if a else "EMPTY"), took
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"DIFF spark {len(a)} duck {len(b)}\n   spark {str(only_a)[:700]}\n   duck  {str(only_b)[:700]}", took


def main() -> None:
    from sheafwork.plans import QUERIES
    from sheafwork.session import build_session

    folder, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"), sys.argv[2:]
    chosen = [n for n in QUERIES if not names or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) or
                                                     QUERIES[n].run.__module__.endswith(p) for p in names)]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_tables(folder)
    bad = 0
    for n in chosen:
        try:
            verdict, took = compare(spark, con, folder, n)
        except Exception as exc:  # noqa: BLE001
            verdict, took = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{n:28s} {took:6.2f}s {verdict}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")


if __name__ == "__main__":
    main()
