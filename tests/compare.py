"""Runs catalogue queries beside their SQL and compares schemas and values.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.plans.registry import load, runner  # noqa: E402
from lodestone.plans.views import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return None if math.isnan(value) else (value + 0.0)
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def loosely(value):
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def differences(spark, con, name: str, folder: str) -> str | None:
    df = runner(name)(spark, folder)
    mine = rows_of(df.columns, df.collect())
    sql = load()[name][1]
    if sql is None:
        return None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    a = [tuple(loosely(v) for v in r) for r in mine]
    b = [tuple(loosely(v) for v in r) for r in theirs]
    a.sort(key=repr), b.sort(key=repr)
    if a != b:
        in_a, in_b = set(a), set(b)
        left = [r for r in a if r not in in_b][:3]
        right = [r for r in b if r not in in_a][:3]
        return f"values differ: {sum(x != y for x, y in zip(a, b))} of {len(a)}: {left} | {right}"[:900]
    if mine != theirs:
        kinds = [(type(x).__name__, type(y).__name__) for x, y in zip(mine[0], theirs[0])]
        return f"types differ: {sorted(df.columns)} {kinds}"
    return None


def main() -> None:
    from lodestone.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args or load():
        start = time.time()
        try:
            problem = differences(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} of {len(args or load())} differ")


if __name__ == "__main__":
    main()
