"""Runs registered queries next to their SQL check: ``python tests/oracle_check.py <sf_dir> [name or module…]``."""

from __future__ import annotations

import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlens.catalog import all_oracles, all_queries  # noqa: E402
from fleetlens.plans.bindings import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


TIMES: dict[str, float] = {}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value) if value is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def compare(spark, con, sf_dir: str, name: str):
    """(rows, problem or None)"""
    start = time.time()
    df = all_queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    TIMES[name] = time.time() - start
    sql = all_oracles().get(name)
    if sql is None:
        return len(got), None
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} <> {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got == want:
        return len(got), None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return len(got), f"rows {len(got)} <> {len(want)}; spark {sorted(only_got)[:2]} sql {sorted(only_want)[:2]}"


if __name__ == "__main__":
    from fleetlens.session import local_session

    spark = local_session("oracle-check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    names = []
    for arg in sys.argv[2:]:
        if arg in all_queries():
            names.append(arg)
        else:
            names += list(importlib.import_module(f"fleetlens.catalog.{arg}").GROUP.queries)
    failed = 0
    for name in names or all_queries():
        start = time.time()
        try:
            rows, problem = compare(spark, con, sys.argv[1], name)
        except Exception as error:  # noqa: BLE001
            rows, problem = -1, str(error)[:900]
        failed += problem is not None
        kind = "sql" if name in all_oracles() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32} {kind} rows={rows} spark {TIMES.get(name, -1):.1f}s all {time.time() - start:.1f}s {problem or ''}")
    print("failed", failed)
