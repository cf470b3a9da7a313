"""Run every registered query and its SQL side by side and compare whole results.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from vinculum.session import scratch_run

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, sf: str, run, sql: str) -> tuple[str, int]:
    """("" or what differs, rows)."""
    with scratch_run(spark):
        df = run(spark, sf)
        mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = connect(sf).execute(sql)
    columns = [d[0] for d in result.description]
    theirs = canonical(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(mine)
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:3]
        other = [r for r in theirs if r not in set(mine)][:3]
        return f"rows {len(mine)} != {len(theirs)}; only here {only}; only there {other}", len(mine)
    return "", len(mine)


def main(argv: list[str]) -> int:
    from vinculum.session import build_session
    from workload.catalog import ORACLES, QUERIES

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in ORACLES:
                problem, n = compare(spark, sf, QUERIES[name], ORACLES[name])
            else:
                problem, n = "", QUERIES[name](spark, sf).count()
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok ' if not problem else 'BAD'} {kind:4} {name:32} {n:8} rows {time.time() - started:6.1f}s {problem}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
