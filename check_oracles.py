"""Run registered queries against their oracle SQL: python check_oracles.py [sf] [key ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return f"{x:.6f}"
        if x.__class__.__name__ == "Decimal":
            return f"{float(x):.6f}"
        if isinstance(x, (list, tuple)):
            return str([cell(y) for y in x])
        return str(x)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, sf_dir) -> str:
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    t1 = time.time()
    if entry.sql is None:
        return f"rows={len(got[1])} no oracle {t1 - t0:.1f}s"
    cur = con.execute(entry.sql)
    want = normal(cur.fetchall(), [c[0] for c in cur.description])
    t2 = time.time()
    note = f"rows={len(got[1])} spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if got[0] != want[0]:
        return f"MISMATCH columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        return f"MISMATCH {note} want={len(want[1])}\n  columns {got[0]}\n  missing {missing}\n  extra {extra}"
    return f"ok {note}"


def main() -> None:
    from assaykit.plans.catalog import load
    from assaykit.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf{sf}"
    catalog = load()
    keys = sys.argv[2:] or list(catalog)
    spark = local_session(app="check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key in keys:
        try:
            note = compare(spark, con, catalog[key], sf_dir)
        except Exception as error:  # noqa: BLE001
            note = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += not note.startswith(("ok", "rows"))
        print(f"{key}: {note}", flush=True)
    print(f"{len(keys)} keys, {bad} bad")


if __name__ == "__main__":
    main()
