"""Compare registered queries with their oracles on one folder of tables.

``python -m tidemark.plans.check <sf_dir> [name ...]``
"""

from __future__ import annotations

import sys
import time

import duckdb

from tidemark.plans.views import TABLES
from tidemark.session import build_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, q) -> str:
    start = time.time()
    df = q.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = q.sql()
    if sql is None:
        return f"ROWS {len(rows)} {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    other = cur.fetchall()
    oracle = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {df.columns} {cols}"
    a, b = normal(rows, df.columns), normal(other, cols)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"FAIL {len(a)} vs {len(b)} rows {took:.1f}s {sorted(cols)} {bad}"
    return f"OK {len(a)} rows {took:.1f}s (oracle {oracle:.1f}s)"


def main() -> None:
    from tidemark.plans import load

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    queries = load()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, q in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            print(name, compare(spark, con, sf_dir, name, q), flush=True)
        except Exception as e:  # noqa: BLE001 - report every query
            print(name, "ERROR", str(e)[:1500], flush=True)


if __name__ == "__main__":
    main()
