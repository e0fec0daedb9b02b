"""Compare a registered query with its SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) and glob.glob(f"{p}/*.parquet") else p
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf: str) -> tuple[list, list]:
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    return got, want


def main() -> None:
    import __spark_entry__ as e
    from factloom.session import get_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, queries = duck(sf), e.oracle_sql(), e.queries()
    for name in names or queries:
        began = time.time()
        try:
            if name not in sql:
                n = queries[name](spark, sf).count()
                print(f"{name}: rows only, {n} rows, {time.time() - began:.1f} s", flush=True)
                continue
            got, want = compare(spark, con, queries[name], sql[name], sf)
            print(f"{name}: {'same' if got == want else 'DIFFERENT'}, {len(got)} and {len(want)} rows, {time.time() - began:.1f} s", flush=True)
            if got != want:
                print("  only here:", list(set(got) - set(want))[:4], "\n  only there:", list(set(want) - set(got))[:4])
        except Exception as x:  # noqa: BLE001
            print(f"{name}: FAILED {type(x).__name__} {str(x)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
