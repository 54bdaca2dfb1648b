"""Run registered queries and compare them with their SQL on the same tables.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if not isinstance(v, bool) else ("true" if v else "false")


def rows_by_name(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) if r[i] is not None else None for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL; empty when they agree."""
    result = con.execute(sql)
    names, types = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    want = rows_by_name(names, result.fetchall())
    got = rows_by_name(df.columns, df.collect())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if sum(got.values()) != sum(want.values()):
        problems.append(f"rows {sum(got.values())} != {sum(want.values())}")
    if got != want:
        problems.append(f"only Spark {list((got - want).items())[:2]}")
        problems.append(f"only SQL {list((want - got).items())[:2]}")
    expected = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
    spark_types = dict(df.dtypes)
    for name, t in zip(names, types):
        if t in expected and spark_types.get(name) not in (expected[t], None):
            problems.append(f"type of {name}: {spark_types[name]} != {t}")
        if t.startswith("DECIMAL") and spark_types.get(name) == t.lower():
            continue
        if t not in expected and not t.startswith("TIMESTAMP"):
            problems.append(f"type of {name} in SQL is {t}")
    return problems


def main() -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from tabulyse.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = build_session(cores=8), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                problems = differences(df, con, ORACLE[name])
                verdict = "ok" if not problems else "DIFFERS"
            else:
                problems, verdict = [], f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            problems, verdict = [str(e)[:1500]], "FAILED"
        failed += verdict in ("DIFFERS", "FAILED")
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
        for p in problems:
            print("    ", p[:1500], flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
