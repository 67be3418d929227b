"""Run registered queries next to their DuckDB text and compare names, types and values.

    python -m tests.oracle [--sf DIR] [NAME PREFIX ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "int",
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "DOUBLE": "float", "FLOAT": "float", "double": "float", "float": "float",
    "VARCHAR": "str", "string": "str", "BOOLEAN": "bool", "boolean": "bool",
    "TIMESTAMP": "ts", "timestamp": "ts", "timestamp_ntz": "ts", "DATE": "date", "date": "date",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, (float, Decimal)):
        return float(x) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def _rows(rows, order):
    return sorted(
        (tuple(_value(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r),
    )


def compare(name, spark, con, sf, query, sql) -> str | None:
    """None if equal, otherwise what differs."""
    df = query(spark, sf)
    names = df.columns
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    got = _rows(df.collect(), [names.index(c) for c in sorted(names)])
    con.execute(sql)
    want_names = [d[0] for d in con.description]
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall() and
             [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]}
    want = _rows(con.execute(sql).fetchall(), [want_names.index(c) for c in sorted(want_names)])
    odd = {c: (kinds[c], types[c]) for c in names if kinds[c] != KINDS.get(types[c], types[c])}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        for a, b in zip(got, want):
            if a != b:
                return f"cols {sorted(names)}\n   spark {a}\n   duck  {b}"
    if not got:
        return "EMPTY"
    return None


def main(argv=None) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, q in entry.queries().items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t = time.time()
        try:
            if name in sqls:
                diff = compare(name, spark, con, a.sf, q, sqls[name])
                word = "ok  "
            else:
                n = q(spark, a.sf).count()
                diff, word = (None if n else "EMPTY"), f"rows {n}"
        except Exception as exc:  # noqa: BLE001 - report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:300]}"
        bad += diff is not None
        print(f"{word if diff is None else 'FAIL'} {name} {time.time() - t:.2f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
