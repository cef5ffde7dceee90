"""Run registered queries against their SQL checks: ``python tests/check.py [-s SF] [name part ...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as registered  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def normal_rows(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, name: str) -> str | None:
    """What differs between the query and its check, or None."""
    df = registered.queries()[name](spark, sf_dir)
    got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    found = connect(sf_dir).execute(sql)
    columns = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    wanted = normal_rows(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    like = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for column, kind in df.dtypes:
        if like.get(kind, kind) != kinds[column]:
            return f"type of {column}: {kind} != {kinds[column]}"
    if len(got) != len(wanted):
        only_got, only_wanted = set(got) - set(wanted), set(wanted) - set(got)
        return f"{len(got)} rows != {len(wanted)}; e.g. {list(only_got)[:2]} / {list(only_wanted)[:2]}"
    if not got:
        return "no rows on either side"
    for a, b in zip(got, wanted):
        if a != b:
            return f"row {a!r:.900} != {b!r:.900}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    checked = registered.oracle_sql()
    for name in registered.queries():
        if args.names and not any(name.startswith(part) for part in args.names):
            continue
        start = time.time()
        try:
            fault = compare(spark, f"/root/testdata/sf{args.sf}", name)
        except Exception as error:  # noqa: BLE001
            fault = f"{type(error).__name__}: {str(error)[:300]} ... {str(error)[str(error).rfind("Caused by"):][:900]}"
        bad += fault is not None
        kind = "sql" if name in checked else "rows"
        print(f"{'FAIL' if fault else 'ok':5}{kind:5}{time.time() - start:6.1f}s {name} {fault or ''}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
