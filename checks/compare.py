"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from datetime import date, datetime

import duckdb

from checks import oracles, queries
from terrane.session import local_session

RAW = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """One text per value, the same for equal numbers of different types."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number + 0.0:.6f}"
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def duckdb_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    for table in RAW:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    rows = rows_of(columns, found.fetchall())
    con.close()
    return sorted(columns), rows


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries.registered())
    spark = local_session()
    texts = oracles.texts()
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries.registered()[name](spark, sf_dir)
            ours = rows_of(df.columns, df.collect())
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in texts:
            print(f"rows  {name}: {len(ours)} rows, {took:.1f}s", flush=True)
            continue
        start = time.time()
        columns, theirs = duckdb_rows(sf_dir, texts[name])
        oracle = time.time() - start
        equal = columns == sorted(df.columns) and ours == theirs
        failed += not equal
        print(f"{'ok   ' if equal else 'DIFF '} {name}: {len(ours)} / {len(theirs)} rows, {took:.1f}s, sql {oracle:.1f}s", flush=True)
        if not equal:
            print("   columns", sorted(df.columns), columns)
            print("   only spark ", sorted(set(ours) - set(theirs))[:5])
            print("   only duckdb", sorted(set(theirs) - set(ours))[:5])
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
