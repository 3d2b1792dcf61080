"""Compare the registered queries with their SQL on a second engine.

    python tests/oracle_check.py [--dir DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(arrow_table):
    names = sorted(arrow_table.column_names)
    columns = [[_plain(v) for v in arrow_table[name].to_pylist()] for name in names]
    return names, sorted(zip(*columns), key=repr)


def compare(spark, connection, name, query, sql, sf_dir):
    """Returns (matches, rows, message)."""
    ours = query(spark, sf_dir).toArrow()
    theirs = connection.execute(sql).to_arrow_table()
    names, left = rows_of(ours)
    other_names, right = rows_of(theirs)
    if names != other_names:
        return False, len(left), f"columns {names} / {other_names}"
    if len(left) != len(right):
        return False, len(left), f"{len(left)} / {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return False, len(left), f"{str(a)[:300]} / {str(b)[:300]}"
    types = [
        f"{n}: {ours.schema.field(n).type} / {theirs.schema.field(n).type}"
        for n in names
        if str(ours.schema.field(n).type) != str(theirs.schema.field(n).type)
    ]
    return True, len(left), "; ".join(types)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from termloom.session import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(args.dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        started = time.time()
        if name not in oracle:
            n = queries[name](spark, args.dir).toArrow().num_rows
            print(f"rows  {name:28} {n:9} {time.time() - started:6.1f}s", flush=True)
            continue
        ok, n, message = compare(
            spark, connection, name, queries[name], oracle[name], args.dir
        )
        failed += not ok
        print(
            f"{'ok   ' if ok else 'FAIL '} {name:28} {n:9} {time.time() - started:6.1f}s {message}",
            flush=True,
        )
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
