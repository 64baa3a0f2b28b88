"""Run registered queries beside their SQL: ``python tests/check_queries.py [folder] [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


def duckdb_with_tables(folder):
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, folder, name):
    """(ok, message) for one query."""
    frame = contract.queries()[name](spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return len(ours[1]) > 0, f"{len(ours[1])} rows, no SQL"
    cursor = con.execute(sql)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    types = dict(frame.dtypes), [str(c[1]) for c in cursor.description]
    if ours != theirs:
        different = [p for p in zip(ours[1], theirs[1]) if p[0] != p[1]][:3]
        return False, f"{len(ours[1])} vs {len(theirs[1])} rows; {ours[0]} vs {theirs[0]}; {different}"
    return True, f"{len(ours[1])} rows {types}"


if __name__ == "__main__":
    from lacuna.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_with_tables(folder)
    bad = []
    for name in sys.argv[2:] or contract.queries():
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if ok else 'BAD'} {time.time() - start:6.2f}s {name}: {message}", flush=True)
        bad += [] if ok else [name]
    print("all match" if not bad else f"not matching: {bad}")
    sys.exit(bool(bad))
