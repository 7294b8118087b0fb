"""Compare every query with its SQL on one scale factor (not a unit test).

Usage: python tests/check_oracles.py /root/testdata/sf0.01 [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in (row[i] for i in order)))
    return sorted(out)


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = fn(spark, sf)
            got = canonical([tuple(r) for r in df.collect()], df.columns)
            took = time.time() - started
            if name not in sql:
                print(f"{'ROWS':5} {name} {len(got)} {took:.1f}s", flush=True)
                continue
            cur = con.execute(sql[name])
            names_sql = [c[0] for c in cur.description]
            want = canonical(cur.fetchall(), names_sql)
            same = got == want and sorted(df.columns) == sorted(names_sql)
            print(f"{'OK' if same else 'BAD':5} {name} {len(got)} {len(want)} {took:.1f}s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns), sorted(names_sql))
                extra, missing = set(got) - set(want), set(want) - set(got)
                print("   only spark", sorted(extra)[:3])
                print("   only sql  ", sorted(missing)[:3], flush=True)
        except Exception as error:
            bad += 1
            print(f"ERROR {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
