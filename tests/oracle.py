"""Runs named queries and their SQL side by side: ``python tests/oracle.py [sf_dir] [name ...]``."""

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in places) for row in rows]
    return [columns[i] for i in places], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def kinds(df):
    same = {"int": "integer", "bigint": "bigint", "string": "varchar", "double": "double", "date": "date"}
    return {c: same.get(k, k) for c, k in df.dtypes}


def compare(df, con, sql):
    """None when equal, else a short text."""
    left_cols, left = ordered(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    right_kinds = {c: str(t).lower() for c, t in zip(rel.columns, rel.types)}
    right_cols, right = ordered(rel.columns, rel.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    types = kinds(df)
    odd = {c: (types[c], right_kinds[c]) for c in types if types[c] != right_kinds[c]}
    if odd:
        return f"types {odd}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {str(left_cols)} {str(bad[0])[:600]}"
    return None


def main():
    import __spark_entry__ as entry
    from newstape.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {df.count()}"
        except Exception as error:  # report and go on
            state = "ERROR " + str(error)[:700].replace("\n", " ")
        if state.startswith(("DIFF", "ERROR")):
            failed.append(name)
        print(f"{time.time() - began:6.1f}s {name}: {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
