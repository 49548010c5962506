"""Compare registered queries with their SQL twins; also runs alone: ``python tests/oracle.py DIR [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def difference(df, con, sql: str) -> str | None:
    cols, got = spark_rows(df)
    want_cols, want = sql_rows(con, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference:\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corpusloom import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sys.argv[1])
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sys.argv[1])
            sql = entry.oracle_sql().get(name)
            diff = difference(df, con, sql) if sql else f"(no SQL, {df.count()} rows)"
        except Exception as e:  # report and go on with the next query
            diff = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        bad += bool(diff) and not diff.startswith("(")
        print(f"{name:24s} {time.time() - start:6.1f}s {'ok' if diff is None else diff}", flush=True)
    print("bad:", bad)
