"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


def compare(spark, con, name, queries, oracle, d):
    """None when equal, else what differs."""
    df = queries[name](spark, d)
    spark_rows = [tuple(r) for r in df.collect()]
    if name not in oracle:
        return None if spark_rows else "no rows"
    cur = con.execute(oracle[name])
    duck_names = [c[0] for c in cur.description]
    duck_rows = cur.fetchall()
    if sorted(duck_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(duck_names)}"
    a, b = rows_of(df.columns, spark_rows), rows_of(duck_names, duck_rows)
    if a == b:
        return None
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} vs {len(b)}; spark only {only_a}; duckdb only {only_b}"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from prosa.session import build_session
    sf = sys.argv[1]
    picked = sys.argv[2:]
    d = f"/root/testdata/{sf}"
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if picked and not any(p in name for p in picked):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, queries, oracle, d)
        except Exception as e:  # report and go on
            result = f"{type(e).__name__}: {str(e)[:600]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {time.time() - start:6.2f}s {name}"
              f"{'' if name in oracle else ' (rows only)'}{'' if result is None else '  ' + result}", flush=True)
    print("bad:", bad)
