"""Run a registered query on Spark and its SQL on DuckDB and compare the rows.

``python tests/compare.py [sf_dir] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(v + 0.0))
    if isinstance(v, bool):
        return (2, str(int(v)))
    return (2, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, key, build, oracle):
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if oracle is None:
        return f"rows-only {len(got)}", True
    rel = con.execute(oracle)
    names = [d[0] for d in rel.description]
    kinds = [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS differ: {df.columns} / {names}", False
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    fits = {"bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}}
    bad = {n: (ours[n], k) for n, k in zip(names, kinds) if k not in fits.get(ours[n], {k})}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        set_a, set_b = set(a), set(b)
        only_a = [r for r in a if r not in set_b][:3]
        only_b = [r for r in b if r not in set_a][:3]
        return f"ROWS differ {len(a)}/{len(b)}\n   spark {only_a}\n   duck  {only_b}", False
    if bad:
        return f"TYPES differ {bad}", False
    return f"ok {len(a)}", True


def main(argv):
    import __spark_entry__ as entry
    from tablewright.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [k for k in queries if not argv[1:] or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv[1:])]
    failed = []
    for key in picked:
        start = time.time()
        try:
            text, fine = compare(spark, con, sf_dir, key, queries[key], oracles.get(key))
        except Exception as e:  # noqa: BLE001
            text, fine = f"ERROR {type(e).__name__}: {str(e)[:1200]}", False
        if not fine:
            failed.append(key)
        print(f"{key:32s} {time.time() - start:6.2f}s {text}", flush=True)
    print(f"{len(picked) - len(failed)}/{len(picked)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
