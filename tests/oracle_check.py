"""Run registered queries in Spark and their oracles in DuckDB and compare
row count, column names and order-insensitive values (doubles to 6 places).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Set ORACLE_JSON=<path> to also write a per-query summary as JSON, and
ORACLE_STRICT=1 to compare doubles exactly.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 6)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    t2 = time.time()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    d_types = {c: str(t) for c, t in zip(d_cols, con.sql(sql).types)}
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        if SPARK_TO_DUCK.get(st, st) != d_types[f.name]:
            return False, f"type of {f.name}: spark={st} duck={d_types[f.name]}"
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    ss, dd = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    bad = [(a, b) for a, b in zip(ss, dd) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, first: spark={str(bad[0][0])[:300]} duck={str(bad[0][1])[:300]}"
    return True, f"{len(s_rows)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from prefscope.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    failed = []
    summary = {}
    for name in names or list(qs):
        if name not in oracle:
            print(f"{name}: no oracle")
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], oracle[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg}", flush=True)
        summary[name] = {"match": ok, "detail": msg}
        if not ok:
            failed.append(name)
    print("failed:", failed)
    if os.environ.get("ORACLE_JSON"):
        import json
        with open(os.environ["ORACLE_JSON"], "w") as f:
            json.dump({"sf_dir": sf_dir, "strict": STRICT, "queries": summary}, f, indent=1)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
