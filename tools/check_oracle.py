"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/check_oracle.py SF_DIR [name ...]
"""

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from twinscript.catalog import CATALOG  # noqa: E402
from twinscript.session import build_session, drop_stages  # noqa: E402


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return float(f"{v:.12g}")
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    cores = os.environ.get("CHECK_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="check-oracle-")
    spark = build_session(
        "check", f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    bad = []
    for name in names or CATALOG:
        fn, sql = CATALOG[name]
        drop_stages(spark)
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            cols, mine = rows_of(df.columns, got)
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            if sql is None:
                print(f"{name:40s} rows-only {len(mine)}  {t1 - t0:.2f}s", flush=True)
                continue
            res = con.execute(sql)
            ocols = [d[0] for d in res.description]
            otypes = {d[0]: str(d[1]) for d in res.description}
            ocols, theirs = rows_of(ocols, res.fetchall())
            ok = cols == ocols and mine == theirs
            note = "" if mine else " EMPTY"
            print(f"{name:40s} {'ok ' if ok else 'BAD'} {len(mine)}{note} spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s", flush=True)
            clash = {c: (types[c], otypes.get(c)) for c in types
                     if {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}.get(types[c]) != otypes.get(c)}
            if clash:
                print("    types", clash)
            if not ok:
                bad.append(name)
                print("   ", cols, ocols, len(mine), len(theirs))
                a, b = set(map(repr, mine)), set(map(repr, theirs))
                for r in sorted(a - b)[:3]:
                    print("    spark only", r[:600])
                for r in sorted(b - a)[:3]:
                    print("    duck only ", r[:600])
        except Exception:
            bad.append(name)
            print(f"{name:40s} ERROR")
            print("   ", "\n    ".join(traceback.format_exc().splitlines()[-12:])[:1800], flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
