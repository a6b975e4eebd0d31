"""Compare registered queries with their SQL in DuckDB: ``python -m tests.oracle [-d DIR] [names]``."""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

from foldline.plans import catalog
from foldline.session import build_session


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def type_class(t: str) -> str:
    t = t.lower()
    for key, names in {
        "int": ("bigint", "int", "integer", "smallint", "tinyint", "long"),
        "float": ("double", "float"),
        "str": ("varchar", "string"),
        "bool": ("boolean",),
    }.items():
        if t in names:
            return key
    return t


def compare(spark, con, sf_dir: str, q) -> tuple[str, str]:
    t0 = time.time()
    df = q.run(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - t0
    if not q.sql:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows {took:.1f}s"
    described = con.execute(f"DESCRIBE {q.sql}").fetchall()
    want_types = {r[0]: r[1] for r in described}
    if sorted(want_types) != cols:
        return "COLS", f"{cols} vs {sorted(want_types)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [(c, kinds[c], want_types[c]) for c in cols if type_class(kinds[c]) != type_class(want_types[c])]
    picked = ", ".join(f'"{c}"' for c in cols)
    want = [tuple(norm(v) for v in r) for r in con.execute(f"SELECT {picked} FROM ({q.sql})").fetchall()]
    if len(got) != len(want):
        return "COUNT", f"{len(got)} vs {len(want)}"
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    try:
        got.sort(key=key)
        want.sort(key=key)
    except TypeError:
        got.sort(key=str)
        want.sort(key=str)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return "VALUE", f"{len(bad)}/{len(got)} cols={cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    note = f"{len(got)} rows {took:.1f}s" + (f" TYPES {odd}" if odd else "")
    return ("ok" if got and not odd else "EMPTY" if not got else "TYPES"), note


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-m", help="only queries of this module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.d)
    bad = 0
    for name, q in catalog.load().items():
        if args.names and name not in args.names:
            continue
        if args.m and not q.run.__module__.endswith(args.m):
            continue
        try:
            status, note = compare(spark, con, args.d, q)
        except Exception as exc:  # noqa: BLE001 - report and go on
            status, note = "ERROR", str(exc)[:1500]
            if args.names:
                traceback.print_exc()
        bad += status not in ("ok", "rows")
        print(f"{status:6} {name} {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
