"""Compare registered queries with their SQL on the Parquet tables: python tests/parity.py [sf] [key ...]."""

from __future__ import annotations

import os
import sys
import time

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def rows_of(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def compare(spark_pdf, duck_pdf) -> str:
    """Empty when equal, else what differs."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    if len(a) != len(b):
        extra = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)} e.g. {extra}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, e.g. {sorted(spark_pdf.columns)} {diff[:2]}"
    types = {c: (str(spark_pdf[c].dtype), str(duck_pdf[c].dtype)) for c in spark_pdf.columns}
    odd = {c: t for c, t in types.items() if t[0] != t[1] and not (len(a) == 0)}
    odd = {c: t for c, t in odd.items() if {t[0], t[1]} not in ({"object", "str"}, {"object", "string"}, {"int32", "int64"}, {"bool", "boolean"})}
    return f"types {odd}" if odd else ""


def main(argv: list[str]) -> int:
    from parcelwatt.session import build_session

    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        t0 = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            t1 = time.time()
            note = compare(got, con.execute(oracle[name]).df()) if name in oracle else "(rows only)"
        except Exception as error:  # noqa: BLE001
            t1, got, note = time.time(), [], f"{type(error).__name__}: {str(error)[:700]}"
        if "Connection refused" in note:
            print("the session is gone at", name)
            return 1
        ok = note in ("", "(rows only)")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:24s} {len(got):7d} rows {t1 - t0:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
