"""Run registered queries in Spark and their SQL in DuckDB and compare every row.

Usage: python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)]
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
        if isinstance(v, float):
            return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
        return str(v)
    rows = [tuple(cell(v) for v in row) for row in pdf.itertuples(index=False, name=None)]
    return list(pdf.columns), sorted(rows)


def same_plain(a, b):
    """Fast path for wide results of plain numbers: sorted values are identical."""
    if sorted(a.columns) != sorted(b.columns) or len(a) != len(b) or a.empty:
        return False
    cols = sorted(a.columns)
    if not all(pd.api.types.is_numeric_dtype(f[c]) for f in (a, b) for c in cols):
        return False
    ordered = [f[cols].astype("float64").sort_values(cols).to_numpy() for f in (a, b)]
    return bool((ordered[0] == ordered[1]).all())


def diff(spark_pdf, duck_pdf):
    """None when equal, otherwise a short description."""
    if same_plain(spark_pdf, duck_pdf):
        return None
    c1, r1 = canonical(spark_pdf)
    c2, r2 = canonical(duck_pdf)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    if not r1:
        return "no rows"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    return f"{len(bad)} of {len(r1)} rows differ {c1}: {bad[:3]}" if bad else None


def main(argv):
    import __spark_entry__ as entry
    from lumatable.plans.session import build_session

    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = argv[0], argv[1:]
    con = duck(sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in qs:
        if names and name not in names:
            continue
        try:
            t0 = time.time()
            sdf = qs[name](spark, sf)
            got = sdf.toPandas()
            t1 = time.time()
            if name not in sql:
                print(f"rows  {name:28s} {len(got):8d} rows  spark {t1-t0:6.2f}s", flush=True)
                continue
            rel = con.sql(sql[name])
            types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            want = rel.df()
            t2 = time.time()
            why = diff(got, want)
            short = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            off = [
                (c, t, types.get(c)) for c, t in sdf.dtypes
                if t in short and types.get(c) and short[t] != types[c]
            ]
            mark = "ok   " if why is None else "FAIL "
            failed += why is not None
            print(f"{mark} {name:28s} {len(got):8d} rows  spark {t1-t0:6.2f}s duck {t2-t1:6.2f}s {'types '+str(off) if off else ''} {why or ''}", flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            failed += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
