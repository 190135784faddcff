"""Compare a registered Spark query with its DuckDB oracle (the driver's correctness gate).

Columns are sorted by name, rows are compared as multisets; doubles must match exactly
unless ``rel`` is given.  Run as ``python -m tests.oracle [sf_dir] [key ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    rows = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, (dict,)) else str(x)) for x in r))


def _eq(a, b, rel: float) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            a, b = float(a), float(b)
        except (TypeError, ValueError):
            return False
        return a == b if rel == 0 else math.isclose(a, b, rel_tol=rel, abs_tol=rel)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_eq(x, y, rel) for x, y in zip(a, b))
    return a == b or str(a) == str(b)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, rel: float = 0.0) -> list[str]:
    errs = []
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        errs.append(f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}")
        return errs
    if len(spark_pdf) != len(duck_pdf):
        errs.append(f"row count {len(spark_pdf)} vs {len(duck_pdf)}")
    a, b = _rows(spark_pdf), _rows(duck_pdf)
    bad = 0
    for ra, rb in zip(a, b):
        if not all(_eq(x, y, rel) for x, y in zip(ra, rb)):
            bad += 1
            if bad <= 3:
                errs.append(f"row differs:\n  spark {ra}\n  duck  {rb}")
    if bad:
        errs.append(f"{bad} differing rows (cols {sorted(spark_pdf.columns)})")
    return errs


def check(spark, sf_dir: str, key: str, rel: float = 0.0) -> tuple[list[str], float]:
    from custlens.plans.registry import ORACLES, QUERIES
    t0 = time.time()
    sp = QUERIES[key](spark, sf_dir).toPandas()
    dt = time.time() - t0
    if key not in ORACLES:
        return [], dt
    dk = duck(sf_dir).sql(ORACLES[key]).df()
    return compare(sp, dk, rel), dt


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__  # noqa: F401  (registers queries)
    from custlens.plans.registry import ORACLES, QUERIES
    from custlens.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark = build_session()
    failed = 0
    for k in keys:
        try:
            errs, dt = check(spark, sf_dir, k)
        except Exception as e:  # report and continue
            errs, dt = [f"{type(e).__name__}: {str(e)[:600]}"], 0.0
        tag = "ORACLE" if k in ORACLES else "rows"
        print(f"{'FAIL' if errs else 'ok  '} {k:32s} {tag:6s} {dt:6.2f}s")
        for e in errs:
            print("     ", e)
        failed += bool(errs)
    print(f"{failed} failed of {len(keys)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
