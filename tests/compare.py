"""Run registered queries against their DuckDB oracle: python -m tests.compare [sf] [names...]"""

from __future__ import annotations

import importlib
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalise(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.reindex(sorted(pdf.columns), axis=1).copy()
    for c in pdf.columns:
        s = pdf[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            pdf[c] = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(s):
            pdf[c] = s.map(lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0))
        elif pd.api.types.is_integer_dtype(s) or pd.api.types.is_bool_dtype(s):
            pdf[c] = s.astype(str).replace("<NA>", "null")
        else:
            pdf[c] = s.map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v))
                           else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: pdf[c].dtype.kind for c in sorted(pdf.columns)}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    # pandas holds whole numbers with nulls as floats, DuckDB as Int64
    whole = [c for c in want.columns if want[c].dtype == "Int64" and got[c].dtype.kind in "fi"]
    got = got.astype({c: "Int64" for c in whole})
    if len(got) and kinds(got) != kinds(want):
        bad = {c: (k, kinds(want)[c]) for c, k in kinds(got).items() if kinds(want)[c] != k}
        return f"dtype {bad}"
    a, b = normalise(got), normalise(want)
    if not a.equals(b):
        diff = (a != b).any(axis=1)
        cols = [c for c in a.columns if (a[c] != b[c]).any()]
        i = diff[diff].index[:3]
        return (f"{int(diff.sum())} rows differ in {cols}\n{a.loc[i].to_string(max_colwidth=40)}"
                f"\n--- oracle\n{b.loc[i].to_string(max_colwidth=40)}")
    return None


def main(argv: list[str]) -> int:
    from floodwatch.session import build_session
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark = build_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
        except Exception as exc:  # report and go on to the next query
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
            failed += 1
            continue
        took = time.time() - t
        if name not in oracles:
            print(f"rows {name}: {len(got)} ({took:.1f}s)", flush=True)
            continue
        try:
            t = time.time()
            problem = difference(got, con.execute(oracles[name]).df())
        except Exception as exc:
            problem = f"oracle {type(exc).__name__} {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got)} rows ({took:.1f}s, oracle {time.time()-t:.1f}s) {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
