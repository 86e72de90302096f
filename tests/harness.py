"""Compare the named queries with their SQL on DuckDB: ``python tests/harness.py SF_DIR [name ...]``."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "shape", ()):
            return tuple(cell(y) for y in x)
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return repr(float(x))
        if hasattr(x, "strftime") and hasattr(x, "hour"):
            return x.strftime("%Y-%m-%d %H:%M:%S")
        return str(x)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"


if __name__ == "__main__":
    from civicspark.oracles import statements
    from civicspark.queries import QUERIES
    from civicspark.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), statements()
    failed = []
    for name in names or QUERIES:
        t0 = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {str(e)[:1500]}", flush=True)
            failed.append(name)
            continue
        t1 = time.time()
        if name not in sql:
            print(f"{name:32s} rows {len(got):7d} spark {t1 - t0:6.2f}s  (no SQL)", flush=True)
            continue
        try:
            want = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SQL ERROR {str(e)[:800]}", flush=True)
            failed.append(name)
            continue
        t2 = time.time()
        msg = compare(got, want)
        if msg:
            failed.append(name)
        print(f"{name:32s} rows {len(got):7d} spark {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s {'OK' if not msg else msg}", flush=True)
    print("FAILED:", failed)
