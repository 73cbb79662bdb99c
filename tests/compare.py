"""Run registered queries against their reference SQL in DuckDB.

Usage: python tests/compare.py SF_DIR [key-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def canon(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        if isinstance(v, bool) or v is None:
            return repr(v)
        if hasattr(v, "asDict"):
            return cell(v.asDict())
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{cell(k)}:{cell(v[k])}" for k in sorted(v, key=str)) + "}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf: str) -> tuple[bool, str]:
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = canon(rows, df.columns), canon(want, cols)
    if a == b:
        return True, f"{len(a)} rows"
    first = next((x for x in zip(a, b) if x[0] != x[1]), None)
    differ = sum(x != y for x, y in zip(a, b))
    return False, f"{len(a)} vs {len(b)} rows, {differ} differ; first {str(first)[:600]}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "10g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls, bad = entry.oracle_sql(), 0
    for key, fn in entry.queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if key in sqls:
                ok, note = compare(spark, con, fn, sqls[key], sf)
            else:
                ok, note = True, f"{fn(spark, sf).count()} rows (no SQL)"
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - t:.1f}s {note}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
