"""Run every named query next to its SQL in DuckDB and compare columns, row counts and values.

    python tools/check.py [folder] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from odweave.catalog import QUERIES, SQL  # noqa: E402
from odweave.catalog.fixtures import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", v)
    return v


def kind(v):
    return {bool: "bool", int: "int", float: "float", str: "str", Decimal: "decimal"}.get(type(v), type(v).__name__)


def compare(spark_df, cur) -> str | None:
    """None when equal, else what differs."""
    rows = spark_df.collect()
    cols = spark_df.columns
    got = cur.fetchall()
    names = [d[0] for d in cur.description]
    if sorted(cols) != sorted(names):
        return f"columns {cols} vs {names}"
    if len(rows) != len(got):
        return f"rows {len(rows)} vs {len(got)}"
    order = [names.index(c) for c in cols]
    if not rows:
        return "no rows" if not got else None
    for i, c in enumerate(cols):
        a = {kind(r[i]) for r in rows} - {"NoneType"}
        b = {kind(g[order[i]]) for g in got} - {"NoneType"}
        if a != b:
            return f"type of {c}: {a} vs {b}"
    left = Counter(tuple(norm(v) for v in r) for r in rows)
    right = Counter(tuple(norm(g[i]) for i in order) for g in got)
    if left != right:
        return f"values: {list((left - right).items())[:2]} vs {list((right - left).items())[:2]}"
    return None


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def main() -> int:
    from odweave.session import get_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    keys = args[1:] or list(QUERIES)
    spark = get_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = QUERIES[key](spark, folder)
            problem = compare(df, con.execute(SQL[key])) if key in SQL else f"no SQL, {df.count()} rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {time.time() - start:6.2f}s {key} {problem or ''}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
