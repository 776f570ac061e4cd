"""Run a registered query in Spark and its SQL in DuckDB, and compare rows and types.

As a script: ``python tests/compare.py [table directory] [query names...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def sort_key(row):
    return tuple("" if v is None else v for v in row)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    columns = sorted(spark_df.columns)
    got = [tuple(cell(r[c]) for c in columns) for r in spark_df.collect()]
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    if sorted(names) != columns:
        return f"columns differ: {sorted(set(names) ^ set(columns))}"
    order = [names.index(c) for c in columns]
    want = [tuple(cell(r[i]) for i in order) for r in answer.fetchall()]
    for f in spark_df.schema.fields:
        if (types[f.name] in ("DOUBLE", "FLOAT", "HUGEINT") or types[f.name].startswith("DECIMAL")) != (
            f.dataType.simpleString() == "double"
        ):
            return f"type differs: {f.name} {f.dataType.simpleString()} / {types[f.name]}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)}, oracle {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if wrong:
        g, w = wrong[0]
        cols = [(c, a[:80] if a else a, b[:80] if b else b) for c, a, b in zip(columns, g, w, strict=True) if a != b]
        return f"{len(wrong)} of {len(got)} rows differ, first: {cols[:6]} in {[x[:40] if x else x for x in g[:4]]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = oracle_connection(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            why = difference(df, con, oracles[name]) if name in oracles else None
            n = df.count() if name not in oracles else ""
        except Exception as e:  # noqa: BLE001
            why, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {n} {time.time() - start:.2f}s {why or ''}", flush=True)
    print(f"{bad} failing")
