"""Runs queries against their DuckDB oracles: python -m tests.oracle SF_DIR [NAME ...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows_of(rows, columns) -> list:
    """Rows with columns by name, in one order."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty if the results agree, else how they differ."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    found = con.sql(sql)
    want = rows_of(found.fetchall(), found.columns)
    df = query(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    if got != want:
        extra, gone = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        return f"{len(got)} rows and {len(want)}; only ours {sorted(extra)[:3]}, only theirs {sorted(gone)[:3]}"
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tallyspark.session import build_session

    session = build_session("local[8]", 8, spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    known, oracles = queries(), oracle_sql()
    for name in sys.argv[2:] or [n for n in known if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = compare(session, sys.argv[1], name, known[name], oracles[name]) if name in oracles else f"no oracle, {known[name](session, sys.argv[1]).count()} rows"
        except Exception as error:  # noqa: BLE001
            said = "ERROR " + str(error)[:600]
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
