"""Run bound queries next to their SQL in an in-process DuckDB and compare.

``python -m gapwright.bindings.check [folder] [name prefix ...]``
"""

from __future__ import annotations

import sys
import time
import traceback

from gapwright.bindings.catalog import ORACLE, QUERIES, oracle_text
from gapwright.bindings.standins import TABLES


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    df = QUERIES[name](spark, folder)
    ours = _rows(df.columns, [tuple(row) for row in df.collect()])
    if name not in ORACLE:
        return None if ours else "no rows"
    cur = con.execute(oracle_text(ORACLE[name]))
    names = [c[0] for c in cur.description]
    theirs = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        return f"{len(ours)} and {len(theirs)} rows; only Spark {list(a - b)[:2]}; only SQL {list(b - a)[:2]}"
    if not ours:
        return "no rows on either side"
    for a, b in zip(ours, theirs):
        if repr(a) != repr(b):
            return f"{sorted(names)}\n   {a}\n   {b}"
    return None


def main(argv: list[str]) -> int:
    import gapwright.bindings.load  # noqa: F401
    from gapwright.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(), database(folder)
    bad = 0
    for name in QUERIES:
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, folder, name)
        except Exception as e:  # report and go on with the next query
            diff = "".join(traceback.format_exception_only(e))[:700]
        bad += diff is not None
        kind = "" if name in ORACLE else " (rows only)"
        print(f"{'ok  ' if diff is None else 'DIFF'} {name}{kind} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
