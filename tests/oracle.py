"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [name prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(directory: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    if hasattr(value, "asDict"):
        return normal(value.asDict())
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return repr(value)


def compare(spark, connection, directory: str, run, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = run(spark, directory)
    mine = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"

    def table(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(normal(r[i]) for i in order) for r in rows)

    a, b = table(df.columns, mine), table(names, theirs)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first {str(bad[0])[:600]}"
    return None


def main():
    from keyspan.plans import oracle_sql, queries
    from keyspan.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    directory = f"/root/testdata/sf{scale}"
    spark = local_session(8)
    connection = duck(directory)
    sql = oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, connection, directory, run, sql[name])
            else:
                rows = run(spark, directory).count()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {time.time() - start:6.2f}s {name}", problem or "", flush=True)
        bad += problem is not None
    print("bad:", bad)


if __name__ == "__main__":
    main()
