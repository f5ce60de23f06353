"""Run registered queries and compare each with its SQL statement in DuckDB.

python tests/compare.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from tallyline.plans.bindings import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = canonical(spark_df.columns, got), canonical(names, want)
    if a == b:
        return None
    extra = [x for x in a if x not in set(b)][:3]
    lacking = [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} vs {len(b)}; columns {sorted(names)}; only spark {extra}; only sql {lacking}"


def main() -> int:
    from tallyline.session import local_session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = differences(fn(spark, folder), con, oracles[name])
            else:
                problem = None if fn(spark, folder).collect() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        tag = "ok  " if problem is None else "FAIL"
        note = "" if name in oracles else " (rows only)"
        print(f"{tag} {name}{note} {time.time() - start:.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
