"""Runs named queries on Spark and their SQL on DuckDB, and compares the rows.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set memory_limit = '8GB'; set temp_directory = ''")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    return repr(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(df, con, sql) -> str | None:
    """None when both sides hold the same columns, types and rows."""
    relation = con.sql(sql)
    types = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    wrong = {n: (t, types.get(n)) for n, t in df.dtypes if types.get(n) != SQL_TYPES.get(t)}
    if wrong:
        return f"types {wrong}"
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    want_rows = expected.fetchall()
    got_rows = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = _sorted_rows(df.columns, got_rows), _sorted_rows(names, want_rows)
    if got == want:
        return None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return (
        f"rows {len(got)} vs {len(want)}; spark only {len(only_got)} {sorted(only_got)[:3]};"
        f" sql only {len(only_want)} {sorted(only_want)[:3]}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from feedbackmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name, run in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = run(spark, sf_dir)
            problem = differences(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem) and not problem.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
