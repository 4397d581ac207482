"""Compare every query with its SQL statement: column names, row count and values.

    python tests/oracle_check.py [sf_dir] [name prefix or exact name ...]
"""

from __future__ import annotations

import datetime
import decimal
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v: object) -> str:
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return "D" + str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return "date " + v.isoformat()
    return str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


# Spark type -> DuckDB type; both sides should agree.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]).upper() for d in rel.description}
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(set(df.columns) ^ set(want_cols))}"
    types = [
        f"{f.name}: {f.dataType.simpleString()} / {want_types[f.name]}"
        for f in df.schema.fields
        if SAME_TYPE.get(f.dataType.simpleString()) != want_types[f.name]
    ]
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    note = f"{len(a)} rows {took:.1f}s" + (f"  TYPES {types}" if types else "")
    if a == b:
        return True, note
    in_a, in_b = set(a), set(b)
    only_a, only_b = [r for r in a if r not in in_b][:2], [r for r in b if r not in in_a][:2]
    return False, f"{note}; {len(b)} expected\n   cols {sorted(df.columns)}\n   spark {only_a}\n   sql   {only_b}"


def main() -> int:
    import __spark_entry__ as e
    from ledgerleaf.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    bad = [n for n in sql if n not in queries]
    print("statements without query:", bad, " queries without statement:", [n for n in queries if n not in sql], flush=True)
    failed = 0
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if name in sql:
                ok, note = compare(spark, con, name, queries[name], sql[name], sf_dir)
            else:
                start = time.time()
                ok, note = True, f"{queries[name](spark, sf_dir).count()} rows (rows only) {time.time() - start:.1f}s"
        except Exception as ex:  # report and go on with the next query
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
