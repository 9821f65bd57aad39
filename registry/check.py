"""Run queries against their SQL: python -m registry.check FOLDER [NAME ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from duebook.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str:
    start = time.time()
    df = fn(spark, folder)
    ours = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(ours)} rows {took:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a != b:
        diff = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"DIFFERENT {len(a)} / {len(b)} rows: {sorted(names)} {diff}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    return f"ok {len(a)} rows {took:.1f}s" + ("" if a else " EMPTY") + _type_notes(df, kinds)


def _type_notes(df, kinds: dict[str, str]) -> str:
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"
    }
    notes = [f"{c}: {t}/{kinds[c]}" for c, t in df.dtypes if same.get(t) != kinds[c]]
    return " TYPES " + "; ".join(notes) if notes else ""


def main() -> int:
    from registry import ORACLES, QUERIES

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        try:
            verdict = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as error:
            verdict = f"ERROR {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name}: {verdict}", flush=True)
    print(f"{bad} of {len(QUERIES)} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(main())
