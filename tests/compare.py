"""Run registered queries on Spark and their SQL on DuckDB, and compare the results.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


def kinds(types: dict[str, str]) -> dict[str, str]:
    same = {"integer": "int", "bigint": "bigint", "int": "int", "varchar": "string",
            "hugeint": "hugeint", "boolean": "boolean", "double": "double"}
    return {c: same.get(t.lower(), t.lower()) for c, t in types.items()}


def differences(spark_df, relation) -> list[str]:
    mine, theirs = spark_df.columns, relation.columns
    if sorted(mine) != sorted(theirs):
        return [f"columns {sorted(mine)} != {sorted(theirs)}"]
    found = []
    my_kinds = kinds(dict(spark_df.dtypes))
    their_kinds = kinds({c: str(t) for c, t in zip(theirs, relation.types)})
    for column in mine:
        if my_kinds[column] != their_kinds[column] and "[" not in their_kinds[column]:
            found.append(f"type of {column}: {my_kinds[column]} != {their_kinds[column]}")
    a = sorted_rows([tuple(r) for r in spark_df.collect()], mine)
    b = sorted_rows(relation.fetchall(), theirs)
    if len(a) != len(b):
        found.append(f"rows {len(a)} != {len(b)}")
    found += [f"{x}\n    != {y}" for x, y in zip(a, b) if x != y][:2]
    return found or ([] if a else ["no rows"])


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from placemetrics.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            sql = oracle_sql().get(name)
            found = differences(df, connection.sql(sql)) if sql else []
            if not sql:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [str(error)[:600]]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("   ", line, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
