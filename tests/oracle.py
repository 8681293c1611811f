"""Runs registered queries on Spark and their SQL on DuckDB and compares whole results.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str, sql: str) -> str:
    """Empty if both results agree in columns, types and rows; else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    if columns != sorted(theirs):
        return f"columns {columns} against {sorted(theirs)}"
    types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if types != theirs:
        return f"types {types} against {theirs}"
    order = [list(theirs).index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    if got == want:
        return "" if got else "no rows on either side"
    first = next(((a, b) for a, b in zip(got, want) if a != b), None)
    return f"{len(got)} rows against {len(want)}; first difference {first}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con, sqls = session(), database(folder), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for query_name in names:
        start = time.time()
        if query_name not in sqls:
            print(f"{query_name}: no SQL, {entry.queries()[query_name](spark, folder).count()} rows")
            continue
        try:
            problem = compare(spark, con, folder, query_name, sqls[query_name])
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{query_name}: {problem[:1500] or 'ok'} ({time.time() - start:.1f} s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
