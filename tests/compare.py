"""Compare the catalogue's queries with their SQL on the same tables."""

import math
import os
import sys
import time

import duckdb

TABLES = ["events", "documents", "benchmark", "embeddings"]


def connect(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        if not os.path.exists(f"{sf_dir}/{table}.parquet"):
            continue
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return db


# SQL type per Spark type.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str)


def compare(spark, db, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    relation = db.execute(sql)
    columns = [d[0] for d in relation.description]
    want = rows_of(columns, relation.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(columns)}"
    types = {d[0]: str(d[1]) for d in relation.description}
    wrong = {n: (t, types[n]) for n, t in df.dtypes if TYPES[t] != types[n]}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"{len(got)} rows but SQL has {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} but SQL has {b}"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.oracle_sql())
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            result = compare(spark, db, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28} {time.time() - start:6.1f}s {result or 'equal'}", flush=True)


if __name__ == "__main__":
    main()
