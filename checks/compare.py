"""Runs catalog queries in Spark and their SQL in DuckDB and compares rows as multisets.

    python -m checks.compare [scale folder] [query ...]
"""

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks import catalog, oracles

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(rows: DataFrame, con, name: str) -> str:
    """Empty when the rows of query ``name`` equal those of its SQL, else what differs."""
    columns = sorted(rows.columns)
    started = time.time()
    got = Counter(tuple(row) for row in rows.select(*columns).collect())
    middle = time.time()
    result = con.execute(oracles.all_oracles()[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    types = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {oracles.all_oracles()[name]})").fetchall())
    result = con.execute(oracles.all_oracles()[name])
    wanted = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    print(f"{name}: {sum(got.values())} rows, {middle - started:.1f}s, sql {time.time() - middle:.1f}s", flush=True)
    same_type = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, types[c]) for c, t in rows.dtypes if same_type.get(t) != types[c]]
    if got != wanted:
        return f"only Spark {list((got - wanted).items())[:3]}; only SQL {list((wanted - got).items())[:3]}"
    return f"types {odd}" if odd else ""


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failures = 0
    for name in names or list(catalog.all_queries()):
        try:
            problem = compare(catalog.all_queries()[name](spark, folder), con, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            failures += 1
            print(f"  FAIL {name}: {problem}", flush=True)
    print(f"{failures} failures", flush=True)
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.001"]
    sys.exit(1 if main(arguments[0], arguments[1:]) else 0)
