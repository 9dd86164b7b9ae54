"""Run registered queries against their SQL: python tests/oracle_check.py SF_DIR [query…]"""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as registered  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(name: str) -> str:
    return {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int", "DOUBLE": "double"}.get(name, name)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when rows, column names and types agree; else what differs."""
    df = registered.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in registered.oracle_sql():
        return None
    result = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: kind(str(d[1])) for d in result.description}
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    types = dict(df.dtypes)
    if types != kinds:
        return f"types differ: {[(c, types[c], kinds[c]) for c in columns if types[c] != kinds[c]]}"
    index = [names.index(c) for c in columns]
    order = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    got = sorted((tuple(r) for r in rows), key=order)
    want = sorted((tuple(r[i] for i in index) for r in result.fetchall()), key=order)
    if got != want:
        first = next((pair for pair in zip(got, want) if pair[0] != pair[1]), None)
        return f"{len(got)} rows and {len(want)}; first difference {str(first)[:1500]}"
    return None if got else "no rows"


if __name__ == "__main__":
    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("PARTITIONS", "8")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    for query in sys.argv[2:] or registered.queries():
        begun = time.time()
        try:
            found = compare(session, database(sf), query, sf)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{query}: {found or 'equal'} ({time.time() - begun:.1f} s)", flush=True)
