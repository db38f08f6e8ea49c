"""Runs named queries on Spark and their SQL on DuckDB, and compares rows and column types."""

import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    """Rows as sorted tuples, columns by name."""
    names = sorted(frame.columns)
    return names, sorted(([r[n] for n in names] for r in frame.collect()), key=repr)


def kind(name):
    name = name.lower().partition("(")[0]
    return {"int": "integer", "string": "varchar", "tinyint": "byte", "short": "smallint", "long": "bigint"}.get(name, name)


def compare(spark, name, function, sql, sf_dir):
    """None, or what differs."""
    frame = function(spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = db.sql(sql)
    own = {c: kind(t) for c, t in frame.dtypes}
    other = {c: kind(str(t)) for c, t in zip(result.columns, result.types, strict=True)}
    if own != other:
        return f"columns {own} and {other}"
    names, got = rows_of(frame)
    at = [result.columns.index(n) for n in names]
    want = sorted(([r[i] for i in at] for r in result.fetchall()), key=repr)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; first differences {odd}"
    return None


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                said = compare(spark, name, queries[name], oracles[name], sys.argv[1]) or "equal"
            else:
                said = f"{queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:
            said = f"ERROR {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - start:.1f} s)", flush=True)
