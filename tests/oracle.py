"""Runs queries against their SQL on DuckDB, compared as multisets of rounded values."""

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v) if isinstance(v, (list, dict)) else v


def compare(spark, name, fn, sql, sf_dir):
    """An explanation of the difference, or None."""
    df = fn(spark, sf_dir)
    got_columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in got_columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != got_columns:
        return f"columns {got_columns} and {sorted(columns)}"
    order = [columns.index(c) for c in got_columns]
    want = Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; here alone {list((got - want).items())[:3]}, there alone {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from latticeflow.session import session

    spark = session(master="local[4]", partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        at = time.time()
        try:
            said = compare(spark, name, queries[name], sql[name], sys.argv[1]) if name in sql else f"rows {queries[name](spark, sys.argv[1]).count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(name, "ok" if said is None else said, f"{time.time() - at:.1f}s", flush=True)
