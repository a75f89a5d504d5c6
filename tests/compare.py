"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_rows = spark_df.collect()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(dcols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(dcols)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(c, s, dtypes[c]) for c, s in spark_df.dtypes if s in kinds and kinds[s] != dtypes[c]]
    a, b = rows_of(got_rows, spark_df.columns), rows_of(want, dcols)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only spark {[x for x in a[:2000] if x not in set(b)][:1]} only sql {[x for x in b[:2000] if x not in set(a)][:1]} types {bad}"
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, p, q) for c, p, q in zip(sorted(dcols), x, y) if p != q]
            return f"values {str(diff)[:600]} row {str(x)[:300]} types {bad}"
    if bad:
        return f"types {bad}"
    return None


def main() -> None:
    import argparse

    import __spark_entry__ as entry
    from inkstone.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.sf)
    sqls, qs = entry.oracle_sql(), entry.queries()
    names = a.names or list(qs)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = qs[name](spark, a.sf)
            if name in sqls:
                msg, n = compare(df, con, sqls[name]), df.count() if a.names else -1
            else:
                n = len(df.collect())
                msg = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            msg, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {time.time() - start:5.1f}s {name} n={n} {'' if name in sqls else '(rows only)'} {msg or ''}", flush=True)
    print(f"{len(names)} run, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
