"""Compares registered queries with their SQL on the same tables.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def value(x):
    if isinstance(x, Decimal):
        return f"D{x.normalize()}"
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(repr([value(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, query, sql, sf_dir, df=None):
    """(what differs or None, number of rows)."""
    df = query(spark, sf_dir) if df is None else df
    left_cols, left = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, sum(left.values())
    rel = con.execute(sql)
    right_cols, right = table([d[0] for d in rel.description], rel.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}", 0
    if left != right:
        a, b = list((left - right).elements()), list((right - left).elements())
        return (
            f"rows {sum(left.values())} != {sum(right.values())}; differ {len(a)}/{len(b)}\n"
            + "\n".join(f"   spark {x[:700]}" for x in sorted(a)[:3]) + "\n"
            + "\n".join(f"   sql   {x[:700]}" for x in sorted(b)[:3])
        ), sum(left.values())
    return None, sum(left.values())


def main() -> int:
    import __spark_entry__ as entry

    from loomshift import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session.build("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                     "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            problem, rows = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as e:
            problem, rows = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {kind} {rows:7d} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
