"""Compare every registered report with its SQL counterpart: ``python tests/compare.py DIR [names]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return con


def normal(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple((type(r[i]).__name__, normal(r[i])) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns, value types and rows agree; else a short description."""
    relation = con.sql(sql)
    if sorted(relation.columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(relation.columns)}"
    ours = bag(spark_df.columns, spark_df.collect())
    theirs = bag(relation.columns, relation.fetchall())
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return f"{ours.total()} vs {theirs.total()} rows; only ours {extra}; only theirs {missing}"


def main(root: str, names: list[str]) -> int:
    from depotwise.plans.catalog import reports
    from depotwise.session import local_session

    spark, con, failures = local_session(8), connect(root), 0
    for name, report in reports().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = report.run(spark, root)
            sql = report.oracle()
            if sql is None:
                verdict = f"no SQL, {df.count()} rows"
            else:
                verdict = difference(df, con, sql) or "ok"
                failures += verdict != "ok"
        except Exception as problem:  # keep going, report all
            verdict, failures = f"{type(problem).__name__}: {str(problem)[:1500]}", failures + 1
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
