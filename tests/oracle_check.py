"""Run registered queries next to their SQL in DuckDB and report differences.

    python tests/oracle_check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    """One comparable form per value."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, float):
        return None if value != value else float(f"{value:.10g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    """``(verdict, seconds, rows)``; the verdict is empty when both sides agree."""
    start = time.time()
    df = fn(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return "", spent, len(got)
    result = con.execute(sql)
    sql_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if names != sql_names:
        return f"columns {names} against {sql_names}", spent, len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(map(tuple, want))][:2] if len(got) < 5000 else ""
        return f"{len(got)} rows against {len(want)} {extra}", spent, len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", spent, len(got)
    kinds = {d[0]: str(d[1]) for d in result.description}
    loose = [(c, t, kinds[c]) for c, t in df.dtypes if not same_type(t, kinds[c])]
    return (f"TYPES {loose}" if loose else ""), spent, len(got)


def same_type(spark_type, duck_type):
    table = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    if spark_type.startswith("decimal"):
        return duck_type.startswith("DECIMAL")
    return table.get(spark_type, spark_type) == duck_type


def main():
    import __spark_entry__ as entry

    from rosterlake.session import build_session
    args = sys.argv[1:]
    folder = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = tuple(a for a in args if not a.startswith("/"))
    spark = build_session("check", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            verdict, spent, n = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            verdict, spent, n = f"{type(e).__name__}: {str(e)[:700]}", 0.0, 0
        bad += bool(verdict)
        kind = "rows" if name not in oracles else "same"
        print(f"{'BAD ' if verdict else kind} {name} rows={n} {spent:.1f}s {verdict[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
