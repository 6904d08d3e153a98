"""Run registered queries and their checking SQL side by side."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    """The value with its kind: 1, 1.0 and "1" are different."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def _kinds(row):
    return tuple(None if v is None else type(v) for v in row)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_result(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    return _table([d[0] for d in cur.description], cur.fetchall())


def difference(a, b):
    """None when equal, else a short text."""
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}; only spark {list(set(a[1]) - set(b[1]))[:2]}; only sql {list(set(b[1]) - set(a[1]))[:2]}"
    for x, y in zip(a[1], b[1]):
        if x != y or _kinds(x) != _kinds(y):
            return f"\n  spark {x}\n  sql   {y}"
    return None


def main(argv):
    import time

    from gapweave.session import local_session
    import __spark_entry__ as entry

    folder = argv[0]
    only = argv[1:]
    spark = local_session(8, 4)
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    # say what was really read, by either engine
    seen = {t: con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("events", "pages", "documents")}
    read = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in seen}
    print(f"{folder} rows: sql {seen}, spark {read}", flush=True)
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t, got = time.time(), ([], [])
        try:
            got = spark_result(fn(spark, folder))
            secs = time.time() - t
            diff = difference(got, duck_result(con, sql[name])) if name in sql else "(no sql)"
            if name in sql and not got[1]:
                diff = diff or "(both empty)"
        except Exception as e:  # noqa: BLE001
            secs = time.time() - t
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        if diff:
            bad += diff != "(no sql)"
        print(f"{'ok ' if not diff else '-- ' if diff == '(no sql)' else 'BAD'} {name} {secs:.1f}s rows={len(got[1])} {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
