"""Runs registered queries next to their SQL and compares all rows."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    theirs = res.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} but SQL has {sorted(names)}"
    order = sorted(names)
    rows = spark_df.select(*[f"`{c}`" for c in order]).collect()
    ours = Counter(tuple(_plain(v) for v in r) for r in rows)
    pick = [names.index(c) for c in order]
    expected = Counter(tuple(_plain(r[i]) for i in pick) for r in theirs)
    kinds = dict(zip(names, [str(c[1]) for c in res.description]))
    small = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    for c, kind in spark_df.dtypes:
        if kind in small and kinds[c] != small[kind]:
            return f"type of {c}: {kind} but SQL has {kinds[c]}"
    if ours != expected:
        more, less = ours - expected, expected - ours
        return (f"{sum(ours.values())} rows but SQL has {sum(expected.values())}; "
                f"only here {sum(more.values())}, e.g. {str(next(iter(more), None))[:600]}; "
                f"only SQL {sum(less.values())}, e.g. {str(next(iter(less), None))[:600]}")
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from spanwright.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = compare(df, con, sql[name]) if name in sql else f"(no SQL) {df.count()} rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        ok = problem is None or problem.startswith("(no SQL)")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
